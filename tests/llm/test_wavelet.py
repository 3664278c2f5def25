import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import wavelet as wm
from tessera.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_access_rank_select(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n) * 1000
    m = wm.WaveletMatrix.from_bytes(wm.WaveletMatrix.of(ids, 16).to_bytes())
    assert m.all().tolist() == ids.tolist()
    if n:
        at = rng.integers(0, n, 50)
        assert m.access(at).tolist() == ids[at].tolist()
    for s in (0, 5000, 39000, 123):
        where = np.flatnonzero(ids == s)
        assert m.rank(s) == len(where)
        assert m.rank(s, n // 2) == (where < n // 2).sum()
        for k in range(0, len(where), 7):
            assert m.select(s, k) == where[k]
        with pytest.raises(IndexError):
            m.select(s, len(where))


TEXTS = [None, "", "J\u030c j\u030c I\u0307x, a.. b., c,. <|ENDOFTEXT|> W\u030a", "End.\nNext, one. A.B. it's. 3. x.y, É.", "Hello  World\n\nfoo's  BAR\t x", "é ́a", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ς", "long " * 3000, "x" * 5000, "日本語 text here"]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    start, out = 0, []
    for text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, start string")
    got = wm.read_shards(wm.write_shards(docs, new_path(spark, "w"), shard_tokens=1000)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(i * 3, *e) for i, e in enumerate(expected(TEXTS))]


def test_nulls_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, "b"), (None, "a"), (1, "b"), (1, None)], "doc_id long, text string")
    got = wm.read_shards(wm.write_shards(docs, new_path(spark, "w"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1]
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == expected(["a", None, "b", "b"])
    assert wm.read_shards(wm.write_shards(docs.limit(0), new_path(spark, "w"))).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = wm.query(spark, sf).orderBy("doc_id").collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == expected([r.text for r in rows])


def _same(texts):
    whole = Tokenizer.from_file(PATH)
    got = wm.Encoder(PATH)(texts)
    for text, ids, want in zip(texts, got, whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert np.frombuffer(ids, "<u2").tolist() == want.ids, repr(text)


def test_every_code_point_before_a_stop():
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c > 0xE0000 and c < 0xE0200)]
    for at in range(0, len(points), 50_000):
        part = points[at : at + 50_000]
        _same([f"a{c}. b{c}, K{c}" for c in part])


def test_random_texts_are_encoded_as_whole_texts():
    rng = random.Random(12)
    alphabets = ["aAbBzZ .,'\n\u0130\u0131\u0307\u0327İKıſ\u212a", "कख\u093c\u095c\u0958़, . ग", "\u09dc\u0a36\ufb2a\u05e9\u05bc., אב", "éÉe\u0301E\u0301nÑß. ,'sS'LL<|endoftext|>", "漢字かなガカ\u3099ハ゜한국\u1100\u1161. , 12٣½", "\u00a0\u2003\t\r\x0b\x85 .,a1_-ΣςσΩ\u1fb3"]
    texts = ["".join(rng.choice(rng.choice(alphabets[:1] + [a])) for _ in range(rng.randint(1, 30))) for a in alphabets for _ in range(6_000)]
    texts += ["İ. x", "KADIKÖYİ, evet", "पहाड़, और", None, "", "x <|endoftext|>. y"]
    _same(texts)


def test_other_tokenizers_encode_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")
    with open(other, encoding="utf-8") as f:
        assert not wm.splittable(json.load(f))
    text = "Two  spaces, and a line.\nEnd"
    assert np.frombuffer(wm.Encoder(other)([text])[0], "<u2").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


def test_smallest_id_and_null(spark, tmp_path):
    low = -(2**63)
    docs = spark.createDataFrame([(low, "a"), (None, "b c"), (3, None)], "doc_id long, text string")
    got = wm.read_shards(wm.write_shards(docs, f"file://{tmp_path}/w")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 3), (low, 3, 2), (3, 5, 1)]


def test_new_runs_are_encoded_together():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode(self, text, **kinds):
            self.texts += 1
            return self.tokenizer.encode(text, **kinds)

        def encode_batch(self, texts, **kinds):
            self.texts += len(texts)
            return self.tokenizer.encode_batch(texts, **kinds)

    texts = [f"w{i}!! \u0301x{i}? {i}-{i} \u00c9{i}). End\u0130\u0327{i}\t\u0958. <|endoftext|>{i}  " for i in range(300)] + [None, "", " "]
    encode = wm.Encoder(PATH)
    encode.tokenizer = counted = Counted(encode.tokenizer)
    first = encode(texts)
    assert counted.texts == 1  # not one for each run with marks or digits
    assert encode(texts[::-1])[::-1] == first and counted.texts == 1
    whole = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in first] == [w.ids for w in whole]


def test_pieces_hold_all_rows_in_order():
    texts = ["x" * 50, None, "", "yy", "z" * 7, "\u00e9" * 3, "w"]
    batch = pa.record_batch([pa.array(range(9)), pa.array(["q" * 99, "q", *texts])], ["id", "text"]).slice(2)
    assert [p.column(1).to_pylist() for p in wm._pieces(batch, 9)] == [texts[:1], texts[1:5], texts[5:]]
    assert list(wm._pieces(batch.slice(0, 0), 9)) == []


@pytest.mark.parametrize("n", [32_767, 32_768, 65_541])
def test_planes_longer_than_a_step(n):
    ids = np.random.default_rng(n).integers(0, 49_408, n)
    m = wm.WaveletMatrix.of(ids, 16)
    assert (m.all() == ids).all() and (m.access(np.arange(0, n, 97)) == ids[::97]).all()
