import hashlib
import io
import random
import wave
import zlib

import pytest

from tessera.llm import media as md
from tessera.llm.common import staged


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(3000)
    out = [None, "", "x" * 64, "x" * 65, "a" * 100_000, shared]
    out += [prose(rng.randint(0, 400)) + shared[rng.randint(0, 9000) :] + prose(50) for _ in range(12)]
    return out + [out[5], out[5], out[7], None]


def expected(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64 if data else 64)
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(md.RATE)
        w.writeframes(payload)
    stored = buf.getvalue()
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()


def test_cuts_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    parts = md.chunks(data)
    assert b"".join(parts) == data
    assert all(len(p) <= md.MOST for p in parts) and all(len(p) >= md.LEAST for p in parts[:-1])
    moved = md.chunks(b"inserted" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)


@pytest.mark.parametrize("files", [True, False])
def test_round_trip(spark, files):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    docs = staged(docs, "in") if files else docs
    got = {r.doc_id: r for r in md.media_features(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == expected(t), i
    assert got[5].feature == got[18].feature == got[19].feature


def test_chunks_are_stored_once(spark):
    store = md.write_store(spark.createDataFrame([(t,) for t in texts()], "text string"))
    chunk = store.where("kind = 1")
    assert chunk.count() == chunk.select("key").distinct().count() > 0
    assert store.where("kind = 0").count() == len({t or "" for t in texts()})


def test_damage_is_noticed():
    part = b"p" * 100
    with pytest.raises(ValueError):
        list(md.media_parts(b"h", [md.digest(part)], [0], md.zstandard.compress(md.struct.pack("<I", 100)), lambda i: b"q" * 100))


def test_empty(spark):
    assert md.media_features(spark.createDataFrame([], "doc_id long, text string")).collect() == []
