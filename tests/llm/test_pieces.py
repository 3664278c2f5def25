import random
import zlib

import numpy as np
import pytest
import sentencepiece

from tessera.llm import pieces as pc

SP = sentencepiece.SentencePieceProcessor(model_file=pc.model_path())


def strings():
    rng = random.Random(3)
    docs = ["".join(rng.choice("aabcdeeinorst") for _ in range(3000)), "ab" * 1500, "é日本語🙂" * 200, " " * 500 + "x" + " " * 700, "the quick brown fox, " * 200, "====----" * 300, "\n\n\t a  b\n" * 300]
    return docs + ["".join(rng.choice("thersion  ,.\n1é语🙂") for _ in range(4000)) for _ in range(4)]


@pytest.mark.parametrize("size", [80, 200, 1000])
def test_scan_equals_library(size):
    model = pc.pieces_of(pc.model_path())
    for text in strings():
        parts = pc.split(model.normalize(text), size, model.longest)
        found = pc.scan([model.matrix(*p) for p in parts])
        assert found is not None, text[:30]
        ends, offsets = found
        ids = []
        for p, s, e, n in zip(parts, [0, *ends[:-1]], ends, offsets):
            assert n == len(ids)
            ids += model.between(*p, s, e)
        assert ids == SP.encode(text), text[:30]
        assert model.decode(ids) == SP.decode(ids) == text


def test_combine_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, -np.inf, rng.integers(0, 9, (4, 4))) for _ in range(3))
    assert (pc.combine(pc.combine(a, b), c) == pc.combine(a, pc.combine(b, c))).all()


def test_round_trip(spark):
    texts = [None, "", "x", " lead", "tail ", *strings(), strings()[0]]
    docs = spark.createDataFrame([(i, t, "k", [9]) for i, t in enumerate(texts)] + [(None, "x", "k", None)], "doc_id long, text string, key string, ids array<int>")
    rows = pc.encoded(docs, chunk=500).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [None, *range(len(texts))]
    assert [list(r.ids) for r in rows[1:]] == [SP.encode(t or "") for t in texts] and rows[3].key == "k"
    back = pc.decoded(pc.encoded(docs, chunk=500)).where("doc_id is not null").orderBy("doc_id").collect()
    assert [r.text for r in back] == [t or "" for t in texts]
    report = {r.doc_id: r for r in pc.encoding_report(docs, chunk=500).collect()}
    assert all(report[i].decoded_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    assert pc.encoded(docs.limit(0)).collect() == []
