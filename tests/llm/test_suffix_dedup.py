import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, rng.integers(2, 6), rng.integers(0, 60))
    assert sd.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: tuple(x[i:]))


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    out = [None, "", "short", "a" * 300, "ab" * 200, prose(200)]
    for _ in range(40):
        out.append(prose(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 40) :] + prose(rng.randint(0, 60)))
    base = prose(150)
    for _ in range(10):
        at = rng.randint(0, len(base))
        out.append(base[:at] + word() + base[at + 2 :])
    return [*out, out[5], out[5]]


@pytest.mark.parametrize("hot", [sd.HOT, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    spans = sd.repeated_spans(sd.distinct_texts(docs, "text", 100), 100, 50)
    by_key = {bytes(r.key): sd.merged(r.windows, 100) for r in spans.collect()}
    want = brute([t for _, t, _ in rows], 100)
    for (i, t, _), (n, gone, runs, digest) in zip(rows, want):
        data = (t or "").encode()
        ranges = by_key.get(hashlib.sha256(data).digest()[:16], [])
        assert (len(data), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(sd._kept(data, ranges)).hexdigest()) == (n, gone, runs, digest), i


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 700)
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(5000))
    docs = [a + "x" + a[100:3000], a[2000:4000], "q" * 2000]
    got = sd.removal_digests(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(docs, 400)


def test_equal_runs_come_once():
    buf = np.frombuffer(b"q" * 3000 + b"ab" * 1500, np.uint8)
    s, e, p, h, u, l, n = sd.anchors(buf, np.array([3000, 6000]), 400, 200)
    assert len(s) < 10 and n.sum() > 2600 and (l >= e).all()


def test_hot_text_and_passages(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(n))
    short, hot = prose(55), prose(300)
    docs = [prose(90), f"{prose(60)} {short} {prose(60)}", f"{prose(40)} {short}", *[hot] * 400, "", None, prose(20)]
    assert len(short) < 400
    got = sd.removal_digests(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(docs, 400)
    assert [r.repeats for r in got] == [False, True, True, *[True] * 400, False, False, False]
    assert [r.n_passages for r in got] == [0, 1, 1, *[1] * 400, 0, 0, 0]


def test_empty_and_null_ids(spark):
    assert sd.removal_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "z y " * 200
    rows = sd.removal_digests(spark.createDataFrame([(None, t), (None, "k")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(None, 0), (None, 800)]


def test_without_repeats_keeps_columns(spark):
    t = "".join(random.Random(3).choice("abcdefgh") for _ in range(500))
    docs = spark.createDataFrame([(1, t, "u"), (2, "v" + t + "w", "u"), (3, None, None)], "doc_id long, text string, _key string")
    out = sd.without_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "", "u"), (2, "vw", "u"), (3, None, None)]


def brute_passages(texts, words):
    """The texts without their 400-byte repeats and their repeats of that many words."""
    data = [(t or "").encode() for t in texts]
    split = [[m.span() for m in re.finditer(rb"[^\t-\r ]+", d)] for d in data]
    names = [[d[a:b] for a, b in x] for d, x in zip(data, split)]
    seen = Counter(tuple(n[i : i + words]) for n in names for i in range(len(n) - words + 1))
    strings = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d, x, n in zip(data, split, names):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if strings[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        for i in range(len(n) - words + 1):
            if seen[tuple(n[i : i + words])] > 1:
                gone[x[i][0] : x[i + words - 1][1]] = True
        out.append(bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_passages_of_short_words(spark, monkeypatch):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    out = [None, "", "a " * 60, "\n" + "ab " * 51, "x" * 900, "y" + "x" * 900]
    for n in (*range(51, 61), 50, 20):  # each twice, and the last two too short to be cut
        shared = prose(n)
        assert len(shared.encode()) < 400
        out += [f"{prose(80)} {shared}\n{prose(80)}", f"{prose(30)}\t{shared} {prose(200)}"]
    common = prose(70)  # one passage in many texts, whole and in parts
    for _ in range(30):
        out.append(prose(rng.randint(0, 60)) + " " + " ".join(common.split()[rng.randint(0, 9) : 70 - rng.randint(0, 9)]) + " " + prose(rng.randint(0, 60)))
    out.append(out[10])
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    want = brute_passages(out, 51)
    for piece in (sd.PIECE, 150):
        monkeypatch.setattr(sd, "PIECE", piece)
        got = sd.without_repeats(docs, words=51).orderBy("doc_id").collect()
        assert [r.text or "" for r in got] == want
    assert sd.without_repeats(docs.limit(0), words=51).collect() == []
