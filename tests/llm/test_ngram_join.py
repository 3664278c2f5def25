import random

import pytest

from tessera.llm import ngram_join as nj


def brute(rows, width=3, num=9, den=10):
    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = [None, "", " \t\n", "a", "A", "a b", "one two three", "One  two\nthree", "x" * 5000]
    for _ in range(60):  # near copies of one text, some only near each other
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    chain = [rng.choice(words) for _ in range(200)]
    for _ in range(15):  # a chain: each near the next
        chain = list(chain)
        chain[rng.randrange(200)] = rng.choice(words)
        chain[rng.randrange(200)] = rng.choice(words)
        out.append(" ".join(chain))
    for _ in range(40):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) + " " + " ".join(base[:30]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, id string, n int")
    assert sorted((tuple(r) for r in nj.jaccard_components(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("width,num,den", [(5, 8, 10), (1, 1, 2)])
def test_other_thresholds(spark, width, num, den):
    rows = list(enumerate(texts(9)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nj.jaccard_components(df, width=width, num=num, den=den)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, width, num, den)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (9, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    assert sorted((tuple(r) for r in nj.jaccard_components(df).collect()), key=str) == sorted([(None, 2, None), (5, 2, 5), (9, 2, 5), (9, 2, 5)], key=str)
    assert nj.jaccard_components(df.limit(0)).collect() == []
    assert sorted(r.doc_id or 0 for r in nj.representatives(df).collect()) == [0, 5]


def test_representatives_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (3, a), (9, b), (9, c), (4, None), (4, None), (None, c)]
    kept = nj.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(3, a), (7, b), (9, c), (4, None), (None, c)], key=str)


def test_copies_meet_the_least_changed_one(spark, monkeypatch):
    """Copies that link only with their original, which has the largest id: about one candidate pair for each, not all pairs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):
        t = list(base)
        for at in rng.sample(range(0, 300, 6), 6):
            t[at] = f"new{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    rows.append((999, " ".join(base)))
    seen, whole = [], nj._linked

    def counted(pairs, *a):
        seen.append(pairs.count())
        return whole(pairs, *a)

    monkeypatch.setattr(nj, "_linked", counted)
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=5, num=4, den=5).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(seen) <= 2 * len(rows)
