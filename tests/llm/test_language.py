import numpy as np
import pytest

from tessera.llm import language as lg


def brute_phrases(learned: bytes, symbols: bytes) -> int:
    n, i = 0, 0
    while i < len(symbols):
        k = i
        while k < len(symbols) and symbols[i : k + 1] in learned:
            k += 1
        n, i = n + 1, max(k, i + 1)
    return n


@pytest.mark.parametrize("seed", range(5))
def test_phrases_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    samples = {k: "".join(rng.choice(list("abcde ñ"), 300)) for k in "xy"}
    model = lg.Model.of(samples)
    texts = [lg.normal_bytes("".join(rng.choice(list("abcdez ñü"), n)) + "a") for n in (1, 5, 100, 511, 512, 513, 2000)]
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate("xy"):
            learned = model.symbol[lg.normal_bytes(samples[lang])].tobytes()
            s = model.symbol[t].tobytes()
            assert got[i, k] == brute_phrases(learned, s)


@pytest.mark.parametrize("block", [2, 7, 64])
def test_phrases_reach_over_blocks(monkeypatch, block):
    monkeypatch.setattr(lg, "BLOCK", block)
    rng = np.random.default_rng(block)
    sample = "ab" * 200 + "".join(rng.choice(list("abc"), 200))
    model = lg.Model.of({"x": sample})
    texts = [lg.normal_bytes(t) for t in ("ab" * 100, "a", "ba" * 33 + "c", "".join(rng.choice(list("abcz"), 700)), "zzzz" * 9)]
    learned = model.symbol[lg.normal_bytes(sample)].tobytes()
    assert model.phrases(texts)[:, 0].tolist() == [brute_phrases(learned, model.symbol[t].tobytes()) for t in texts]


def test_prediction_against_brute_force_and_ties(spark):
    rng = np.random.default_rng(9)
    samples = {"p": "".join(rng.choice(list("abcd "), 400)), "q": "".join(rng.choice(list("cdef "), 400)), "r": "ghghgh", "s": "ghghgh"}
    model = lg.Model.of(samples)
    texts = ["".join(rng.choice(list("abcdefgh "), int(n))) + "a" for n in rng.integers(1, 900, 60)] + ["ghgh", "hg"]
    got, scores = model.predict(texts)
    for text, lang, score in zip(texts, got, scores):
        s = model.symbol[lg.normal_bytes(text)].tobytes()
        cost = {}
        for k, v in samples.items():
            learned = model.symbol[lg.normal_bytes(v)].tobytes()
            cost[k] = brute_phrases(learned, s) * np.log2(max(2, len(learned))) / len(s)
        first, second = sorted(cost.values())[:2]
        assert lang == min(k for k in cost if cost[k] == first) and abs(score - (1 - first / second)) < 1e-9
    assert got[-2:] == ["r", "r"] and scores[-2:] == [0.0, 0.0]  # ties: the first by name


def test_parts_of_whole_texts_and_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([("a" * 3000 + "b" * 3000 + "c" * 10, "x"), (None, "x"), ("d", "y"), ("e", "y"), ("f", "z")], "text string, lang string")
    assert [a.learned for a in lg.learn(docs).automata] == [6012, 3, 1]
    monkeypatch.setattr(lg, "LANGUAGES", 2)
    assert lg.learn(docs).langs == ["x", "y"]
    monkeypatch.setattr(lg, "TOTAL", 2)
    assert [a.learned for a in lg.learn(docs).automata][1] == 1


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lg.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 100
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_undetermined_and_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and ran", "en", "a") for i in range(10)] + [(100, None, "en", "b"), (101, "", None, "b"), (102, "12 34!", "en", "b"), (None, "the cat", None, "b"), (103, "x" * 100_000, "fr", None), (103, "the cat", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = lg.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[None].held_out and by[None].lang_pred in ("en", "fr")
    assert lg.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in lg.identify(docs.drop("lang").selectExpr("*", "cast(null as string) AS lang")).collect()} == {"und"}


def test_copies_do_not_shrink_the_sample(spark):
    alphabets = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx"}
    rng = np.random.default_rng(2)
    text = {k: " ".join("".join(rng.choice(list(v), 5)) for _ in range(8)) for k, v in alphabets.items()}
    rows = [(text[k], k) for k in alphabets for _ in range(10_000)]
    rows += [("".join(rng.choice(list("yzß"), 20)), "short") for _ in range(6_000)]  # distinct texts of few bytes fill the sample as well
    model = lg.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == [*alphabets, "short"]
    assert [a.learned for a in model.automata[:4]] == [len(lg.normal_bytes(text[k])) for k in alphabets]
    assert lg.SAMPLE <= model.automata[4].learned < 1.1 * lg.SAMPLE
