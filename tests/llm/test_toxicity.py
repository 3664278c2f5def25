import random

import numpy as np

from tessera.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.where("crc32(cast(doc_id as string)) % 3 <> 0")
    asked = labels.where("crc32(cast(doc_id as string)) % 3 = 0").withColumnRenamed("toxic", "y")
    rows = tx.score(docs, known).join(asked, "doc_id").select("toxic", "y").collect()
    yes, no = [r.toxic for r in rows if r.y == 1], [r.toxic for r in rows if r.y == 0]
    assert len(yes) > 30 and np.mean(yes) > 0.9 and np.mean(no) < 0.01


def test_out_of_fold_inputs_reach_later_models():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["red", "green", "blue"]) for _ in range(20)) + (" awful nasty vile" if i % 2 else "") for i in range(200)]
    y = np.array([i % 2 for i in range(200)])
    chain = tx.Chain.fit([tx.text_features(t) for t in texts], np.full(200, 23), y)
    assert [len(m.dense) for m in chain.models] == [0, 1, 2]
    p = chain.predict(["red green", "so vile and awful, nasty", None, "", "vile " * 50_000])
    assert p.shape == (5, 3) and p[1, 2] > 0.5 and p[0, 2] < 0.5 and p[2, 2] < 0.5 and p[4, 2] == chain.predict(["vile"])[0, 2]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "vile"), (None, "x"), (1, None), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.toxic for r in tx.score(docs, none).collect()) == [False] * 4
    one = spark.createDataFrame([(1, 1, None), (1, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r.toxic for r in tx.score(docs, one).collect()) == [False] * 4
    assert tx.score(docs.limit(0), none).collect() == []
    assert tx.without_toxic(docs.selectExpr("*", "'c' AS p_toxic"), one).count() == 4


def test_scores_against_plain_sums(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red", "green", "Blue", "größe", "yellowish"]) for _ in range(rng.randint(1, 30))) + (rng.choice([" awful", " nastyness vile", " vilest"]) if i % 2 else "") for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (300, None), (301, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300) if i % 5], "doc_id long, toxic int")
    chain = tx.learn(docs, labels)
    place = {f: i for i, f in enumerate(chain.chosen.tolist())}
    assert place
    for r in tx.score(docs, labels).collect():
        text = texts[r.doc_id] if r.doc_id < 300 else ""
        found = {f for w in tx.WORD.findall(text.lower()) for f in tx.features_of(w)}
        before = []
        for m in chain.models:
            z = m.bias + sum(m.weights[place[f]] for f in found if f in place) + sum(w * p for w, p in zip(m.dense, before))
            before.append(1 / (1 + np.exp(-z)))
        assert np.allclose([r.p_repeated, r.p_severe, r.p_toxic], before) and r.toxic == (before[-1] >= 0.5)


def test_choice_of_features_leaves_out_the_fold():
    counts = np.zeros((2, tx.SPACE), np.int64)
    counts[1, 7] = 20
    assert tx._selected(counts, np.array([100, 100]))[0].tolist() == [7]
    assert tx._selected(counts * 0, np.array([100, 100]))[0].tolist() == []


def test_repeated_ids_and_full_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"{'vile' if i % 2 else 'kind'} w{i // 40}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    chain = tx.learn(docs, labels)
    p = chain.predict(["vile", "kind"])[:, 2]
    assert p[0] > 0.5 > p[1]
    monkeypatch.setattr(tx, "SAMPLE_BYTES", 1)  # one text of each class
    assert tx.learn(docs, labels).predict(["vile"]).shape == (1, 3)
