import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as mx


def brute(cells, margins, targets, rounds):
    total = sum(t for _, t in cells)
    f = [1.0] * len(cells)
    for _ in range(rounds):
        for m, goal in zip(margins, targets):
            for v in {c[m] for c, _ in cells}:
                at = [i for i, (c, _) in enumerate(cells) if c[m] == v]
                now = sum(cells[i][1] * f[i] for i in at)
                for i in at:
                    f[i] *= goal[v] * total / now if now > 0 else 1
    return f


def test_rake_against_brute_force(spark):
    cells = [((a, b), float(10 + 7 * i * j)) for i, a in enumerate("xyz") for j, b in enumerate("pqr")]
    rows = [(f"={a}", f"={b}", int(t)) for (a, b), t in cells]
    goals = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.2, "q": 0.2, "r": 0.6}]
    got = mx.rake(spark.createDataFrame(rows, "a string, b string, t long"), ("a", "b"), dict(zip("ab", goals)), 8).collect()
    want = brute([(dict(a=a, b=b), t) for (a, b), t in cells], "ab", goals, 8)
    have = {(r.a, r.b): r.factor for r in got}
    for ((a, b), _), f in zip(cells, want):
        assert have[f"={a}", f"={b}"] == pytest.approx(f, rel=1e-9)


def test_sample_has_the_target_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mx.sampled(docs, targets={"lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}})
    expected = got.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("t")).collect()
    whole = sum(r.t for r in expected)
    assert all(abs(r.t / whole - 0.25) < 0.01 for r in expected)
    kept = got.where("kept").agg(F.sum("n_tokens")).first()[0]
    assert abs(kept / whole - 1) < 0.1


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mx.sampled(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_odd_rows_against_sql(spark):
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (None, "a b c", "en", None), (3, "mail me@x", "", "s"), (3, "mail me@x", "", "s"), (4, "licence " * 9000, "en", ""), (5, "a\nb\nc", "de", "null"), (6, "plain words " * 20, "de", "s")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, p double")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(mx.SQL).fetchall(), key=str)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "topic", "p", "kept")) for r in mx.sampled(df).collect()), key=str) == want
    assert mx.mixed(df).columns == df.columns
    assert mx.sampled(df.limit(0)).collect() == [] and mx.mixed(df.limit(0)).collect() == []


def test_a_rare_row_does_not_shrink_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = docs.unionByName(spark.createDataFrame([(-1, "one row of a language of its", "xx", "src0")], docs.schema))
    got = mx.sampled(rare, budget=mx.BUDGET).join(rare.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("p") * F.col("n_tokens")).alias("x"), F.max("p").alias("p")).collect()
    whole, kept = sum(r.t for r in got), sum(r.x for r in got)
    goal = {r.lang: r.t**mx.POWER for r in got}
    assert 0.7 < kept / whole <= mx.BUDGET and all(0 < r.p <= 1 for r in got)
    assert all(abs(r.x / kept - goal[r.lang] / sum(goal.values())) < 0.02 for r in got)
