import hashlib
import random

import duckdb
import pytest
import sentencepiece

import corpus_pipeline as cp
from tessera.llm import mixing, pieces, toxicity

from .test_ngram_join import brute as brute_links
from .test_suffix_dedup import brute_passages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage and after the last, written and read again as the tool does."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [sorted(df.collect(), key=lambda r: r.doc_id) for df in out], [df.columns for df in out]


def test_names_and_columns(stages):
    assert 4 <= len(cp.STAGES) <= 5
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1])


def test_toxicity(spark, stages):
    rows, _ = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    p = chain.predict([r.text for r in rows[0]])[:, -1]
    assert [r.doc_id for r, x in zip(rows[0], p) if x < 0.5] == [r.doc_id for r in rows[1]]


def test_near_copies(stages):
    rows, _ = stages
    links = brute_links([(r.doc_id, r.text) for r in rows[1]], 5, 4, 5)
    assert sorted(i for i, _, c in links if i == c) == [r.doc_id for r in rows[2]]


def test_repeated_passages(stages):
    rows, _ = stages
    want = brute_passages([r.text for r in rows[2]], 51)
    for r, text in zip(rows[3], want):
        assert (r.text or "") == text and (r.text is None or r.n_chars == len(r.text))
    assert [r.doc_id for r in rows[3]] == [r.doc_id for r in rows[2]]


def test_mixing(stages):
    rows, _ = stages
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(r.doc_id, r.text, r.lang, r.source) for r in rows[3]])
    docs = con.execute(f"WITH {mixing.sql()} SELECT doc_id, source, lang, topic, n_tokens FROM d1").fetchall()
    cells = {}
    for _, *key, n in docs:
        cells[tuple(key)] = cells.get(tuple(key), 0) + n
    whole, factor = sum(cells.values()), dict.fromkeys(cells, 1.0)
    share = []
    for m in range(3):
        got = {}
        for key, t in cells.items():
            got[key[m]] = got.get(key[m], 0) + t
        powers = {v: t**mixing.POWER for v, t in got.items()}
        share.append({v: x / sum(powers.values()) for v, x in powers.items()})
    for _ in range(mixing.ROUNDS):
        for m in range(3):
            now = {}
            for key, t in cells.items():
                now[key[m]] = now.get(key[m], 0) + t * factor[key]
            factor = {k: min(1.0, f * (share[m][k[m]] * whole * mixing.BUDGET / now[k[m]] if now[k[m]] else 1)) for k, f in factor.items()}
    chance = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    p = {k: 1.0 if cells[k] == 0 and f > 0 else f for k, f in factor.items()}
    assert sorted(i for i, *key, _ in docs if chance(i) < p[tuple(key)]) == [r.doc_id for r in rows[4]]


def test_pieces(stages):
    rows, _ = stages
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert rows[5] and [list(r.ids) for r in rows[5]] == [sp.encode(r.text) for r in rows[4]]


def test_run_is_the_stages(spark, stages):
    rows, _ = stages
    assert sorted((r.doc_id, list(r.ids)) for r in cp.run(spark, SF).collect()) == [(r.doc_id, list(r.ids)) for r in rows[5]]


def test_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x " * 900, "en", "s", 1), (2, "", "en", "s", 0), (3, "x " * 900, None, "s", 2), (3, "x " * 900, None, "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame, ids in ((docs, [None, 1, 2, 3]), (docs.limit(0), [])):
        for _, stage in cp.STAGES[:2]:  # nothing is toxic without labels; the two equal rows count once
            frame = stage(spark, frame, str(tmp_path))
        assert sorted((r.doc_id for r in frame.collect()), key=lambda i: (i is not None, i)) == ids
        for _, stage in cp.STAGES[2:]:
            frame = stage(spark, frame, str(tmp_path))
        left = {r.doc_id for r in frame.collect()}
        assert "ids" in frame.columns and left <= set(ids) and (1 in left) == (1 in ids)  # a text without tokens takes nothing of the budget


def test_short_passages_are_cut(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [prose(n) for n in range(51, 61)]
    docs = spark.createDataFrame([(10 * i + k, f"{prose(60)} {s} {prose(60)}", "en", "s", 1) for i, s in enumerate(shared) for k in (0, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.repeated_passages_stage(spark, docs, SF).collect()
    assert [len(r.text.split()) for r in out] == [120] * 20 and all(r.n_chars == len(r.text) for r in out)


def test_near_copies_by_five_words(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for changed in (0, 1, 2, 3, 5, 8):
            text = list(base)
            for at in rng.sample(range(120), changed):
                text[at] = "new"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want, tight = ([i for i, _, c in brute_links(rows, *by) if i == c] for by in ((5, 4, 5), (3, 9, 10)))
    assert sorted(r.doc_id for r in cp.near_copies_stage(spark, docs, SF).collect()) == sorted(want) != sorted(tight)
