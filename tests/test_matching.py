"""Matching: repeated names, names of equal distance, scores as the SQL has them."""

import random

import duckdb
import pandas as pd
import pytest

from tessera.functions import text as tx
from tessera.functions.distances import _edit
from tessera.operators import matching as ma


def test_coverage_counts_a_lookup_row_once(spark):
    lookup = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "X"), ("b", "X"), ("a", "Y"), ("a", "Z"), ("a", None)], "adm2 string, hf_mfl string")
    matched = spark.createDataFrame([("X",), ("Y",), (None,)], "hf_mfl string")
    assert tuple(ma.coverage(matched, lookup).first()) == (4, 3, 1, 25.0)


def made(al, longest, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(al) for _ in range(r.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("al,longest", [("AB", 4), ("ABCDE01", 20), ("ABC01", 90)])
def test_nearest_names_are_those_of_all_pairs(spark, monkeypatch, al, longest):
    monkeypatch.setattr(ma, "SIDE", 7)  # several tiles in a block
    names, known = made(al, longest, 25, 1), made(al, longest, 30, 2)
    rows = lambda x: [(b, n) for b in "pq" for n in x] + [("only" + str(len(x)), x[0])]
    df = ma.nearest_names(spark.createDataFrame(rows(names) * 2, "block string, name string"), spark.createDataFrame(rows(known) * 3, "block string, candidate string"))
    got = sorted(tuple(r) for r in df.collect())
    best = {n: sorted((_edit(n, c, False), c) for c in set(known))[:3] for n in set(names)}
    assert got == sorted((b, n, c, d, i) for b in "pq" for n, found in best.items() for i, (d, c) in enumerate(found, 1))


def test_jaro_is_the_sql_s():
    pairs = [(a, b) for al, k in (("AB", 6), ("AB01 ", 30), ("0123456789", 20)) for a, b in zip(made(al, k, 500, 3), made(al, k, 500, 4))]
    frame = pd.DataFrame(pairs, columns=["a", "b"])
    con = duckdb.connect()
    con.register("frame", frame)
    assert [tx.jaro(a, b) for a, b in pairs] == [r[0] for r in con.execute("SELECT jaro_similarity(a, b) FROM frame").fetchall()]


@pytest.mark.parametrize(
    "threshold,one,name,known,want",
    [
        (85.0, False, "Supplier#00005305", "Supplier#000005325", ("fuzzy", 93)),
        (95.0, False, "Supplier#00000640", "Supplier#000000640", ("fuzzy", 95)),
        (60.0, True, "Suplier#000004084", "Supplier#000000084", ("fuzzy", 91)),
    ],
)
def test_odd_transpositions_in_matching(spark, threshold, one, name, known, want):
    got = ma.match_facilities(spark.createDataFrame([("a", "1", name)], "adm2 string, uid string, hf string"), spark.createDataFrame([("a", known)], "adm2 string, hf_mfl string"), ["adm2"], threshold, one).first()
    assert (got.match_method, got.match_pct) == want


def test_fuzzy_matches_are_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ma, "SIDE", 9)
    names, known = sorted(set(made("ABC01", 9, 40, 5))), sorted(set(made("ABC01", 9, 50, 6)))
    names = [n for n in names if n not in known]
    admin = lambda x: [(a, *r) for a in ("p", None) for r in x]
    target = spark.createDataFrame(admin([(n, n) for n in names]), "adm2 string, uid string, hf string")
    df = ma.match_facilities(target, spark.createDataFrame(admin([(n,) for n in known]), "adm2 string, hf_mfl string"), ["adm2"], 70.0, False)
    got = {(r.adm2, r.uid): r.hf_mfl for r in df.collect()}
    best = {}
    for n in names:
        s, c = min((-50 * tx.jaro(n, c) - 50 * max(0, 1 - _edit(n, c, False) / max(len(n), len(c))), c) for c in known)
        best[n] = c if -s >= 70 else None
    assert got == {(a, n): c for a in ("p", None) for n, c in best.items()} and any(best.values()) and not all(best.values())
