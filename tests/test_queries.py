"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or (not isinstance(v, str) and pd.isna(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in catalogue.ORACLE_SQL:
        found = duck.execute(catalogue.ORACLE_SQL[name])
        want = rows([c[0] for c in found.description], found.fetchall())
        assert got == want


def test_registry_is_consistent():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
