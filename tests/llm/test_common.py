import random

import pytest

from tessera.llm import common


class Bare:
    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(Bare) == common.shared_dir(Bare) != common.shared_dir(spark)


class Clustered:
    class conf:
        @staticmethod
        def get(key, default=None):
            return "spark://host:7077" if key == "spark.master" else default


def test_a_cluster_must_name_its_shared_folder(spark):
    assert spark.conf.get("spark.master") == spark.sparkContext.master
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Clustered)


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (8, 9), (9, 8)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
