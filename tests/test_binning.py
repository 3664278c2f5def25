"""Percentiles over buckets are the exact ones."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import binning as bi

r = random.Random(2)
CASES = {
    "normal": [r.gauss(0, 1) for _ in range(500)],
    "ties": [float(r.randint(-2, 2)) for _ in range(101)],
    "far": [r.random() for _ in range(200)] + [1e12, -1e12],
    "infinite": [1.0, 2.0, 3.0, 5.0, float("inf")],
    "one": [4.5],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_percentiles(spark, name):
    df = spark.createDataFrame([(v,) for v in CASES[name]], "x double")
    points = [0.0, 1 / 7, 0.5, 0.9, 1.0]
    assert bi.percentiles(df, "x", points, "p").first() == df.agg(F.percentile("x", points).alias("p")).first()


def test_no_task_holds_all_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    for made in (bi.quantile_breaks(df, "x", 3), bi.hybrid_breaks(df, "x", 3), bi.shape(df, "x")):
        assert "percentile(" not in made._jdf.queryExecution().executedPlan().toString()
