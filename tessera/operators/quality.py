"""Checks of routine data: cascades, missing values, duplicates, future dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import require


def consistency_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each (input, output) pair: rows in which the output exceeds the input, of all rows. One pass for all pairs."""
    require(df, sorted({c for p in pairs for c in p}))
    sums = [F.struct(F.lit(a).alias("input"), F.lit(b).alias("output"), F.coalesce(F.sum(F.when(F.col(b) > F.col(a), 1).otherwise(0)), F.lit(0)).cast("long").alias("n_failed"), F.count("*").alias("n_rows")) for a, b in pairs]
    got = df.agg(F.array(*sums).alias("p")).select(F.inline("p"))
    share = F.try_divide(F.col("n_failed").cast("double"), F.col("n_rows").cast("double"))
    return got.select("*", F.bround(share, 6).alias("prop_failed"), F.when(F.col("n_failed") > 0, "fail").otherwise("pass").alias("status"))


def consistency_map(df: DataFrame, input_: str, output: str, areas: list[str]) -> DataFrame:
    """Per area: sums of both indicators and how far they agree."""
    got = df.groupBy(*areas).agg(F.coalesce(F.sum(input_), F.lit(0.0)).alias("sum_input"), F.coalesce(F.sum(output), F.lit(0.0)).alias("sum_output"), F.coalesce(F.sum(F.when(F.col(output) > F.col(input_), 1).otherwise(0)), F.lit(0)).cast("long").alias("n_failed"), F.count("*").alias("n_rows"))
    return got.select(*areas, "sum_input", "sum_output", "n_failed", "n_rows", F.bround(100 * F.col("n_failed") / F.col("n_rows"), 4).alias("pct_failed"), (F.col("sum_output") <= F.col("sum_input")).alias("consistent"))


def consistency_zscores(df: DataFrame, input_: str, output: str, keep: list[str]) -> DataFrame:
    """Rows in which the output exceeds the input, with the z-score of their difference over all differences."""
    rows = df.withColumn("difference", F.col(output) - F.col(input_))
    whole = rows.agg(F.avg("difference").alias("_m"), F.stddev_samp("difference").alias("_s"))  # one row
    z = F.when(F.col("_s") > 0, (F.col("difference") - F.col("_m")) / F.col("_s"))
    return rows.where(F.col("difference") > 0).crossJoin(F.broadcast(whole)).select(*keep, "difference", F.bround(z, 6).alias("z_score"))


def missing_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: how many of the table's rows lack it."""
    require(df, columns)
    parts = [F.struct(F.lit(c).alias("variable"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"), F.count("*").alias("n_rows")) for c in columns]
    got = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return got.select("*", F.bround(F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows").cast("double")), 4).alias("prop_missing"))


def missing_detail(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Per group and column: missing rows, where there are any."""
    parts = [F.struct(F.lit(c).alias("variable"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing")) for c in columns]
    got = df.groupBy(*groups).agg(F.count("*").alias("n_rows"), F.array(*parts).alias("p")).select(*groups, "n_rows", F.inline("p"))
    return got.where("n_missing > 0").select(*groups, "variable", "n_missing", "n_rows", F.bround(F.col("n_missing") / F.col("n_rows"), 4).alias("prop_missing"))


def duplicates(df: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows whose keys occur more than once, with how often."""
    return df.withColumn("n_copies", F.count("*").over(Window.partitionBy(*keys))).where("n_copies > 1").select(*keys, *keep, "n_copies")


def future_dates(df: DataFrame, date: str, as_of: str, keep: list[str]) -> DataFrame:
    """Rows dated on or after the first day of the month after ``as_of``'s month began, that is, later than the current month's first day."""
    return df.where(F.col(date) > F.trunc(F.to_date(F.lit(as_of)), "MM")).select(*keep, date)


def row_sum(columns: list[str], min_present: int = 1):
    """Sum of what is there, if at least ``min_present`` of the columns are; else null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(present >= min_present, total)


def difference_or(a: str, b: str, minimum: float = 0.0):
    """The absolute difference, not below the minimum; where one side is missing, the other one, not below it either."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    value = F.when(both, F.abs(F.col(a) - F.col(b))).otherwise(F.coalesce(a, b))
    return F.when(value.isNotNull(), F.greatest(value, F.lit(minimum)))
