"""Robust outlier detection, outbreak clusters and correction of flagged values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import half_even, null_safe_join, require

# Multipliers of standard deviation, median absolute deviation and interquartile range by preset.
PRESETS = {
    "lenient": (4.0, 12.0, 3.0),
    "balanced": (3.0, 9.0, 2.0),
    "strict": (2.5, 6.0, 1.5),
}
MAD_CONSTANT = 1.4826
METHODS = ("mean", "median", "iqr")
STATISTICS = ("n", "mean", "sd", "median", "q1", "q3", "mad", "iqr")
ADDED = frozenset((*STATISTICS, *(f"{m}_{x}" for m in METHODS for x in ("upper", "lower", "unstable")), *(f"flag_{m}" for m in METHODS), "flag_consensus", "reason", "strength"))
TIME_KEYS = {"across_time": [], "within_year": ["year"], "seasonal": ["month"]}


@dataclass(frozen=True)
class OutlierRule:
    """How values are judged. ``multipliers`` takes the place of the preset's."""

    preset: str = "balanced"
    multipliers: tuple[float, float, float] | None = None
    time_mode: str = "across_time"
    consensus: int = 3
    min_n: int = 8
    reporting_rate: str | None = None
    reporting_rate_min: float = 0.5
    counts: bool = True

    @property
    def widths(self) -> tuple[float, float, float]:
        return self.multipliers or PRESETS[self.preset]


def group_statistics(df: DataFrame, value: str, keys: list[str], rule: OutlierRule) -> DataFrame:
    """Per group: n, centre, spread and the bounds of the three methods; null spreads and zero spreads make a method unstable.

    The deviation from the median needs the median first, so the rows are met twice: two aggregations, one join on the keys.
    """
    v = F.col(value)
    first = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"))
    away = null_safe_join(df.select(*keys, v.alias("_v")), first.select(*keys, "median"), keys)
    second = away.groupBy(*keys).agg((F.median(F.abs(F.col("_v") - F.col("median"))) * MAD_CONSTANT).alias("mad"))
    got = null_safe_join(first, second, keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    sd, mad, iqr = rule.widths
    centre = {"mean": ("mean", "sd", "mean", sd), "median": ("median", "mad", "median", mad), "iqr": ("q3", "iqr", "q1", iqr)}
    out = {}
    for m, (top, spread, bottom, k) in centre.items():
        low = F.col(bottom) - k * F.col(spread)
        out[f"{m}_upper"] = F.col(top) + k * F.col(spread)
        out[f"{m}_lower"] = F.greatest(low, F.lit(0.0)) if rule.counts else low
        out[f"{m}_unstable"] = F.coalesce(F.col(spread) == 0, F.lit(True))
    return got.withColumns(out)


def detect_outliers(df: DataFrame, value: str, groups: list[str], rule: OutlierRule = OutlierRule(), key_indicators: list[str] | None = None) -> DataFrame:
    """Adds the group's statistics, a flag per method, their consensus and its reason.

    A guard (low reporting, then too few values) decides first; then an unstable spread; then missing evidence; then the upper
    bound. Low values are never flagged. Rows without any key indicator are dropped before, where indicators are named.
    ``strength`` is the part of the usable methods that call the value an outlier, null without any. Columns of the input that have
    the name of a column added here end in ``_input``; a key must not have one.
    """
    keys = [*groups, *TIME_KEYS[rule.time_mode]]
    require(df, [value, *keys])
    if both := ADDED.intersection(keys):
        raise ValueError(f"keys with names of statistics: {', '.join(sorted(both))}")
    names = {c: f"{c}_input" for c in df.columns if c in ADDED}
    df, value = df.withColumnsRenamed(names), names.get(value, value)
    low_rate = names.get(rule.reporting_rate, rule.reporting_rate)
    key_indicators = [names.get(c, c) for c in key_indicators or ()]
    if key_indicators:
        df = df.where(F.coalesce(*(F.col(c).cast("string") for c in key_indicators)).isNotNull())
    df = df.withColumn("_value", F.col(value).cast("double"))
    rows = null_safe_join(df, group_statistics(df, "_value", keys, rule), keys).withColumn("n", F.coalesce("n", F.lit(0)))
    guard = F.when(F.lit(False), F.lit(None).cast("string"))
    if rule.reporting_rate:
        guard = guard.when(F.col(low_rate) < rule.reporting_rate_min, "low_reporting")
    rows = rows.withColumn("guard", guard.when(F.col("n") < rule.min_n, "insufficient_n"))

    def flag(m: str) -> Column:
        upper = F.col(f"{m}_upper")
        return F.coalesce("guard", F.when(F.col(f"{m}_unstable"), "unstable_scale").when(F.col("_value").isNull() | upper.isNull(), "insufficient_evidence").when(F.col("_value") > upper, "outlier").otherwise("normal"))

    rows = rows.withColumns({f"flag_{m}": flag(m) for m in METHODS})
    usable = sum((F.when(F.col(f"flag_{m}") != "unstable_scale", 1).otherwise(0) for m in METHODS), F.lit(0))
    votes = sum((F.when(F.col(f"flag_{m}") == "outlier", 1).otherwise(0) for m in METHODS), F.lit(0))
    consensus = F.coalesce("guard", F.when(usable == 0, "insufficient_evidence").when(votes >= rule.consensus, "outlier").otherwise("normal"))
    strength = F.when(F.col("guard").isNull() & (usable > 0), votes / usable)
    return rows.withColumns({"reason": consensus, "strength": strength, "flag_consensus": simplified(consensus), **{f"flag_{m}": simplified(F.col(f"flag_{m}")) for m in METHODS}}).drop("_value", "guard")


def simplified(flag: Column) -> Column:
    """Everything that is no verdict is ``insufficient_data``."""
    return F.when(flag.isin("outlier", "normal", "outbreak"), flag).otherwise("insufficient_data")


def classify_outbreaks(df: DataFrame, flag: str, groups: list[str], order: list[str], max_gap: int = 12, min_run: int = 2) -> DataFrame:
    """Outlier rows of a group that lie near each other become ``outbreak``.

    Distance is counted in rows of the group in the given order: outliers with at most ``max_gap`` rows between them are one
    cluster, and a cluster of ``min_run`` outliers or more is an outbreak. Rows in between keep their flag.
    """
    by = Window.partitionBy(*groups)
    at = by.orderBy(*(F.asc_nulls_last(c) for c in order))
    rows = df.withColumn("_pos", F.row_number().over(at)).withColumn("_hit", F.col(flag) == "outlier")
    before = F.max(F.when(F.col("_hit"), F.col("_pos"))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.col("_hit") & (before.isNull() | (F.col("_pos") - before - 1 > max_gap))).cast("int"))
    rows = rows.withColumn("_cluster", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(*groups, "_cluster"))
    return rows.withColumn(flag, F.when(F.col("_hit") & (size >= min_run), "outbreak").otherwise(F.col(flag))).drop("_pos", "_hit", "_new", "_cluster")


def correct_outliers(df: DataFrame, target: str, consistency: str, flag: str, groups: list[str], order: list[str]) -> DataFrame:
    """Puts the middle of the two neighbours, rounded half to even, in the place of an outlier, if both are there and it does not exceed the consistency value."""
    at = Window.partitionBy(*groups).orderBy(*(F.asc_nulls_last(c) for c in order))
    before, after = F.lag(target).over(at), F.lead(target).over(at)
    rows = df.withColumns({"_a": before, "_b": after}).withColumn("_mid", half_even((F.col("_a") + F.col("_b")) / 2))
    out = F.when(F.col(flag) != "outlier", "not_outlier").when(F.col("_a").isNull() | F.col("_b").isNull(), "missing_neighbors").when(F.col("_mid") > F.col(consistency), "failed_consistency").otherwise("corrected")
    rows = rows.withColumn("correction_flag", out)
    value = F.when(F.col("correction_flag") == "corrected", F.col("_mid")).when(F.col("correction_flag") == "failed_consistency", F.lit(None)).otherwise(F.col(target))
    return rows.withColumn(f"{target}_corrected", value).drop("_a", "_b", "_mid")


def impute_moving_average(df: DataFrame, value: str, threshold: str, groups: list[str], order: list[str]) -> DataFrame:
    """Values above their threshold become the mean of those neighbours that do not exceed it; without one they stay."""
    at = Window.partitionBy(*groups).orderBy(*(F.asc_nulls_last(c) for c in order))
    limit = F.col(threshold)
    near = [F.when(x <= limit, x) for x in (F.lag(value).over(at), F.lead(value).over(at))]
    rows = df.withColumns({"_a": near[0], "_b": near[1]})
    known = F.when(F.col("_a").isNotNull(), 1).otherwise(0) + F.when(F.col("_b").isNotNull(), 1).otherwise(0)
    mean = (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / F.when(known > 0, known)
    return rows.withColumn(f"{value}_imputed", F.when((F.col(value) > limit) & mean.isNotNull(), half_even(mean)).otherwise(F.col(value))).drop("_a", "_b")


def correct_with_neighbours(df: DataFrame, target: str, consistency: str, flag: str, groups: list[str], order: list[str], k: int = 5, direction: str = "lte", consistency_flag: str | None = None) -> DataFrame:
    """Rows of ``target`` flagged as outliers, with the rounded median of up to k neighbours on both sides.

    Rows whose consistency value is an outlier too, by ``consistency_flag``, are left out: both may have risen for a reason.

    No correction where one side has no neighbour, or where the median breaks the cascade with the consistency value (lte: it must
    not be larger; gte: not smaller); a null consistency value breaks nothing.
    """
    at = Window.partitionBy(*groups).orderBy(*(F.asc_nulls_last(c) for c in order))
    rows = df.withColumns({"_l": F.collect_list(target).over(at.rowsBetween(-k, -1)), "_r": F.collect_list(target).over(at.rowsBetween(1, k))}).where(F.col(flag) == "outlier")
    if consistency_flag:
        rows = rows.where(~F.col(consistency_flag).eqNullSafe(F.lit("outlier")))
    both = F.array_sort(F.concat("_l", "_r"))
    n = F.size(both)
    middle = half_even((F.element_at(both, F.floor((n + 1) / 2).cast("int")) + F.element_at(both, F.floor((n + 2) / 2).cast("int"))) / 2)
    lonely = (F.size("_l") == 0) | (F.size("_r") == 0)
    rows = rows.withColumn("median", F.when(~lonely, middle))
    broken = F.coalesce(F.col("median") > F.col(consistency) if direction == "lte" else F.col("median") < F.col(consistency), F.lit(False))
    status = F.when(lonely, "no_neighbours").when(broken, "inconsistent").otherwise("corrected")
    return rows.withColumn("status", status).withColumn("corrected", F.when(F.col("status") == "corrected", F.col("median"))).drop("_l", "_r")


def correction_summary(corrected: DataFrame) -> DataFrame:
    """Per status of ``correct_with_neighbours``: rows, their part of all in percent, and the sum of the corrected values."""
    got = corrected.groupBy("status").agg(F.count("*").alias("n"), F.sum("corrected").alias("sum_corrected"))
    whole = corrected.agg(F.count("*").alias("_all"))
    return got.crossJoin(F.broadcast(whole)).select("status", "n", F.bround(100 * F.col("n") / F.col("_all"), 2).alias("pct"), "sum_corrected")
