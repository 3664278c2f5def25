"""Reporting rates: who reported, of those expected to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import all_of, any_of, null_safe_join, rate, require
from .activity import Roles, active_spans


def active_rows(df: DataFrame, roles: Roles, key_indicators: list[str], method: int = 3, window: int = 6) -> DataFrame:
    """Rows of months in which their facility is active; all rows where no key indicator is named."""
    if not key_indicators:
        return df
    spans = active_spans(df, roles, key_indicators, method, window).select(F.col("hf").alias("_hf"), F.col("start_month").alias("_from"), F.col("end_month").alias("_to"))
    return df.join(spans, (F.col(roles.hf) == F.col("_hf")) & F.trunc(roles.date, "MM").between(F.col("_from"), F.col("_to")), "left_semi")


def _with_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    share = rate(F.col("rep"), F.col("exp"))
    return df.select(*keys, "rep", "exp", F.bround(share, 6).alias("reprate"), F.bround(1 - share, 6).alias("missrate"))


def _group(x: str, y: str | None) -> list[str]:
    return [x, y] if y else [x]


def _facility_rates(df: DataFrame, keys: list[str], hf: str, given: dict[str, Column]) -> DataFrame:
    """``exp`` and a count for each condition: distinct facilities with a row, and with one that meets it; one row per facility first, nulls not counted."""
    one = df.groupBy(*keys, hf).agg(*(F.bool_or(c).alias(f"_given{i}") for i, c in enumerate(given.values())))
    known = F.col(hf).isNotNull()
    return one.groupBy(*keys).agg(F.count(hf).alias("exp"), *(F.count(F.when(known & F.col(f"_given{i}"), 1)).alias(name) for i, name in enumerate(given)))


def rate_per_variable(df: DataFrame, variables: list[str], x: str, roles: Roles, y: str | None = None, key_indicators: list[str] | None = None, method: int = 3, window: int = 6) -> DataFrame:
    """For each variable: distinct facilities with a value, of distinct facilities with a row."""
    require(df, [x, roles.hf, *variables])
    rows = active_rows(df, roles, key_indicators or variables, method, window)
    keys = _group(x, y)
    out = _facility_rates(rows, keys, roles.hf, {f"_n{i}": F.col(v).isNotNull() for i, v in enumerate(variables)})
    counts = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"_n{i}").alias("rep")) for i, v in enumerate(variables)))
    return _with_rates(out.select(*keys, "exp", F.inline(counts)), [*keys, "variable"])


def _given(variables: list[str], require_all: bool) -> Column:
    return (all_of if require_all else any_of)([F.col(v).isNotNull() for v in variables])


def rate_combined(df: DataFrame, variables: list[str], x: str, roles: Roles, y: str | None = None, require_all: bool = False, key_indicators: list[str] | None = None, method: int = 3, window: int = 6) -> DataFrame:
    """Distinct facilities with any (or all) of the variables in a row, of distinct facilities with a row."""
    rows = active_rows(df, roles, key_indicators or variables, method, window)
    keys = _group(x, y)
    return _with_rates(_facility_rates(rows, keys, roles.hf, {"rep": _given(variables, require_all)}), keys)


def rate_of_rows(df: DataFrame, variables: list[str], x: str, y: str | None = None) -> DataFrame:
    """Rows with a value of all rows, by variable; without facilities."""
    keys = _group(x, y)
    long = df.select(*keys, *(F.col(v).cast("double").alias(v) for v in variables)).unpivot(keys, variables, "variable", "value")
    out = long.groupBy(*keys, "variable").agg(F.count("value").alias("rep"), F.count("*").alias("exp"))
    return _with_rates(out, [*keys, "variable"])


def rate_weighted(df: DataFrame, variables: list[str], weight_var: str, x: str, y: str, roles: Roles, include_current: bool = False, before: int = 12, cold_start: str = "group", key_indicators: list[str] | None = None, method: int = 3, window: int = 6) -> DataFrame:
    """Rate in which facilities count by their typical size.

    A row's typical size is the mean of the weight variable over the facility's ``before`` rows before it (in order of date and
    record id; with it, if so asked). Where there is none, it is the median of its y (or of all). Weights are normalised within
    (x, y) over all facilities, before inactive ones are left out.
    """
    order = Window.partitionBy(roles.hf).orderBy(F.asc_nulls_last(roles.date), F.asc_nulls_last(roles.record_id))
    frame = order.rowsBetween(-(before - 1), 0) if include_current else order.rowsBetween(-before, -1)
    sized = df.withColumn("_typ", F.avg(weight_var).over(frame))
    whole = sized.agg(F.median("_typ").alias("_all"))
    if cold_start == "group":
        group = sized.groupBy(y).agg(F.median("_typ").alias("_med"))
        sized = sized.join(group, y).withColumn("_typ", F.coalesce("_typ", "_med")).drop("_med")
    sized = sized.crossJoin(F.broadcast(whole)).withColumn("_typ", F.coalesce("_typ", "_all")).drop("_all")
    sized = null_safe_join(sized, sized.groupBy(x, y).agg(F.sum("_typ").alias("_total")), [x, y])
    sized = sized.withColumn("_w", F.when(F.col("_total") > 0, F.col("_typ") / F.col("_total")).otherwise(0.0)).drop("_total")
    rows = active_rows(sized, roles, key_indicators or variables, method, window)
    one = rows.groupBy(x, y, roles.hf).agg(F.bool_or(_given(variables, False)).alias("given"), F.avg("_w").alias("w"), F.avg(weight_var).alias("size"))
    got = one.groupBy(x, y).agg(
        F.sum(F.col("given").cast("long")).alias("rep"),
        F.count("*").alias("exp"),
        (F.sum(F.when(F.col("given"), F.col("w")).otherwise(0.0)) / F.when(F.sum("w") > 0, F.sum("w"))).alias("wr"),
        F.bround(F.avg("size"), 4).alias("avg_size"),
        F.min("size").alias("lo"),
        F.max("size").alias("hi"),
    )
    share = rate(F.col("rep"), F.col("exp"))
    return got.select(x, y, "rep", "exp", F.bround(share, 6).alias("reprate"), F.bround(1 - share, 6).alias("missrate"), F.bround("wr", 6).alias("reprate_w"), F.bround(1 - F.col("wr"), 6).alias("missrate_w"), "avg_size", F.bround("lo", 4).alias("min_size"), F.bround("hi", 4).alias("max_size"))


def rate_by_dates(df: DataFrame, variable: str, x: str, roles: Roles, opening: str, closing: str, y: str | None = None) -> DataFrame:
    """Facilities count from their opening to their closing date, both included; a null bound is open."""
    inside = (F.col(opening).isNull() | (F.col(roles.date) >= F.col(opening))) & (F.col(closing).isNull() | (F.col(roles.date) <= F.col(closing)))
    keys = _group(x, y)
    return _with_rates(_facility_rates(df.where(inside), keys, roles.hf, {"rep": F.col(variable).isNotNull()}), keys)


def active_share_by_dates(df: DataFrame, x: str, roles: Roles, opening: str, closing: str, y: str | None = None) -> DataFrame:
    """Rows with their status by dates and the share of active rows in their group.

    A row is active if its date lies from opening to closing, both included; a missing bound leaves its status unknown (null), and
    unknown rows count in the group but not as active.
    """
    inside = (F.col(roles.date) >= F.col(opening)) & (F.col(roles.date) <= F.col(closing))
    by = Window.partitionBy(*_group(x, y))
    active = F.sum(F.when(inside, 1).otherwise(0)).over(by)
    return df.withColumns({"status": F.when(inside, "Active").when(~inside, "Inactive"), "n_active": active.cast("long"), "n_rows": F.count("*").over(by)}).withColumn("active_share", F.bround(F.col("n_active") / F.col("n_rows"), 6))
