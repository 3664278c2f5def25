"""Population roll-up, extrapolation, growth, and trend projection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roll_up(df: DataFrame, levels: list[str], year: str, columns: list[str]) -> DataFrame:
    """Sums at every level of the hierarchy: one row per (level, names down to it, year). A year like 2021-05 counts as 2021."""
    base = df.withColumn("year", F.substring(F.col(year).cast("string"), 1, 4).cast("int"))
    parts = []
    for i, level in enumerate(levels):
        names = [F.col(c) if k <= i else F.lit(None).cast("string").alias(c) for k, c in enumerate(levels)]
        parts.append(base.groupBy(*levels[: i + 1], "year").agg(*(F.sum(c).alias(c) for c in columns)).select(F.lit(level).alias("level"), *names, "year", *columns))
    return reduce(DataFrame.unionByName, parts)


def shares(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Each row's part of its group's sum; null where that is zero."""
    whole = F.sum(value).over(Window.partitionBy(*groups))
    return df.withColumn("share", F.when(whole != 0, F.bround(F.col(value) / whole, 6)))


def mean_growth(df: DataFrame, groups: list[str], year: str, value: str) -> DataFrame:
    """The mean of year-over-year ratios of consecutive known years, pooled over groups; 1.02 where there is none."""
    by = Window.partitionBy(*groups).orderBy(year)
    ratio = F.when((F.lag(value).over(by) > 0) & (F.col(year) - F.lag(year).over(by) == 1), F.col(value) / F.lag(value).over(by))
    return df.where(F.col(value).isNotNull()).withColumn("r", ratio).agg(F.coalesce(F.avg("r"), F.lit(1.02)).alias("growth"), F.count("r").alias("n_ratios"))


def extrapolate(df: DataFrame, groups: list[str], year: str, value: str, targets: list[int], growth: float | dict[int, float] = 1.02) -> DataFrame:
    """Fills the target years of each group from its nearest known year (the earlier on ties), by the growth of each year between.

    Years are filled from left to right and each filled year is known from then on; values are rounded half to even at each step.
    The grid runs from the first to the last of known and target years.
    """
    rate = (lambda y: growth.get(y, next(iter(growth.values())))) if isinstance(growth, dict) else (lambda y: growth)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), f"`{year}` int", f"`{value}` double", "filled boolean"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {int(y): float(v) for y, v in zip(pdf[year], pdf[value]) if pd.notna(v) and pd.notna(y)}
        ys = [int(y) for y in pdf[year].dropna()] + targets
        out = []
        for y in range(min(ys), max(ys) + 1):
            filled = False
            if y not in known and y in targets and known:
                a = min(known, key=lambda k: (abs(k - y), k))
                factor = float(np.prod([rate(k) for k in range(min(a, y) + 1, max(a, y) + 1)]))
                known[y] = float(np.round(known[a] * factor if a < y else (known[a] / factor if factor else 0.0)))
                filled = True
            out.append((*(pdf[g].iloc[0] for g in groups), y, known.get(y), filled))
        return pd.DataFrame(out, columns=[*groups, year, value, "filled"])

    return df.select(*groups, F.col(year).cast("int").alias(year), F.col(value).cast("double").alias(value)).groupBy(*groups).applyInPandas(fill, schema)


def trend_constant(df: DataFrame, groups: list[str], year: str, value: str, cut: int, years: list[int]) -> DataFrame:
    """Rows up to the cut, and the given years with the last value carried on."""
    kept = df.where(F.col(year) <= cut).select(*groups, F.col(year).cast("int").alias(year), F.col(value).cast("double").alias(value))
    more = kept.select(*groups).distinct().select(*groups, F.explode(F.array(*(F.lit(int(y)) for y in years))).alias(year)).withColumn(value, F.lit(None).cast("double"))
    by = Window.partitionBy(*groups).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return kept.unionByName(more).withColumn(value, F.last(value, ignorenulls=True).over(by))


def trend_linear(df: DataFrame, groups: list[str], year: str, value: str, start: int, years: list[int]) -> DataFrame:
    """A line through the rows from the start year on, at the given years, not below 0. The fit is an aggregation."""
    fit = df.where(F.col(year) >= start).groupBy(*groups).agg(F.regr_slope(value, year).alias("_b"), F.regr_intercept(value, year).alias("_a"))
    out = fit.select(*groups, "_a", "_b", F.explode(F.array(*(F.lit(int(y)) for y in years))).alias(year))
    return out.select(*groups, year, F.greatest(F.col("_a") + F.col("_b") * F.col(year), F.lit(0.0)).alias(value))


def trend_logistic(df: DataFrame, groups: list[str], year: str, value: str, start: int, years: list[int], steps: int = 50) -> DataFrame:
    """A logistic curve by iteratively reweighted least squares, for values between 0 and 1."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), f"`{year}` int", f"`{value}` double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[(pdf[year] >= start) & pdf[value].notna()]
        x, y = d[year].to_numpy(float), d[value].to_numpy(float)
        out = np.full(len(years), np.nan)
        if len(d):
            m = x.mean()
            X = np.column_stack((np.ones(len(x)), x - m))
            b = np.zeros(2)
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
                w = np.maximum(p * (1 - p), 1e-10)
                new = np.linalg.lstsq(X * np.sqrt(w)[:, None], (X @ b + (y - p) / w) * np.sqrt(w), rcond=None)[0]
                done, b = np.abs(new - b).max() < 1e-10, new
                if done:
                    break
            out = 1 / (1 + np.exp(-(b[0] + b[1] * (np.array(years) - m))))
        return pd.DataFrame([(*(pdf[g].iloc[0] for g in groups), int(y), float(v)) for y, v in zip(years, out)], columns=[*groups, year, value])

    return df.groupBy(*groups).applyInPandas(fit, schema)


def trend_hybrid(a: DataFrame, b: DataFrame, groups: list[str], year: str, value: str) -> DataFrame:
    """The mean of two projections by group and year."""
    return a.select(*groups, year, value).unionByName(b.select(*groups, year, value)).groupBy(*groups, year).agg(F.avg(value).alias(value))


def filled(df: DataFrame, value: str, groups: list[str], order: list[str], direction: str = "downup") -> DataFrame:
    """Nulls of a column take the last value before them in the group (``down``), the next after them (``up``), or the one where the other is missing (``downup``, ``updown``)."""
    by = Window.partitionBy(*groups).orderBy(*(F.asc_nulls_last(c) for c in order))
    down = F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first(value, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, {"down": down, "up": up, "downup": F.coalesce(down, up), "updown": F.coalesce(up, down)}[direction])
