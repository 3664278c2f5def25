"""Small rules that decide results: nulls, rounding, order, null-safe joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375  # a duration month


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Round halves to the even neighbour."""
    return F.bround(F.col(x) if isinstance(x, str) else x, digits)


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so it becomes null at the door."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which null keys meet null keys; the right side's keys are dropped."""
    other = right.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(other, on, how).drop(*(f"__{k}" for k in keys))


def many_to_one_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``null_safe_join`` that fails where the right side has more than one row of a key (as checked when the plan runs)."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    said = F.concat(F.lit("more than one row of the key "), F.to_json(F.struct(*keys)))
    checked = right.withColumn("__one", F.when(twice, F.raise_error(said).cast("boolean")).otherwise(True))
    return null_safe_join(left, checked, keys, how).where("__one is null or __one").drop("__one")


def separate(df: DataFrame, column: str, into: list[str], sep: str, extra: str = "merge") -> DataFrame:
    """Splits a text column at a separator (plain text) into columns in its place; missing parts are null.

    What lies beyond the last column stays in it (``merge``) or is left out (``drop``). Columns of those names are replaced.
    """
    if extra not in ("merge", "drop"):
        raise ValueError("extra is merge or drop")
    parts = F.split(F.col(column), F.lit("\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"), len(into) if extra == "merge" else -1)
    made = [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(into)]
    out = []
    for c in df.columns:
        out += made if c == column else [] if c in into else [F.col(f"`{c}`")]
    return df.select(*out)


def short_number(x: Column | str, digits: int = 1) -> Column:
    """1234 as 1.2K and 5600000 as 5.6M; smaller numbers as whole ones; null stays null."""
    c = F.col(x) if isinstance(x, str) else x
    text = lambda v, unit: F.concat(F.regexp_replace(F.format_string(f"%.{digits}f", v), r"\.0+$", ""), F.lit(unit))
    v = c.cast("double")
    return F.when(F.abs(v) >= 1e6, text(v / 1e6, "M")).when(F.abs(v) >= 1e3, text(v / 1e3, "K")).when(v.isNotNull(), F.format_string("%.0f", v))


def big_mark(x: Column | str, digits: int = 0) -> Column:
    """A number with commas between thousands."""
    return F.format_number(F.col(x) if isinstance(x, str) else x, digits)


def distinct_with_null(x: Column | str) -> Column:
    """Distinct values, null counting as one."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.count_distinct(c) + F.max(c.isNull().cast("long"))).cast("long")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def month(x: Column | str) -> Column:
    return F.trunc(x, "MM")


def rate(part: Column, whole: Column) -> Column:
    """part / whole where whole is positive, else null."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def require(df: DataFrame, columns: list[str]) -> None:
    """Fails early, by the names, where columns are missing."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
