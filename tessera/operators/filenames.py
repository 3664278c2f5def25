"""Times in file names, and file names without the numbers they all share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = r"(?<!\d)(19[89]\d|20\d{2})(?!\d)"
MONTHLY = (r"(?<!\d)(0[1-9]|1[0-2])[-_.](19[89]\d|20\d{2})(?!\d)", r"(?<!\d)(19[89]\d|20\d{2})[-_.]?(0[1-9]|1[0-2])(?!\d)")
DAILY = r"(?<!\d)(19[89]\d|20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])(?!\d)"


def _base(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def time_components(name: Column | str) -> list[Column]:
    """year, month, semester, quarter and first date of a file name; without a month the last plausible year counts."""
    x = _base(F.col(name) if isinstance(name, str) else name)
    first, second = (F.regexp_extract(x, p, 0) != "" for p in MONTHLY)
    month = F.when(first, F.regexp_extract(x, MONTHLY[0], 1)).when(second, F.regexp_extract(x, MONTHLY[1], 2)).try_cast("int")
    last = F.element_at(F.regexp_extract_all(x, F.lit(YEAR), F.lit(1)), -1)
    some = F.size(F.regexp_extract_all(x, F.lit(YEAR), F.lit(1))) > 0
    year = F.when(first, F.regexp_extract(x, MONTHLY[0], 2)).when(second, F.regexp_extract(x, MONTHLY[1], 1)).when(some, last).try_cast("int")
    return [year.alias("year"), month.alias("month"), F.ceil(month / 6).cast("int").alias("semester"), F.ceil(month / 3).cast("int").alias("quarter"), F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1)).alias("date")]


def time_pattern(names: DataFrame, name: str) -> DataFrame:
    """One row: how many names look daily, monthly, yearly, and the pattern that all of them have, if one does."""
    x = _base(F.col(name))
    hits = {"daily": x.rlike(DAILY), "monthly": x.rlike(MONTHLY[0]) | x.rlike(MONTHLY[1]), "yearly": x.rlike(YEAR)}
    got = names.agg(F.count("*").alias("n_files"), *(F.count(F.when(h, 1)).alias(f"n_{k}") for k, h in hits.items()))
    which = F.when(F.col("n_files") == 0, F.lit(None))
    for k in hits:
        which = which.when(F.col(f"n_{k}") == F.col("n_files"), k)
    return got.select("*", which.alias("pattern"))


def cleaned_names(names: DataFrame, name: str) -> DataFrame:
    """Adds ``cleaned``: numbers that occur in more than half of the names (years apart) are dropped, and separators tidied.

    How often a number occurs is an aggregation; what is common is one row, met by every name.
    """
    numbers = r"(?<![A-Za-z\d])\d+(?![A-Za-z\d])"
    base = names.withColumn("_b", _base(F.col(name)))
    n = names.agg(F.count("*").alias("_n"))
    often = base.select(F.explode(F.regexp_extract_all("_b", F.lit(numbers), F.lit(0))).alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    common = often.crossJoin(F.broadcast(n)).where((F.col("c") > F.col("_n") / 2) & ~F.col("k").rlike(r"^(19[89]\d|20\d{2})$")).agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("_k"))
    rows = base.crossJoin(F.broadcast(common))
    stripped = F.when(F.col("_k") == "", F.col("_b")).otherwise(F.regexp_replace(F.col("_b"), F.concat(F.lit(r"(?<![A-Za-z\d])("), F.col("_k"), F.lit(r")(?![A-Za-z\d])")), F.lit("")))
    tidy = stripped
    for pattern, to in ((r"_{2,}", "_"), (r"_+\.|\._+", "."), (r"\.{2,}", "."), (r"-+", "-"), (r"^[_.]+|[_.]+$", "")):
        tidy = F.regexp_replace(tidy, pattern, to)
    folder, end = F.regexp_extract(F.col(name), r"^(.*/)", 1), F.regexp_extract(F.col(name), r"(\.[^./]*)$", 1)
    return rows.withColumn("cleaned", F.when(F.col("_k") == "", F.col(name)).otherwise(F.concat(folder, tidy, end))).drop("_b", "_k")
