"""Types from text, dates in many orders, profiles of tables, renaming by dictionary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = r"(?i)(^|_)(id|code|uid|guid|phone|tel)($|_)"
# Orders in which dates are tried, first match wins.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "yyyyMMdd", "dd.MM.yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyy-MM", "MM-yyyy")


def parse_date(x: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """A date by the first format that reads it; a text with a T is tried as a timestamp first."""
    c = F.trim(F.col(x) if isinstance(x, str) else x)
    stamp = F.when(c.contains("T"), F.to_date(F.try_to_timestamp(c)))
    return F.coalesce(stamp, *(F.try_to_date(c, f) for f in formats))


def distinct_counts(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(name, n_unique): distinct values per column, nulls apart. Columns become rows, so one distinct aggregation serves them all."""
    long = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).unpivot([], [F.col(f"`{c}`") for c in columns], name, "value")
    return long.groupBy(name).agg(F.count_distinct("value").alias("n_unique"))


def type_plan(df: DataFrame, max_levels: int = 20, max_ratio: float = 0.05, protected: str = PROTECTED) -> DataFrame:
    """One row per text column: the type that all its values take. One pass over the table, and one for distinct values.

    Protected names and numbers with leading zeros stay text. What parses as nothing else and has few distinct values is a factor.
    """
    cols = [c for c, kind in df.dtypes if kind == "string"]
    parts = []
    for c in cols:
        x = F.trim(F.col(f"`{c}`"))
        fits = lambda cond: F.count(F.when(F.col(f"`{c}`").isNotNull() & ~F.coalesce(cond, F.lit(False)), 1)) == 0  # noqa: B023, E731
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(f"`{c}`").alias("n"),
                fits(F.lower(x).isin("true", "false", "t", "f")).alias("logical"),
                fits(x.rlike("^[+-]?[0-9]{1,10}$") & x.try_cast("int").isNotNull()).alias("integer"),
                fits(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & x.try_cast("double").isNotNull()).alias("double"),
                fits(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()).alias("date"),
                fits(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:") & x.try_cast("timestamp_ntz").isNotNull()).alias("datetime"),
                (F.count(F.when(x.rlike("^0+[0-9]+$"), 1)) > 0).alias("leading_zeros"),
                F.lit(bool(re.search(protected, c))).alias("protected"),
            )
        )
    got = df.agg(F.array(*parts).alias("p")).select(F.inline("p")).join(distinct_counts(df, cols, "column"), "column")
    few = (F.col("n_unique") <= max_levels) & (F.col("n_unique") <= F.greatest(F.lit(1.0), max_ratio * F.col("n")))
    kind = F.when(F.col("n") == 0, "character").when(F.col("protected") | F.col("leading_zeros"), "character").when(F.col("logical"), "logical").when(F.col("integer"), "integer").when(F.col("double"), "double").when(F.col("date"), "date").when(F.col("datetime"), "datetime").when(few, "factor").otherwise("character")
    return got.select("column", "n", "n_unique", kind.alias("type"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, distinct values (null counts as one), least and greatest as text. One pass over the table, and one for distinct values."""
    parts = []
    for c, kind in df.dtypes:
        ordered = kind in ("int", "bigint", "double", "float", "date", "timestamp", "timestamp_ntz")
        null = F.lit(None).cast("string")
        parts.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.lit(kind).alias("type"),
                F.count("*").alias("n"),
                F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"),
                (F.min(c).cast("string") if ordered else null).alias("min"),
                (F.max(c).cast("string") if ordered else null).alias("max"),
            )
        )
    got = df.agg(F.array(*parts).alias("p")).select(F.inline("p")).join(distinct_counts(df, df.columns, "variable"), "variable")
    unique = (F.col("n_unique") + F.when(F.col("n_missing") > 0, 1).otherwise(0)).alias("n_unique")
    return got.select("variable", "type", "n", "n_missing", F.bround(100 * F.try_divide(F.col("n_missing"), F.col("n")), 2).alias("pct_missing"), unique, "min", "max")


def rename_by_dictionary(df: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """Renames raw headers to harmonised ones; headers are compared without case, accents, punctuation and repeated spaces; the first match wins."""
    import unicodedata

    def plain(s: str) -> str:
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[\W_]+", " ", s).lower().split())

    known: dict[str, str] = {}
    for raw, name in dictionary.items():
        known.setdefault(plain(raw), name)
    taken: set[str] = set()
    out = []
    for c in df.columns:
        name = known.get(plain(c), c)
        name = c if name in taken else name
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def examples(df: DataFrame, columns: list[str], n: int = 3, width: int = 60) -> DataFrame:
    """(variable, examples): the n most frequent values of each column as text, ties by value, cut to ``width`` characters with dots; empty without values.

    Columns become rows; values are counted before they are ranked, and only n of a variable leave a task.
    """
    long = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).unpivot([], [F.col(f"`{c}`") for c in columns], "variable", "value")
    some = long.where("value is not null").groupBy("variable", "value").agg(F.count("*").alias("k"))
    order = Window.partitionBy("variable").orderBy(F.desc("k"), "value")
    top = some.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda r: r["value"]), ", ")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    whole = names.join(top.groupBy("variable").agg(text.alias("t")), "variable", "left").withColumn("t", F.coalesce("t", F.lit("")))
    return whole.select("variable", F.when(F.length("t") > width, F.concat(F.substring("t", 1, width - 3), F.lit("..."))).otherwise(F.col("t")).alias("examples"))


# Names of the months by language.
MONTH_NAMES = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "pt": ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}


def month_label(date: Column | str, language: str = "en") -> Column:
    """The month's name in a language and the year; null dates stay null."""
    c = F.col(date) if isinstance(date, str) else date
    return F.concat(F.element_at(F.array(*map(F.lit, MONTH_NAMES[language])), F.month(c)), F.lit(" "), F.year(c).cast("string"))
