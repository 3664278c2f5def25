"""A catalogue of SQL views over partitioned parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def survey_view(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All files of one kind under root/kind (a folder or one file): columns united by name, folders like key=value as columns, the file of each row as ``filename``; files that cannot be read are skipped."""
    df = spark.read.options(mergeSchema=True, ignoreCorruptFiles=True, basePath=root).parquet(f"{root}/{kind}")
    return df.withColumn("filename", F.col("_metadata.file_path"))


def register_views(spark: SparkSession, root: str, kinds: list[str]) -> dict[str, DataFrame]:
    """Registers a temporary view per kind, under its name in small letters and without a file's extension."""
    out = {}
    for kind in kinds:
        df = survey_view(spark, root, kind)
        name = kind.lower().removesuffix(".parquet")
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def describe(spark: SparkSession, views: dict[str, DataFrame], keys: tuple[str, ...] = ("country_code", "survey_year", "survey_id")) -> DataFrame:
    """One row per view: rows, columns, and which of the usual partition keys it has."""
    parts = None
    for name, df in sorted(views.items()):
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("view"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.array(*(F.lit(k) for k in keys if k in df.columns)).cast("array<string>").alias("keys"))
        parts = row if parts is None else parts.unionByName(row)
    return parts
