"""The validation report of a facility panel: its checks as one bundle of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import activity, outliers, quality, typing
from .activity import Roles


@dataclass(frozen=True)
class ValidationReport:
    """Each part is a plan of its own; nothing runs before it is asked for."""

    missing: DataFrame
    missing_detail: DataFrame
    duplicate_records: DataFrame
    duplicate_keys: DataFrame
    future_dates: DataFrame
    consistency: DataFrame
    outliers: DataFrame
    corrections: DataFrame
    activity: DataFrame
    episodes: DataFrame
    dictionary: DataFrame


def validate(df: DataFrame, roles: Roles, indicators: list[str], pairs: list[tuple[str, str]], as_of: str, rule: outliers.OutlierRule = outliers.OutlierRule(consensus=1)) -> ValidationReport:
    """Runs every check over the panel. Outliers of all indicators come from one long table, so one pass serves them."""
    yearly = df.withColumn("year", F.year(roles.date))
    long = yearly.select(roles.record_id, roles.hf, roles.date, "year", F.month(roles.date).alias("month"), *(F.col(c).cast("double").alias(c) for c in indicators)).unpivot([roles.record_id, roles.hf, roles.date, "year", "month"], indicators, "variable", "value")
    found = outliers.detect_outliers(long, "value", [roles.hf, "variable"], rule)
    fixed = outliers.correct_with_neighbours(found.withColumn("_limit", F.lit(None).cast("double")), "value", "_limit", "flag_consensus", [roles.hf, "variable"], [roles.date, roles.record_id])
    return ValidationReport(
        missing=quality.missing_table(df, indicators),
        missing_detail=quality.missing_detail(yearly, indicators, [*roles.admins, "year"]),
        duplicate_records=quality.duplicates(df, [roles.record_id], []),
        duplicate_keys=quality.duplicates(df, [roles.hf, roles.date], [roles.record_id]),
        future_dates=quality.future_dates(df, roles.date, as_of, [roles.record_id]),
        consistency=quality.consistency_pairs(df, pairs),
        outliers=found.select(roles.record_id, roles.hf, roles.date, "variable", "value", "flag_consensus", "reason"),
        corrections=fixed.select(roles.record_id, "variable", "value", "median", "status", "corrected"),
        activity=activity.classify_activity(df, roles, indicators),
        episodes=activity.activity_episodes(df, roles, indicators),
        dictionary=typing.profile(df),
    )
