"""Facility activity: which facilities are active in which month, by three rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import DAYS_PER_MONTH, any_of, month, require

INACTIVE, REPORTING, SILENT = "Inactive", "Active Reporting", "Active – Not Reporting"
METHODS = ("method1", "method2", "method3")


@dataclass(frozen=True)
class Roles:
    """Which columns of a table play the parts of a facility panel."""

    hf: str = "hf"
    date: str = "date"
    record_id: str = "record_id"
    admins: tuple[str, ...] = field(default=("adm1", "adm2"))


def reported(indicators: list[str], positive_only: bool = False) -> Column:
    """Whether any indicator was given (and lies above zero, if asked)."""
    tests = [F.col(c).isNotNull() & (F.col(c) > 0) if positive_only else F.col(c).isNotNull() for c in indicators]
    return F.coalesce(any_of(tests), F.lit(False))


def _facilities(df: DataFrame, roles: Roles, indicators: list[str], positive_only: bool = False) -> DataFrame:
    """(hf, lo, hi, n, at): one row per facility, with the table's first and last month and their number, and the facility's months with a report as numbers from 0.

    A month's report is that of its first row by record id. Rows are dealt by facility once; the number of parts is given, as parts
    merged by their bytes would hold many facilities, whose rows pack well, at a time.
    """
    require(df, [roles.hf, roles.date, roles.record_id, *indicators])
    rows = df.select(F.col(roles.hf).alias("hf"), month(roles.date).alias("month"), F.col(roles.record_id).alias("rid"), reported(indicators, positive_only).alias("r")).where("hf is not null and month is not null")
    bounds = rows.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))  # one row
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = rows.repartition(parts, "hf").groupBy("hf", "month").agg(F.min_by("r", "rid").alias("r"))
    per = first.groupBy("hf").agg(F.collect_list(F.when(F.col("r"), F.col("month"))).alias("at")).crossJoin(F.broadcast(bounds))
    number = lambda m: 12 * (F.year(m) - F.year("lo")) + F.month(m) - F.month("lo")
    return per.select("hf", "lo", "hi", (number(F.col("hi")) + 1).alias("n"), F.sort_array(F.transform("at", number)).alias("at"))


def _reports(df: DataFrame, roles: Roles, indicators: list[str], positive_only: bool = False) -> DataFrame:
    """(hf, lo, hi, first_report, last_report, parts): one row per facility; the parts cover its months as (start, stop, report), in numbers from 0.

    A part begins with a report and ends before the next; what lies before the first is a part without one. The stop lies beyond.
    """
    got = _facilities(df, roles, indicators, positive_only).withColumn("ends", F.concat("at", F.array("n")))
    part = lambda start, stop, report: F.struct(start.alias("start"), stop.alias("stop"), F.lit(report).alias("report"))
    since = F.transform("at", lambda p, k: part(p, F.get("ends", k + 1), True))
    head = part(F.lit(0), F.get("ends", F.lit(0)), False)
    report = lambda k: F.add_months("lo", F.try_element_at("at", F.lit(k)))
    return got.select("hf", "lo", "hi", report(1).alias("first_report"), report(-1).alias("last_report"), F.when(head["stop"] > 0, F.concat(F.array(head), since)).otherwise(since).alias("parts"))


def _cell(i: Column, start: Column, stop: Column, report: Column) -> tuple[Column, Column, Column]:
    """Month, whether it has a report, and the silent months of its part, for the number of a month in a part."""
    return F.add_months("lo", i), report & (i == start), stop - start - 1


def _months(df: DataFrame, roles: Roles, indicators: list[str], positive_only: bool = False) -> DataFrame:
    """A row per facility and month, beside the facility's columns: month, r, silent."""
    got = _reports(df, roles, indicators, positive_only).select("hf", "lo", "hi", "first_report", "last_report", F.inline("parts"))
    got = got.select("*", F.explode(F.sequence("start", F.col("stop") - 1)).alias("_i"))
    cell = _cell(*map(F.col, ("_i", "start", "stop", "report")))
    return got.select("hf", "hi", "first_report", "last_report", *(c.alias(name) for c, name in zip(cell, ("month", "r", "silent"))))


def _statuses(month: Column, r: Column, silent: Column, window: int) -> dict[str, Column]:
    """The status of a month by each method, beside the facility's columns."""
    before = F.col("first_report").isNull() | (month < F.col("first_report"))
    gap = F.floor(F.datediff("hi", "last_report") / F.lit(DAYS_PER_MONTH))
    base = F.when(before, INACTIVE).when(r, REPORTING)
    return {
        "method1": base.otherwise(SILENT),
        "method2": F.when(before, INACTIVE).when((month > F.col("last_report")) & (gap >= window), INACTIVE).when(r, REPORTING).otherwise(SILENT),
        "method3": base.when(silent >= window, INACTIVE).otherwise(SILENT),
    }


def _runs(df: DataFrame, value: str) -> DataFrame:
    """Runs of equal neighbours in an array column, as rows with the columns (nr, value, start, stop) beside the others; places count from 0, the stop lies beyond."""
    at = lambda i: F.get(value, i)
    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size(value) - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    made = F.transform("_starts", lambda i, k: F.struct((k + 1).alias("nr"), at(i).alias("value"), i.alias("start"), F.coalesce(F.get("_starts", k + 1), F.size(value)).alias("stop")))
    return df.select("*", F.inline(made)).drop("_starts")


def monthly_panel(df: DataFrame, roles: Roles, indicators: list[str], positive_only: bool = False) -> DataFrame:
    """(hf, month, r): every facility in every month from the table's first to its last; r by the first row of the month, by record id."""
    return _months(df, roles, indicators, positive_only).select("hf", "month", "r")


def classify_activity(df: DataFrame, roles: Roles, indicators: list[str], window: int = 6, positive_only: bool = False) -> DataFrame:
    """Adds the status of each panel month by the three methods.

    Method 1: active from the first report on. Method 2: as method 1, but inactive after the last report if it lies ``window`` or
    more duration months before the panel's end. Method 3: months without a report are inactive where ``window`` or more of them
    follow each other, anywhere after the first report. A facility's months are made from one row, so nothing is sorted.
    """
    got = _months(df, roles, indicators, positive_only)
    made = _statuses(F.col("month"), F.col("r"), F.col("silent"), window)
    return got.select("hf", "month", "r", "first_report", "last_report", *(c.alias(name) for name, c in made.items()))


def _status_runs(df: DataFrame, roles: Roles, indicators: list[str], method: int, window: int, of=lambda status: status) -> DataFrame:
    """(hf, nr, value, start_month, end_month, n_months): each facility's runs of months of one status, or of one value made of it."""
    status = lambda x: F.transform(F.sequence(x["start"], x["stop"] - 1), lambda i: of(_statuses(*_cell(i, x["start"], x["stop"], x["report"]), window)[f"method{method}"]))
    got = _reports(df, roles, indicators).withColumn("status", F.flatten(F.transform("parts", status)))
    n = F.col("stop") - F.col("start")
    return _runs(got, "status").select("hf", "nr", "value", F.add_months("lo", F.col("start")).alias("start_month"), F.add_months("lo", F.col("stop") - 1).alias("end_month"), n.alias("n_months"))


def active_months(df: DataFrame, roles: Roles, indicators: list[str], method: int = 3, window: int = 6) -> DataFrame:
    """(hf, month) pairs that are active."""
    got = classify_activity(df, roles, indicators, window)
    return got.where(F.col(f"method{method}") != INACTIVE).select("hf", "month")


def binary_activity(df: DataFrame, roles: Roles, indicators: list[str], method: int = 3, window: int = 6) -> DataFrame:
    """(hf, month, active): 1 where reporting, 0 where active and silent, null where inactive. A hyphen for the dash is understood too."""
    status = F.regexp_replace(f"method{method}", " - ", " – ")
    return classify_activity(df, roles, indicators, window).select("hf", "month", F.when(status == REPORTING, 1).when(status == SILENT, 0).alias("active"))


def methods_compared(df: DataFrame, roles: Roles, indicators: list[str], window: int = 6) -> DataFrame:
    """Facilities by status, month and method: one column per method."""
    got = classify_activity(df, roles, indicators, window)
    long = got.unpivot(["hf", "month"], list(METHODS), "method", "status")
    return long.groupBy("month", "status").pivot("method", list(METHODS)).agg(F.count(F.lit(1))).select("month", "status", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in METHODS))


def active_summary(df: DataFrame, roles: Roles, indicators: list[str], method: int = 3, window: int = 6) -> DataFrame:
    """Per month: active and inactive facilities and their sum; facilities of the whole panel counted once are ``n_facilities``."""
    active = F.col(f"method{method}") != INACTIVE  # the panel has a facility once in a month
    out = classify_activity(df, roles, indicators, window).groupBy("month").agg(F.count(F.when(active, 1)).alias("n_active"), F.count(F.when(~active, 1)).alias("n_inactive"), F.count("*").alias("n_facilities"))
    return out.select("month", "n_active", "n_inactive", (F.col("n_active") + F.col("n_inactive")).alias("n_total_status_sum"), "n_facilities")


def activity_episodes(df: DataFrame, roles: Roles, indicators: list[str], method: int = 3, window: int = 6) -> DataFrame:
    """Runs of months with one status per facility: start, end and months; the panel leaves out no month."""
    got = _status_runs(df, roles, indicators, method, window)
    return got.select("hf", F.col("nr").cast("long").alias("episode"), F.col("value").alias("status"), "start_month", "end_month", F.col("n_months").cast("long").alias("n_months"))


def active_spans(df: DataFrame, roles: Roles, indicators: list[str], method: int = 3, window: int = 6) -> DataFrame:
    """(hf, start_month, end_month): the spans of months, both included, in which a facility is active."""
    return _status_runs(df, roles, indicators, method, window, lambda status: status != INACTIVE).where("value").select("hf", "start_month", "end_month")


def reporting_categories(df: DataFrame, roles: Roles, indicators: list[str]) -> DataFrame:
    """Per facility: never, always or sometimes reporting over the panel, with its share of months."""
    got = _facilities(df, roles, indicators).select("hf", F.size("at").cast("long").alias("n_reported"), F.col("n").cast("long").alias("n_months"))
    name = F.when(F.col("n_reported") == 0, "never").when(F.col("n_reported") == F.col("n_months"), "always").otherwise("sometimes")
    return got.select("hf", "n_reported", "n_months", name.alias("category"), F.bround(F.col("n_reported") / F.col("n_months"), 6).alias("share"))
