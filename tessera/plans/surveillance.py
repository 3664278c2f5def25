"""Queries of the outlier, correction and data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as ou
from ..operators import quality as qa
from .tables import MONTHLY, PANEL, monthly, panel, view

GROUPS = ["adm2", "hf"]
SHOWN = ["hf", "date", "cases", "n", "mean_upper", "median_upper", "iqr_upper", "flag_mean", "flag_median", "flag_iqr", "flag_consensus", "reason"]


def _detected(s, d, rule):
    return ou.detect_outliers(monthly(s, d), "cases", GROUPS, rule)


def _shown(rule):
    def run(s, d):
        return _detected(s, d, rule).select(*(F.bround(c, 6).alias(c) if c.endswith("upper") else F.col(c) for c in SHOWN))

    return run


def _stats(rule: ou.OutlierRule, source: str = "p") -> str:
    keys = ", ".join([*GROUPS, *ou.TIME_KEYS[rule.time_mode]])
    a, b, c = rule.widths
    low = f"WHEN reprate < {rule.reporting_rate_min} THEN 'low_reporting'" if rule.reporting_rate else ""
    flag = "coalesce(guard, CASE WHEN coalesce({s} = 0, TRUE) THEN 'unstable_scale' WHEN cases IS NULL OR {u} IS NULL THEN 'insufficient_evidence' WHEN cases > {u} THEN 'outlier' ELSE 'normal' END)"
    simple = "CASE WHEN {0} IN ('outlier', 'normal') THEN {0} ELSE 'insufficient_data' END"
    return f"""s1 AS (SELECT *, count(cases) OVER w AS n, avg(cases) OVER w AS mean, stddev_samp(cases) OVER w AS sd, median(cases) OVER w AS med,
      quantile_cont(cases, 0.25) OVER w AS q1, quantile_cont(cases, 0.75) OVER w AS q3 FROM {source} WINDOW w AS (PARTITION BY {keys})),
s2 AS (SELECT *, median(abs(cases - med)) OVER (PARTITION BY {keys}) * 1.4826 AS mad, q3 - q1 AS iqr FROM s1),
s3 AS (SELECT *, mean + {a} * sd AS mean_upper, med + {b} * mad AS median_upper, q3 + {c} * iqr AS iqr_upper, CASE {low} WHEN n < {rule.min_n} THEN 'insufficient_n' END AS guard FROM s2),
s4 AS (SELECT *, {flag.format(s='sd', u='mean_upper')} AS f1, {flag.format(s='mad', u='median_upper')} AS f2, {flag.format(s='iqr', u='iqr_upper')} AS f3 FROM s3),
s5 AS (SELECT *, coalesce(guard, CASE WHEN f1 = 'unstable_scale' AND f2 = 'unstable_scale' AND f3 = 'unstable_scale' THEN 'insufficient_evidence'
      WHEN CAST(f1 = 'outlier' AS INT) + CAST(f2 = 'outlier' AS INT) + CAST(f3 = 'outlier' AS INT) >= {rule.consensus} THEN 'outlier' ELSE 'normal' END) AS reason FROM s4),
det AS (SELECT *, {simple.format('f1')} AS flag_mean, {simple.format('f2')} AS flag_median, {simple.format('f3')} AS flag_iqr, {simple.format('reason')} AS flag_consensus FROM s5)"""


def _sql(rule):
    return f"WITH p AS ({MONTHLY}), {_stats(rule)} SELECT hf, date, cases, n, round_even(mean_upper, 6) AS mean_upper, round_even(median_upper, 6) AS median_upper, round_even(iqr_upper, 6) AS iqr_upper, flag_mean, flag_median, flag_iqr, flag_consensus, reason FROM det"


RULES = {
    "outliers_across_time": ou.OutlierRule(),
    "outliers_within_year": ou.OutlierRule(time_mode="within_year", consensus=1),
    "outliers_seasonal": ou.OutlierRule(time_mode="seasonal", consensus=2, min_n=5),
    "outliers_lenient": ou.OutlierRule(preset="lenient", consensus=1),
    "outliers_strict": ou.OutlierRule(preset="strict", consensus=1),
    "outliers_advanced": ou.OutlierRule(multipliers=(2.0, 7.0, 1.8), consensus=2),
    "outliers_guarded": ou.OutlierRule(reporting_rate="reprate", consensus=1),
}
ONE = ou.OutlierRule(consensus=1, preset="strict")
BASE = f"WITH p AS ({MONTHLY}), {_stats(ONE)}"


def _outbreak(gap, run):
    return lambda s, d: ou.classify_outbreaks(_detected(s, d, ONE), "flag_consensus", GROUPS, ["date"], gap, run).select("hf", "date", "flag_consensus")


def _outbreak_sql(gap, run):
    return f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY adm2, hf ORDER BY date) AS pos, flag_consensus = 'outlier' AS hit FROM det),
k AS (SELECT *, max(CASE WHEN hit THEN pos END) OVER (PARTITION BY adm2, hf ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
c AS (SELECT *, sum(CASE WHEN hit AND (prev IS NULL OR pos - prev - 1 > {gap}) THEN 1 ELSE 0 END) OVER (PARTITION BY adm2, hf ORDER BY pos) AS cl FROM k)
SELECT hf, date, CASE WHEN hit AND sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY adm2, hf, cl) >= {run} THEN 'outbreak' ELSE flag_consensus END AS flag_consensus FROM c"""


LIMIT = "lines * 30 AS ceiling_"


def _with_ceiling(s, d):
    return _detected(s, d, ONE).withColumn("ceiling_", F.col("lines") * 30)


PAIRS = [("conf", "test"), ("test", "susp"), ("conf", "susp")]
DUP = "SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM {0}"

#: Values of some facilities only, so that there are groups without any.
SOME = "CASE WHEN length(hf) % 2 = 0 OR hf LIKE '%3' THEN conf END"
QUERIES = {
    **{k: _shown(r) for k, r in RULES.items()},
    "outbreak_gap0": _outbreak(0, 2),
    "outbreak_gap2": _outbreak(2, 2),
    "outbreak_gap12": _outbreak(12, 3),
    "correct_outliers": lambda s, d: ou.correct_outliers(_with_ceiling(s, d), "cases", "ceiling_", "flag_consensus", GROUPS, ["date"]).select("hf", "date", "correction_flag", "cases_corrected"),
    "impute_ma": lambda s, d: ou.impute_moving_average(_detected(s, d, ONE), "cases", "mean_upper", GROUPS, ["date"]).select("hf", "date", "cases_imputed"),
    "validation_correction": lambda s, d: ou.correct_with_neighbours(_with_ceiling(s, d), "cases", "ceiling_", "flag_consensus", GROUPS, ["date"]).select("hf", "date", "median", "status", "corrected"),
    "consistency_pairs": lambda s, d: qa.consistency_pairs(panel(s, d), PAIRS),
    "consistency_map": lambda s, d: qa.consistency_map(panel(s, d), "test", "susp", ["adm1", "adm2"]),
    "consistency_zscore": lambda s, d: qa.consistency_zscores(panel(s, d), "test", "susp", ["record_id"]),
    "missing_table": lambda s, d: qa.missing_table(panel(s, d), ["conf", "test", "susp", "hf"]),
    "missing_detail": lambda s, d: qa.missing_detail(panel(s, d).withColumn("year", F.year("date")), ["conf", "test", "susp"], ["adm1", "adm2", "year"]),
    "duplicates": lambda s, d: qa.duplicates(view(s, d, DUP.format("{events}"), "events"), ["user_id", "event_type", "day"], ["event_id"]),
    "future_dates": lambda s, d: qa.future_dates(panel(s, d), "date", "2001-05-17", ["record_id"]),
    "row_sum_fallback": lambda s, d: panel(s, d).select("record_id", qa.row_sum(["conf", "test", "susp"], 2).alias("total")),
    "diff_fallback": lambda s, d: panel(s, d).select("record_id", qa.difference_or("test", "susp").alias("difference")),
    "safe_sum": lambda s, d: panel(s, d).withColumn("conf", F.expr(SOME)).groupBy("hf").agg(F.sum("conf").alias("sum_or_null"), F.coalesce(F.sum("conf"), F.lit(0.0)).alias("sum_or_zero"), F.count("*").alias("n")).select("hf", F.bround("sum_or_null", 2).alias("sum_or_null"), F.bround("sum_or_zero", 2).alias("sum_or_zero"), "n"),
}
P = f"WITH p AS ({PANEL})"
LAGS = "lag(cases) OVER o AS a, lead(cases) OVER o AS b"
ORACLE_SQL = {
    **{k: _sql(r) for k, r in RULES.items()},
    "outbreak_gap0": _outbreak_sql(0, 2),
    "outbreak_gap2": _outbreak_sql(2, 2),
    "outbreak_gap12": _outbreak_sql(12, 3),
    "correct_outliers": f"""{BASE}, l AS (SELECT *, {LIMIT}, {LAGS} FROM det WINDOW o AS (PARTITION BY adm2, hf ORDER BY date)),
m AS (SELECT *, round_even((a + b) / 2, 0) AS mid FROM l), f AS (SELECT *, CASE WHEN flag_consensus <> 'outlier' THEN 'not_outlier' WHEN a IS NULL OR b IS NULL THEN 'missing_neighbors' WHEN mid > ceiling_ THEN 'failed_consistency' ELSE 'corrected' END AS correction_flag FROM m)
SELECT hf, date, correction_flag, CASE correction_flag WHEN 'corrected' THEN mid WHEN 'failed_consistency' THEN NULL ELSE cases END AS cases_corrected FROM f""",
    "impute_ma": f"""{BASE}, l AS (SELECT *, {LAGS} FROM det WINDOW o AS (PARTITION BY adm2, hf ORDER BY date)), m AS (SELECT *, CASE WHEN a <= mean_upper THEN a END AS x, CASE WHEN b <= mean_upper THEN b END AS y FROM l),
v AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (x + y) / 2 ELSE coalesce(x, y) END AS ma FROM m) SELECT hf, date, CASE WHEN cases > mean_upper AND ma IS NOT NULL THEN round_even(ma, 0) ELSE cases END AS cases_imputed FROM v""",
    "validation_correction": f"""{BASE}, l AS (SELECT *, {LIMIT}, list(cases) FILTER (cases IS NOT NULL) OVER (PARTITION BY adm2, hf ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x, list(cases) FILTER (cases IS NOT NULL) OVER (PARTITION BY adm2, hf ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS y FROM det),
m AS (SELECT *, CASE WHEN coalesce(len(x), 0) = 0 OR coalesce(len(y), 0) = 0 THEN NULL ELSE round_even(list_median(list_concat(x, y)), 0) END AS med2 FROM l WHERE flag_consensus = 'outlier'),
s AS (SELECT hf, date, med2 AS median, CASE WHEN med2 IS NULL THEN 'no_neighbours' WHEN med2 > ceiling_ THEN 'inconsistent' ELSE 'corrected' END AS status FROM m) SELECT *, CASE WHEN status = 'corrected' THEN median END AS corrected FROM s""",
    "consistency_pairs": P + ", g AS (" + " UNION ALL ".join(f"SELECT '{a}' AS input, '{b}' AS output, CAST(sum(CASE WHEN {b} > {a} THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, count(*) AS n_rows FROM p" for a, b in PAIRS) + ") SELECT *, round_even(n_failed / CAST(n_rows AS DOUBLE), 6) AS prop_failed, CASE WHEN n_failed > 0 THEN 'fail' ELSE 'pass' END AS status FROM g",
    "consistency_map": f"{P}, g AS (SELECT adm1, adm2, coalesce(sum(test), 0) AS sum_input, coalesce(sum(susp), 0) AS sum_output, CAST(sum(CASE WHEN susp > test THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, count(*) AS n_rows FROM p GROUP BY 1, 2) SELECT *, round_even(100.0 * n_failed / n_rows, 4) AS pct_failed, sum_output <= sum_input AS consistent FROM g",
    "consistency_zscore": f"{P}, x AS (SELECT record_id, susp - test AS difference FROM p), w AS (SELECT avg(difference) AS m, stddev_samp(difference) AS s FROM x) SELECT record_id, difference, round_even((difference - m) / s, 6) AS z_score FROM x, w WHERE difference > 0",
    "missing_table": P + ", g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS n_rows FROM p" for c in ("conf", "test", "susp", "hf")) + ") SELECT *, round_even(n_missing / CAST(n_rows AS DOUBLE), 4) AS prop_missing FROM g",
    "missing_detail": P + ", g AS (" + " UNION ALL ".join(f"SELECT adm1, adm2, CAST(year(date) AS INTEGER) AS year, '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS n_rows FROM p GROUP BY 1, 2, 3" for c in ("conf", "test", "susp")) + ") SELECT *, round_even(n_missing / CAST(n_rows AS DOUBLE), 4) AS prop_missing FROM g WHERE n_missing > 0",
    "duplicates": f"WITH e AS ({DUP.format('events')}), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, day) AS n_copies FROM e) SELECT * FROM c WHERE n_copies > 1",
    "future_dates": f"{P} SELECT record_id, date FROM p WHERE date > DATE '2001-05-01'",
    "row_sum_fallback": f"{P} SELECT record_id, CASE WHEN CAST(conf IS NOT NULL AS INT) + CAST(test IS NOT NULL AS INT) + CAST(susp IS NOT NULL AS INT) >= 2 THEN coalesce(conf, 0) + coalesce(test, 0) + coalesce(susp, 0) END AS total FROM p",
    "diff_fallback": f"{P} SELECT record_id, CASE WHEN test IS NOT NULL AND susp IS NOT NULL THEN abs(test - susp) ELSE coalesce(test, susp) END AS difference FROM p",
    "safe_sum": f"{P} SELECT hf, round_even(sum({SOME}), 2) AS sum_or_null, round_even(coalesce(sum({SOME}), 0), 2) AS sum_or_zero, count(*) AS n FROM p GROUP BY hf",
}
