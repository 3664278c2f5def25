"""Queries of the activity and reporting operators."""

from __future__ import annotations

from ..operators import activity as ac
from ..operators import reporting as rp
from .tables import PANEL, ROLES, panel, view

KEYS = ["conf", "test"]
DASH = ac.SILENT


def _months(positive: bool = False, window: int = 6) -> str:
    r = "conf > 0 OR test > 0" if positive else "conf IS NOT NULL OR test IS NOT NULL"
    return f"""p AS ({PANEL}),
f AS (SELECT hf, yearmon AS month, arg_min(coalesce({r}, FALSE), record_id) AS r FROM p GROUP BY 1, 2),
b AS (SELECT min(month) AS lo, max(month) AS hi FROM f),
m AS (SELECT hf, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT DISTINCT hf FROM f), b),
q AS (SELECT m.hf, m.month, coalesce(f.r, FALSE) AS r FROM m LEFT JOIN f ON f.hf = m.hf AND f.month = m.month),
w AS (SELECT *, min(CASE WHEN r THEN month END) OVER (PARTITION BY hf) AS first_report, max(CASE WHEN r THEN month END) OVER (PARTITION BY hf) AS last_report,
      max(month) OVER (PARTITION BY hf) AS fin, sum(CASE WHEN r THEN 1 ELSE 0 END) OVER (PARTITION BY hf ORDER BY month) AS seen FROM q),
s AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY hf, seen) AS silent FROM w),
act AS (SELECT hf, month, r, first_report, last_report,
 CASE WHEN first_report IS NULL OR month < first_report THEN 'Inactive' WHEN r THEN 'Active Reporting' ELSE '{DASH}' END AS method1,
 CASE WHEN first_report IS NULL OR month < first_report THEN 'Inactive' WHEN month > last_report AND floor((fin - last_report) / 30.4375) >= {window} THEN 'Inactive' WHEN r THEN 'Active Reporting' ELSE '{DASH}' END AS method2,
 CASE WHEN first_report IS NULL OR month < first_report THEN 'Inactive' WHEN r THEN 'Active Reporting' WHEN silent >= {window} THEN 'Inactive' ELSE '{DASH}' END AS method3 FROM s)"""


ACT = _months()
ROWS = f"{ACT}, d AS (SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM act WHERE act.hf = p.hf AND act.month = p.yearmon AND method3 <> 'Inactive'))"
RATE = "round_even(CASE WHEN exp > 0 THEN rep / CAST(exp AS DOUBLE) END, 6) AS reprate, round_even(1 - CASE WHEN exp > 0 THEN rep / CAST(exp AS DOUBLE) END, 6) AS missrate"

DATED = """
SELECT o_orderkey AS record_id, CAST(o_custkey AS {text}) AS hf, CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('month', o_orderdate) AS DATE) AS yearmon, n_name AS adm2,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS conf,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST({open} AS DATE) END AS hf_opening_date, CASE WHEN o_custkey % 5 <> 0 THEN NULL ELSE DATE '2000-01-01' END AS hf_closing_date
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""


def dated(spark, sf_dir):
    return view(spark, sf_dir, DATED.format(text="STRING", open="date_add(DATE '1996-01-01', CAST(o_custkey % 900 AS INT))", orders="{orders}", customer="{customer}", nation="{nation}"), "orders", "customer", "nation")


DATED_SQL = DATED.format(text="VARCHAR", open="DATE '1996-01-01' + CAST(o_custkey % 900 AS INTEGER)", orders="orders", customer="customer", nation="nation")


def _weighted(include: bool, cold: str) -> str:
    frame = "BETWEEN 11 PRECEDING AND CURRENT ROW" if include else "BETWEEN 12 PRECEDING AND 1 PRECEDING"
    med = "median(typ) OVER (PARTITION BY adm2)" if cold == "group" else "NULL"
    return f"""WITH {ACT},
z AS (SELECT *, avg(susp) OVER (PARTITION BY hf ORDER BY date NULLS LAST, record_id ROWS {frame}) AS typ FROM p),
z2 AS (SELECT * REPLACE (coalesce(typ, {med}, median(typ) OVER ()) AS typ) FROM z),
z3 AS (SELECT *, sum(typ) OVER (PARTITION BY yearmon, adm2) AS tot FROM z2),
z4 AS (SELECT *, CASE WHEN tot > 0 THEN typ / tot ELSE 0 END AS wt FROM z3),
d AS (SELECT z4.* FROM z4 WHERE EXISTS (SELECT 1 FROM act WHERE act.hf = z4.hf AND act.month = z4.yearmon AND method3 <> 'Inactive')),
o AS (SELECT yearmon, adm2, hf, bool_or(conf IS NOT NULL OR test IS NOT NULL) AS given, avg(wt) AS w, avg(susp) AS size FROM d GROUP BY 1, 2, 3),
g AS (SELECT yearmon, adm2, sum(CASE WHEN given THEN 1 ELSE 0 END) AS rep, count(*) AS exp, sum(CASE WHEN given THEN w ELSE 0 END) / nullif(sum(w), 0) AS wr, avg(size) AS a, min(size) AS lo, max(size) AS hi FROM o GROUP BY 1, 2)
SELECT yearmon, adm2, CAST(rep AS BIGINT) AS rep, exp, {RATE}, round_even(wr, 6) AS reprate_w, round_even(1 - wr, 6) AS missrate_w, round_even(a, 4) AS avg_size, round_even(lo, 4) AS min_size, round_even(hi, 4) AS max_size FROM g"""


def _act(columns):
    return lambda s, d: ac.classify_activity(panel(s, d), ROLES, KEYS).select("hf", "month", *columns)


EVENTS = "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id FROM {0}"
LONG = "SELECT {k}, 'user_id' AS variable, CAST(user_id AS DOUBLE) AS v FROM e UNION ALL SELECT {k}, 'value', value FROM e"


def events(s, d):
    return view(s, d, EVENTS.format("{events}"), "events")


QUERIES = {
    **{f"activity_m{i}": _act(["first_report", "last_report", f"method{i}"]) for i in (1, 2, 3)},
    "activity_all": _act(["method1", "method2", "method3"]),
    "activity_positive_only": lambda s, d: ac.classify_activity(panel(s, d), ROLES, KEYS, positive_only=True).select("hf", "month", "r", "method3"),
    "activity_binary": lambda s, d: ac.binary_activity(panel(s, d), ROLES, KEYS),
    "methods_compare_pivot": lambda s, d: ac.methods_compared(panel(s, d), ROLES, KEYS),
    "active_facilities_summary": lambda s, d: ac.active_summary(panel(s, d), ROLES, KEYS),
    "activity_episodes": lambda s, d: ac.activity_episodes(panel(s, d), ROLES, KEYS),
    "reporting_categories": lambda s, d: ac.reporting_categories(panel(s, d), ROLES, KEYS),
    "reporting_rate_combined": lambda s, d: rp.rate_combined(panel(s, d), KEYS, "yearmon", ROLES, "adm1"),
    "reporting_rate_all": lambda s, d: rp.rate_combined(panel(s, d), KEYS, "yearmon", ROLES, "adm1", require_all=True),
    "reporting_rate_per_variable": lambda s, d: rp.rate_per_variable(panel(s, d), KEYS, "yearmon", ROLES, "adm2"),
    "reporting_rate_xy": lambda s, d: rp.rate_of_rows(events(s, d), ["value", "user_id"], "month", "event_type"),
    "reporting_rate_x": lambda s, d: rp.rate_of_rows(events(s, d), ["value", "user_id"], "month"),
    "reporting_rate_weighted": lambda s, d: rp.rate_weighted(panel(s, d), KEYS, "susp", "yearmon", "adm2", ROLES),
    "reporting_rate_weighted_current": lambda s, d: rp.rate_weighted(panel(s, d), KEYS, "susp", "yearmon", "adm2", ROLES, include_current=True, cold_start="global"),
    "reporting_rate_dates": lambda s, d: rp.rate_by_dates(dated(s, d), "conf", "yearmon", ROLES, "hf_opening_date", "hf_closing_date", "adm2"),
    "active_share_by_dates": lambda s, d: rp.active_share_by_dates(dated(s, d), "yearmon", ROLES, "hf_opening_date", "hf_closing_date", "adm2").select("record_id", "status", "n_active", "n_rows", "active_share"),
}
ORACLE_SQL = {
    **{f"activity_m{i}": f"WITH {ACT} SELECT hf, month, first_report, last_report, method{i} FROM act" for i in (1, 2, 3)},
    "activity_all": f"WITH {ACT} SELECT hf, month, method1, method2, method3 FROM act",
    "activity_positive_only": f"WITH {_months(True)} SELECT hf, month, r, method3 FROM act",
    "activity_binary": f"WITH {ACT} SELECT hf, month, CASE method3 WHEN 'Active Reporting' THEN 1 WHEN '{DASH}' THEN 0 END AS active FROM act",
    "methods_compare_pivot": f"""WITH {ACT}, l AS (SELECT month, method1 AS status, 1 AS k FROM act UNION ALL SELECT month, method2, 2 FROM act UNION ALL SELECT month, method3, 3 FROM act)
SELECT month, status, count(*) FILTER (k = 1) AS method1, count(*) FILTER (k = 2) AS method2, count(*) FILTER (k = 3) AS method3 FROM l GROUP BY 1, 2""",
    "active_facilities_summary": f"""WITH {ACT} SELECT month, count(DISTINCT hf) FILTER (method3 <> 'Inactive') AS n_active, count(DISTINCT hf) FILTER (method3 = 'Inactive') AS n_inactive,
count(DISTINCT hf) FILTER (method3 <> 'Inactive') + count(DISTINCT hf) FILTER (method3 = 'Inactive') AS n_total_status_sum, count(DISTINCT hf) AS n_facilities FROM act GROUP BY month""",
    "activity_episodes": f"""WITH {ACT}, n AS (SELECT hf, month, method3 AS status, CASE WHEN lag(method3) OVER o IS DISTINCT FROM method3 THEN 1 ELSE 0 END AS new FROM act WINDOW o AS (PARTITION BY hf ORDER BY month)),
e AS (SELECT *, sum(new) OVER (PARTITION BY hf ORDER BY month) AS episode FROM n)
SELECT hf, CAST(episode AS BIGINT) AS episode, status, min(month) AS start_month, max(month) AS end_month, count(*) AS n_months FROM e GROUP BY 1, 2, 3""",
    "reporting_categories": f"""WITH {ACT}, g AS (SELECT hf, CAST(sum(CASE WHEN r THEN 1 ELSE 0 END) AS BIGINT) AS n_reported, count(*) AS n_months FROM q GROUP BY hf)
SELECT *, CASE WHEN n_reported = 0 THEN 'never' WHEN n_reported = n_months THEN 'always' ELSE 'sometimes' END AS category, round_even(n_reported / CAST(n_months AS DOUBLE), 6) AS share FROM g""",
    "reporting_rate_combined": f"WITH {ROWS}, g AS (SELECT yearmon, adm1, count(DISTINCT hf) FILTER (conf IS NOT NULL OR test IS NOT NULL) AS rep, count(DISTINCT hf) AS exp FROM d GROUP BY 1, 2) SELECT *, {RATE} FROM g",
    "reporting_rate_all": f"WITH {ROWS}, g AS (SELECT yearmon, adm1, count(DISTINCT hf) FILTER (conf IS NOT NULL AND test IS NOT NULL) AS rep, count(DISTINCT hf) AS exp FROM d GROUP BY 1, 2) SELECT *, {RATE} FROM g",
    "reporting_rate_per_variable": f"""WITH {ROWS}, l AS (SELECT yearmon, adm2, hf, 'conf' AS variable, conf AS v FROM d UNION ALL SELECT yearmon, adm2, hf, 'test', test FROM d),
g AS (SELECT yearmon, adm2, variable, count(DISTINCT hf) FILTER (v IS NOT NULL) AS rep, count(DISTINCT hf) AS exp FROM l GROUP BY 1, 2, 3) SELECT *, {RATE} FROM g""",
    "reporting_rate_xy": f"WITH e AS ({EVENTS.format('events')}), l AS ({LONG.format(k='month, event_type')}), g AS (SELECT month, event_type, variable, count(v) AS rep, count(*) AS exp FROM l GROUP BY 1, 2, 3) SELECT *, {RATE} FROM g",
    "reporting_rate_x": f"WITH e AS ({EVENTS.format('events')}), l AS ({LONG.format(k='month')}), g AS (SELECT month, variable, count(v) AS rep, count(*) AS exp FROM l GROUP BY 1, 2) SELECT *, {RATE} FROM g",
    "reporting_rate_weighted": _weighted(False, "group"),
    "reporting_rate_weighted_current": _weighted(True, "global"),
    "reporting_rate_dates": f"""WITH p AS ({DATED_SQL}), d AS (SELECT * FROM p WHERE (hf_opening_date IS NULL OR date >= hf_opening_date) AND (hf_closing_date IS NULL OR date <= hf_closing_date)),
g AS (SELECT yearmon, adm2, count(DISTINCT hf) FILTER (conf IS NOT NULL) AS rep, count(DISTINCT hf) AS exp FROM d GROUP BY 1, 2) SELECT *, {RATE} FROM g""",
    "active_share_by_dates": f"""WITH p AS ({DATED_SQL}), i AS (SELECT *, date >= hf_opening_date AND date <= hf_closing_date AS inside FROM p),
n AS (SELECT *, CAST(sum(CASE WHEN inside THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_active, count(*) OVER w AS n_rows FROM i WINDOW w AS (PARTITION BY yearmon, adm2))
SELECT record_id, CASE WHEN inside THEN 'Active' WHEN NOT inside THEN 'Inactive' END AS status, n_active, n_rows, round_even(n_active / CAST(n_rows AS DOUBLE), 6) AS active_share FROM n""",
}
