"""Queries of labels, coordinates in degrees and minutes, examples, month names, fills and the summary of corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning as bi
from ..operators import outliers as ou
from ..operators import population as po
from ..operators import typing as ty
from ..operators import zonal as zo
from . import surveillance as su
from .tables import MONTHLY, monthly, table, view

PARTS = "SELECT c_custkey AS id, c_custkey % 90 AS deg, c_custkey % 59 AS m, c_custkey % 47 AS sec, c_custkey % 5 AS kind FROM {0}"
TEXT = "CASE kind WHEN 0 THEN deg || '°' || m || '′' || sec || '″S' WHEN 1 THEN deg || ' ' || m || ' ' || sec WHEN 2 THEN 'W ' || deg || '° ' || m || '.5′' WHEN 3 THEN '-' || deg || ',250' ELSE deg || '°' || (60 + m % 7) || '′E' END"
K = "CAST(CAST(round_even({0} / 1000, 0) AS BIGINT) AS VARCHAR) || 'K'"


def _corrected(s, d):
    return ou.correct_with_neighbours(su._with_ceiling(s, d), "cases", "ceiling_", "flag_consensus", su.GROUPS, ["date"], consistency_flag="flag_mean")


QUERIES = {
    "bins_labelled": lambda s, d: bi.adaptive_bins(table(s, d, "orders"), "o_totalprice"),
    "coord_dms": lambda s, d: view(s, d, f"SELECT id, {TEXT} AS t FROM ({PARTS.format('{customer}')})", "customer").select("id", F.bround(zo.dms_coordinate("t"), 6).alias("lon"), F.when(F.col("t").startswith("-"), zo.decimal_places("t")).alias("places")),
    "dictionary_examples": lambda s, d: ty.examples(table(s, d, "documents"), ["lang", "source"]),
    "month_labels": lambda s, d: table(s, d, "orders").groupBy(ty.month_label("o_orderdate", "fr").alias("label")).agg(F.count("*").alias("n")),
    "fill_down_up": lambda s, d: po.filled(monthly(s, d), "cases", ["hf"], ["date"]).select("hf", "date", "cases"),
    "correction_summary": lambda s, d: ou.correction_summary(_corrected(s, d)),
}
ORACLE_SQL = {
    "bins_labelled": f"""WITH k AS (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders WHERE o_totalprice <> 0), q AS (SELECT quantile_cont(x, {[i / 7 for i in range(1, 8)]}) AS b, min(x) AS lo FROM k),
u AS (SELECT CAST(unnest(range(1, 8)) AS BIGINT) AS bin, unnest(list_prepend(lo, b)[1:7]) AS lower, unnest(b) AS upper FROM q), r AS (SELECT CAST(len(list_filter(q.b, lambda v: v < o_totalprice)) + 1 AS BIGINT) AS bin, count(*) AS n FROM orders, q GROUP BY 1),
f AS (SELECT bin, round_even(lower / 50, 0) * 50 AS a, round_even(upper / 50, 0) * 50 AS z FROM u)
SELECT 'quantile' AS method, bin, CASE WHEN a >= 1000 THEN {K.format('a')} ELSE CAST(CAST(a AS BIGINT) AS VARCHAR) END || '–' || {K.format('z')} AS label, coalesce(n, 0) AS n FROM f LEFT JOIN r USING (bin)""",
    "coord_dms": f"SELECT id, round_even(CASE kind WHEN 0 THEN -(deg + m / 60::DOUBLE + sec / 3600::DOUBLE) WHEN 1 THEN deg + m / 60::DOUBLE + sec / 3600::DOUBLE WHEN 2 THEN -(deg + (m + 0.5::DOUBLE) / 60) WHEN 3 THEN -(deg + 0.25::DOUBLE) END, 6) AS lon, CASE WHEN kind = 3 THEN 2 END AS places FROM ({PARTS.format('customer')})",
    "dictionary_examples": """SELECT variable, string_agg(value, ', ' ORDER BY i) AS examples FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY count(*) DESC, value) AS i
 FROM (SELECT 'lang' AS variable, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE value IS NOT NULL GROUP BY variable, value) WHERE i <= 3 GROUP BY variable""",
    "month_labels": f"SELECT ({list(ty.MONTH_NAMES['fr'])})[month(o_orderdate)] || ' ' || year(o_orderdate) AS label, count(*) AS n FROM orders GROUP BY 1",
    "fill_down_up": f"WITH p AS ({MONTHLY}) SELECT hf, date, coalesce(last_value(cases IGNORE NULLS) OVER (PARTITION BY hf ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(cases IGNORE NULLS) OVER (PARTITION BY hf ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cases FROM p",
    "correction_summary": "SELECT status, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, sum(corrected) AS sum_corrected FROM ("
    + su.ORACLE_SQL["validation_correction"].replace("WHERE flag_consensus = 'outlier'", "WHERE flag_consensus = 'outlier' AND flag_mean <> 'outlier'")
    + ") GROUP BY status",
}
