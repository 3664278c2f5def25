"""Queries of the population, trend, binning, zonal and coordinate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning as bi
from ..operators import filenames as fi
from ..operators import population as po
from ..operators import zonal as zo
from ..sources import views as vi
from .tables import table, view

POP = """SELECT r_name AS adm1, n_name AS adm2, {year} AS year, CAST(CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS DOUBLE) AS pop, count(*) AS births FROM {orders} JOIN {customer} ON o_custkey = c_custkey
 JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name, {year}"""
NAMES = ("orders", "customer", "nation", "region")
YEAR = "CAST(year(o_orderdate) AS INTEGER)"
P = POP.format(year=YEAR, **{n: n for n in NAMES})
KNOWN = "year <= 1999 AND NOT (adm2 = 'NATION_3' AND year = 1998)"


def pop(s, d):
    return view(s, d, POP.format(year="year(o_orderdate)", **{n: f"{{{n}}}" for n in NAMES}), *NAMES)


def _proj(s, d):
    return pop(s, d).where("year <= 1999")


CELLS = "SELECT label AS zone, vec_id, CAST(dim AS INTEGER) AS dim, value, (dim % 4 + 1) / 4.0D AS coverage, CASE WHEN dim % 5 = 0 THEN NULL ELSE 1.0D + dim % 3 END AS weight FROM ({0})"


def cells(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "v"))
    w = F.when(F.col("dim") % 5 != 0, (1 + F.col("dim") % 3).cast("double"))
    return e.select(F.col("label").alias("zone"), "vec_id", "dim", F.floor(F.col("v").cast("double") * 1000).cast("double").alias("value"), ((F.col("dim") % 4 + 1) / 4.0).alias("coverage"), w.alias("weight"))


C = """c AS (SELECT label AS zone, vec_id, dim, CAST(floor(CAST(v AS DOUBLE) * 1000) AS DOUBLE) AS value, (dim % 4 + 1) / 4.0 AS coverage, CASE WHEN dim % 5 <> 0 THEN CAST(1 + dim % 3 AS DOUBLE) END AS weight
 FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings))"""
OVER = "SELECT p_partkey % 20 AS old, CASE WHEN p_partkey % 20 < 6 THEN (p_partkey % 20) ELSE (p_partkey * 7) % 23 END AS new, CAST(sum(p_size) AS DOUBLE) AS area_shared FROM {0} GROUP BY 1, 2"
XY = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'abc' WHEN 2 THEN '12,5' WHEN 3 THEN {minus} || CAST(c_custkey % 90 AS {text}) || '.25' WHEN 4 THEN CAST(c_custkey % 170 AS {text}) || '.12.5' WHEN 5 THEN 'E 7.50.' WHEN 6 THEN '200' ELSE CAST(c_custkey % 40 AS {text}) || '?5' END AS lon,
 CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey % 60 AS {text}) || '.5' WHEN 1 THEN 'NA' WHEN 2 THEN '0' WHEN 3 THEN CAST(c_custkey % 20 AS {text}) ELSE '-3.75' END AS lat FROM {customer}"""
BOX = (0.0, 0.0, 60.0, 30.0)
POINTS = "SELECT c_custkey AS id, CAST(c_custkey % 97 AS DOUBLE) / 10 + 0.05 AS x, CAST(c_custkey % 89 AS DOUBLE) / 10 + 0.05 AS y FROM {0}"


def coords(s, d):
    raw = view(s, d, XY.format(minus="'−'", text="STRING", customer="{customer}"), "customer")
    return raw.select("id", zo.clean_coordinate("lon").alias("lon"), zo.clean_coordinate("lat").alias("lat"))


LON = "CASE id % 8 WHEN 2 THEN 12.5 WHEN 3 THEN -(id % 90 + 0.25) WHEN 4 THEN id % 170 + 0.125 WHEN 5 THEN 7.5 WHEN 6 THEN 200 WHEN 7 THEN id % 40 + 0.5 END"
LAT = "CASE id % 5 WHEN 0 THEN id % 60 + 0.5 WHEN 2 THEN 0 WHEN 3 THEN id % 20 WHEN 4 THEN -3.75 END"
CO = f"co AS (SELECT id, CAST({LON} AS DOUBLE) AS lon, CAST({LAT} AS DOUBLE) AS lat FROM (SELECT c_custkey AS id FROM customer))"


def rings(s, d):
    r = table(s, d, "region").select(F.col("r_name").alias("zone"), F.col("r_regionkey").cast("double").alias("k"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b = F.col("k") * 2, F.col("k") * 2 + 2
    # a triangle's hat on a square
    return r.select("zone", F.array(corner(a, F.lit(0.0)), corner(b, F.lit(0.0)), corner(b, F.lit(4.0)), corner(a + 1, F.lit(6.0)), corner(a, F.lit(4.0))).alias("ring"))


def shapes(s, d):
    """Suppliers' polygons: squares, bow ties, lines, none; some equal, some with equal names."""
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("A"), (F.col("s_suppkey") % 7).cast("string")).alias("adm1"), F.when(F.col("s_suppkey") % 11 > 0, (F.col("s_suppkey") % 5).cast("string")).alias("adm2"))
    k = (F.col("id") % 6).cast("double")
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    ring = F.when(k == 0, F.array(corner(0, 0), corner(2, 2), corner(2, 0), corner(0, 2))).when(k == 1, F.array(corner(0, 0), corner(1, 1), corner(2, 2))).when(k > 2, F.array(corner(0, 0), corner(k, 0), corner(k, 3), corner(0, 3)))
    return p.withColumn("ring", ring)


def _bins(make, x, name):
    return lambda s, d: bi.bin_counts(table(s, d, name), x, make(table(s, d, name)))


def _bins_sql(breaks: str, x: str, name: str) -> str:
    return f"""WITH RECURSIVE {breaks}, u AS (SELECT list_sort(list_distinct(b)) AS b FROM br), n AS (SELECT CAST(unnest(range(1, len(b) + 1)) AS BIGINT) AS bin, unnest(b) AS upper FROM u),
r AS (SELECT CAST(len(list_filter(b, lambda v: v < CAST({x} AS DOUBLE))) + 1 AS BIGINT) AS bin, count(*) AS n FROM {name}, u GROUP BY 1)
SELECT n.bin, CASE WHEN upper < 'inf'::DOUBLE THEN round_even(upper, 6) END AS upper, coalesce(r.n, 0) AS n FROM n LEFT JOIN r USING (bin)"""


def _values(x: str, name: str) -> str:
    return f"k AS (SELECT CAST({x} AS DOUBLE) AS x FROM {name} WHERE {x} <> 0)"


def _head(bins: int) -> list[str]:
    return [f"h{i} AS (SELECT avg(x) AS m, count(*) AS k FROM k" + (f" WHERE x > (SELECT m FROM g{i - 1})" if i else "") + f"), g{i} AS (SELECT CASE WHEN k > 0.05 * (SELECT count(*) FROM k) OR {i} = 0 THEN m END AS m FROM h{i})" for i in range(bins)]


HEAD = _head(5)
CATALOGUED = ("customer", "nation", "orders")
YEARS = [2000, 2001, 2002]
#: File names of months and years, all with two numbers in common.
FILES = """SELECT CASE kind WHEN 1 THEN 'maps/rate_250_' || m || '-' || y || '.007.tif' WHEN 2 THEN 'rate_250_' || y || '-' || m || '.007.tif' WHEN 3 THEN 'rate_250_' || y || m || '.007.tif' ELSE 'rate_250_' || y || '.007.tif' END AS name, d, kind
 FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m, month(o_orderdate) % 4 + 1 AS kind FROM {0})"""
FILES_SQL = FILES.format("orders").replace("STRING", "VARCHAR")

QUERIES = {
    "population_rollup": lambda s, d: po.roll_up(pop(s, d).withColumn("adm0", F.lit("WORLD")), ["adm0", "adm1", "adm2"], "year", ["pop", "births"]),
    "proportion_rollup": lambda s, d: po.shares(pop(s, d), ["adm1", "year"], "pop").select("adm2", "year", "share"),
    "growth_rate": lambda s, d: po.mean_growth(pop(s, d), ["adm2"], "year", "pop").select(F.bround("growth", 6).alias("growth"), "n_ratios"),
    "extrapolate": lambda s, d: po.extrapolate(pop(s, d).where("year <= 1999"), ["adm2"], "year", "pop", YEARS, {2000: 1.03, 2001: 1.02, 2002: 1.01}),
    "extrapolate_back": lambda s, d: po.extrapolate(pop(s, d).where("year between 1996 and 1999"), ["adm2"], "year", "pop", [1995], 1.25),
    "trend_constant": lambda s, d: po.trend_constant(_proj(s, d), ["adm2"], "year", "pop", 1999, YEARS),
    "trend_lm": lambda s, d: po.trend_linear(_proj(s, d), ["adm2"], "year", "pop", 1995, YEARS).withColumn("pop", F.bround("pop", 2)),
    "trend_hybrid": lambda s, d: po.trend_hybrid(po.trend_constant(_proj(s, d), ["adm2"], "year", "pop", 1999, YEARS), po.trend_linear(_proj(s, d), ["adm2"], "year", "pop", 1995, YEARS), ["adm2"], "year", "pop").withColumn("pop", F.bround("pop", 2)),
    "trend_logit": lambda s, d: po.trend_logistic(po.shares(pop(s, d), ["adm1", "year"], "pop"), ["adm2"], "year", "share", 1996, YEARS).withColumn("share", F.bround("share", 6)),
    "bins_quantile": _bins(lambda df: bi.quantile_breaks(df, "o_totalprice", 6), "o_totalprice", "orders"),
    "bins_hybrid": _bins(lambda df: bi.hybrid_breaks(df, "o_totalprice", 5), "o_totalprice", "orders"),
    "bins_headtail": _bins(lambda df: bi.headtail_breaks(df, "c_acctbal", 5), "c_acctbal", "customer"),
    "bins_shape": lambda s, d: bi.shape(table(s, d, "orders"), "o_totalprice"),
    "time_components": lambda s, d: view(s, d, FILES.format("{orders}"), "orders").select("name", *fi.time_components("name")),
    "time_pattern": lambda s, d: fi.time_pattern(view(s, d, FILES.format("{orders}"), "orders"), "name"),
    "clean_filenames": lambda s, d: fi.cleaned_names(view(s, d, FILES.format("{orders}"), "orders"), "name").select("name", "cleaned"),
    "bins_custom": lambda s, d: bi.bin_counts(table(s, d, "part"), "p_retailprice", s.range(1).select(F.array(*(F.lit(float(b)) for b in (500, 1000, 1500)), F.lit(float("inf"))).alias("breaks"))),
    "zonal_mean_sum": lambda s, d: zo.zonal_statistics(cells(s, d), "zone", "value", "coverage").withColumn("mean", F.bround("mean", 6)),
    "zonal_weighted_mean": lambda s, d: zo.zonal_statistics(cells(s, d), "zone", "value", "coverage", "weight").select("zone", F.bround("weighted_mean", 6).alias("weighted_mean")),
    "zonal_weighted_median": lambda s, d: zo.weighted_median(cells(s, d), "zone", "value", "coverage", "weight").withColumn("weighted_median", F.bround("weighted_median", 6)),
    "normalize_by_zone": lambda s, d: zo.normalized_by_zone(cells(s, d).withColumn("value", F.abs("value")), "zone", "value").select("vec_id", "dim", F.bround("share", 9).alias("share")),
    "monthly_climate": lambda s, d: zo.monthly_climate(table(s, d, "events"), ["event_type"], "ts", ["value"], ["user_id"]).select("event_type", "month", F.bround("mean_value", 4).alias("mean_value"), "min_value", "max_value", "sum_user_id"),
    "crosswalk_table": lambda s, d: zo.crosswalk(view(s, d, f"WITH o AS ({OVER.format('{part}')}) SELECT *, sum(area_shared) OVER (PARTITION BY old) AS area_old, sum(area_shared) OVER (PARTITION BY new) AS area_new FROM o", "part")),
    "coord_clean": coords,
    "coord_flags": lambda s, d: zo.coordinate_flags(coords(s, d), "lon", "lat", BOX).select("id", "coord_flag"),
    "coord_duplicates": lambda s, d: zo.coordinate_duplicates(coords(s, d), "lon", "lat").select("id", "n_same"),
    "point_in_polygon": lambda s, d: zo.points_in_zones(view(s, d, POINTS.format("{customer}"), "customer"), rings(s, d), "x", "y").select("id", "zone"),
    "polygon_checks": lambda s, d: zo.polygon_checks(shapes(s, d), ["adm1", "adm2"]).drop("ring"),
    "view_catalogue": lambda s, d: vi.describe(s, vi.register_views(s, d, [f"{n}.parquet" for n in CATALOGUED])).drop("keys"),
    "bins_headtail_fallback": _bins(lambda df: bi.headtail_breaks(df, "l_quantity", 8), "l_quantity", "lineitem"),
}
LOGIT = f"""d AS (SELECT adm2, year - avg(year) OVER (PARTITION BY adm2) AS x, avg(year) OVER (PARTITION BY adm2) AS m, round_even(pop / t, 6) AS y FROM (SELECT *, sum(pop) OVER (PARTITION BY adm1, year) AS t FROM p) WHERE year >= 1996),
t AS (SELECT DISTINCT adm2, m, 0 AS i, 0::DOUBLE AS a, 0::DOUBLE AS b FROM d UNION ALL
 SELECT adm2, m, i + 1, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1), b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) FROM
 (SELECT adm2, m, i, a, b, sum(q * (1 - q)) AS s0, sum(q * (1 - q) * x) AS s1, sum(q * (1 - q) * x * x) AS s2, sum(y - q) AS g0, sum((y - q) * x) AS g1
  FROM (SELECT t.adm2, t.m, t.i, t.a, t.b, d.x, d.y, 1 / (1 + exp(-(t.a + t.b * d.x))) AS q FROM t JOIN d ON t.adm2 = d.adm2 WHERE t.i < 30) GROUP BY adm2, m, i, a, b))"""
LM = f"f AS (SELECT adm2, regr_slope(pop, year) AS b, regr_intercept(pop, year) AS a FROM p WHERE year <= 1999 GROUP BY adm2), lm AS (SELECT adm2, CAST(y AS INTEGER) AS year, greatest(a + b * y, 0) AS pop FROM f, unnest({YEARS}) t(y))"
CONST = f"co AS (SELECT adm2, year, pop FROM p WHERE year <= 1999 UNION ALL SELECT adm2, CAST(y AS INTEGER), arg_max(pop, year) FROM p, unnest({YEARS}) t(y) WHERE year <= 1999 GROUP BY adm2, y)"
W = f"WITH p AS ({P})"
ORACLE_SQL = {
    "population_rollup": W + " " + " UNION ALL ".join(f"SELECT '{lv}' AS level, 'WORLD' AS adm0, {a} AS adm1, {b} AS adm2, year, sum(pop) AS pop, CAST(sum(births) AS BIGINT) AS births FROM p GROUP BY {g}" for lv, a, b, g in (("adm0", "NULL", "NULL", "year"), ("adm1", "adm1", "NULL", "adm1, year"), ("adm2", "adm1", "adm2", "adm1, adm2, year"))),
    "proportion_rollup": f"{W} SELECT adm2, year, round_even(pop / sum(pop) OVER (PARTITION BY adm1, year), 6) AS share FROM p",
    "growth_rate": f"{W}, r AS (SELECT CASE WHEN year - lag(year) OVER w = 1 THEN pop / lag(pop) OVER w END AS r FROM p WINDOW w AS (PARTITION BY adm2 ORDER BY year)) SELECT round_even(coalesce(avg(r), 1.02), 6) AS growth, count(r) AS n_ratios FROM r",
    "extrapolate": f"""{W}, a AS (SELECT adm2, arg_max(pop, year) AS v, max(year) AS y FROM p WHERE year <= 1999 GROUP BY 1), b AS (SELECT adm2, round_even(v * 1.03::DOUBLE, 0) AS v FROM a), c AS (SELECT adm2, round_even(v * 1.02::DOUBLE, 0) AS v FROM b), e AS (SELECT adm2, round_even(v * 1.01::DOUBLE, 0) AS v FROM c)
SELECT adm2, year, pop, FALSE AS filled FROM p WHERE year <= 1999 UNION ALL SELECT adm2, 2000, v, TRUE FROM b UNION ALL SELECT adm2, 2001, v, TRUE FROM c UNION ALL SELECT adm2, 2002, v, TRUE FROM e""",
    "extrapolate_back": f"{W} SELECT adm2, year, pop, FALSE AS filled FROM p WHERE year BETWEEN 1996 AND 1999 UNION ALL SELECT adm2, 1995, round_even(arg_min(pop, year) / 1.25::DOUBLE, 0), TRUE FROM p WHERE year BETWEEN 1996 AND 1999 GROUP BY adm2",
    "trend_constant": f"{W}, {CONST} SELECT * FROM co",
    "trend_lm": f"{W}, {LM} SELECT adm2, year, round_even(pop, 2) AS pop FROM lm",
    "trend_logit": f"{W.replace('WITH', 'WITH RECURSIVE', 1)}, {LOGIT} SELECT adm2, CAST(v AS INTEGER) AS year, round_even(1 / (1 + exp(-(a + b * (v - m)))), 6) AS share FROM t, unnest({YEARS}) u(v) WHERE i = 30",
    "trend_hybrid": f"{W}, {LM}, {CONST} SELECT adm2, year, round_even(avg(pop), 2) AS pop FROM (SELECT adm2, year, pop FROM lm UNION ALL SELECT adm2, year, pop FROM co) GROUP BY 1, 2",
    "bins_quantile": _bins_sql(f"{_values('o_totalprice', 'orders')}, br AS (SELECT quantile_cont(x, {[i / 7 for i in range(1, 8)]}) AS b FROM k)", "o_totalprice", "orders"),
    "bins_hybrid": _bins_sql(f"{_values('o_totalprice', 'orders')}, br AS (SELECT list_concat(quantile_cont(x, {[i / 5 for i in range(1, 6)]}), ['inf'::DOUBLE]) AS b FROM k WHERE x <= (SELECT quantile_cont(x, 0.9::DOUBLE) FROM k))", "o_totalprice", "orders"),
    "bins_headtail": _bins_sql(f"{_values('c_acctbal', 'customer')}, {', '.join(HEAD)}, br AS (SELECT list_append(list(m) FILTER (m IS NOT NULL), 'inf'::DOUBLE) AS b FROM ({' UNION ALL '.join(f'SELECT m FROM g{i}' for i in range(5))}))", "c_acctbal", "customer"),
    "bins_shape": """WITH k AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice <> 0), q AS (SELECT quantile_cont(x, 0.5::DOUBLE) AS q50, quantile_cont(x, 0.9::DOUBLE) AS q90 FROM k), z AS (SELECT count(*) FILTER (o_totalprice = 0) / CAST(count(*) AS DOUBLE) AS prop_zero FROM orders),
t AS (SELECT sum(x) FILTER (x > q90) / sum(x) AS tail_share FROM k, q), a AS (SELECT prop_zero, q50, q90, q90 / q50 AS ratio, tail_share FROM q, z, t)
SELECT round_even(prop_zero, 6) AS prop_zero, round_even(q50, 6) AS q50, round_even(q90, 6) AS q90, round_even(ratio, 6) AS ratio, round_even(tail_share, 6) AS tail_share, CASE WHEN prop_zero > 0.1 OR ratio > 4 OR tail_share > 0.4 THEN 'headtail' WHEN ratio > 2 THEN 'hybrid' ELSE 'quantile' END AS method FROM a""",
    "time_components": f"""WITH f AS (SELECT *, year(m) AS y, month(m) AS k FROM (SELECT name, CASE WHEN kind = 4 THEN make_date(CAST(year(d) AS BIGINT), 1, 1) ELSE d END AS m, kind FROM ({FILES_SQL})))
SELECT name, CAST(y AS INTEGER) AS year, CASE WHEN kind < 4 THEN CAST(k AS INTEGER) END AS month, CASE WHEN kind < 4 THEN CAST(ceil(k / 6.0) AS INTEGER) END AS semester, CASE WHEN kind < 4 THEN CAST(ceil(k / 3.0) AS INTEGER) END AS quarter, m AS date FROM f""",
    "time_pattern": f"SELECT count(*) AS n_files, CAST(0 AS BIGINT) AS n_daily, count(*) FILTER (kind < 4) AS n_monthly, count(*) FILTER (kind <> 3) AS n_yearly, CAST(NULL AS VARCHAR) AS pattern FROM ({FILES_SQL})",
    "clean_filenames": f"SELECT name, replace(replace(name, '_250_', '_'), '.007.', '.') AS cleaned FROM ({FILES_SQL})",
    "bins_custom": _bins_sql("br AS (SELECT [500::DOUBLE, 1000, 1500, 'inf'::DOUBLE] AS b)", "p_retailprice", "part"),
    "zonal_mean_sum": f"WITH {C} SELECT zone, count(*) AS n_cells, round_even(sum(value * coverage) / sum(coverage), 6) AS mean, CASE WHEN sum(value * coverage) > 1 THEN round_even(sum(value * coverage), 0) ELSE sum(value * coverage) END AS sum FROM c GROUP BY zone",
    "zonal_weighted_mean": f"WITH {C} SELECT zone, round_even(sum(value * coalesce(weight, 0) * coverage) / sum(coalesce(weight, 0) * coverage), 6) AS weighted_mean FROM c GROUP BY zone",
    "zonal_weighted_median": f"""WITH {C}, g AS (SELECT zone, value AS v, sum(weight * coverage) AS w FROM c WHERE weight * coverage > 0 GROUP BY 1, 2), a AS (SELECT zone, v, (sum(w) OVER (PARTITION BY zone ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY zone) AS pos FROM g),
l AS (SELECT zone, arg_max(v, pos) AS v0, max(pos) AS a0 FROM a WHERE pos <= 0.5 GROUP BY zone), h AS (SELECT zone, arg_min(v, pos) AS v1, min(pos) AS a1 FROM a WHERE pos > 0.5 GROUP BY zone)
SELECT zone, round_even(v0 + (v1 - v0) / (a1 - a0) * (0.5 - a0), 6) AS weighted_median FROM l JOIN h USING (zone)""",
    "normalize_by_zone": f"WITH {C} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round_even(abs(value) / sum(abs(value)) OVER (PARTITION BY zone), 9) AS share FROM c",
    "monthly_climate": "SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, round_even(avg(value), 4) AS mean_value, min(value) AS min_value, max(value) AS max_value, CAST(sum(user_id) AS BIGINT) AS sum_user_id FROM events GROUP BY 1, 2",
    "crosswalk_table": f"""WITH o AS ({OVER.format('part')}), q AS (SELECT old, new, area_shared / sum(area_shared) OVER (PARTITION BY old) AS p FROM o), f AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY p DESC, new) = 1 AND p >= 0.5 AS "primary" FROM q WHERE p >= 0.001),
k AS (SELECT *, count(*) OVER (PARTITION BY old) AS n_new, sum(p) OVER (PARTITION BY old) AS sp, count(*) OVER (PARTITION BY new) AS n_old FROM f WHERE "primary" OR p >= 0.1) SELECT old, new, round_even(p, 2) AS overlap, "primary", n_new, n_old, round_even(sp, 2) AS covered, n_new > 1 AS split, n_old > 1 AS merge FROM k""",
    "coord_clean": f"WITH {CO} SELECT * FROM co",
    "coord_flags": f"""WITH {CO} SELECT id, CASE WHEN lon IS NULL OR lat IS NULL THEN 'missing' WHEN lon = 0 AND lat = 0 THEN 'zero' WHEN lon BETWEEN 0 AND 60 AND lat BETWEEN 0 AND 30 THEN 'ok' WHEN lat BETWEEN 0 AND 60 AND lon BETWEEN 0 AND 30 THEN 'flipped' WHEN abs(lon) > 180 OR abs(lat) > 90 THEN 'out_of_range' ELSE 'outside' END AS coord_flag FROM co""",
    "coord_duplicates": f"WITH {CO}, n AS (SELECT id, count(*) OVER (PARTITION BY round_even(lon, 2), round_even(lat, 2)) AS n_same FROM co WHERE lon IS NOT NULL AND lat IS NOT NULL) SELECT * FROM n WHERE n_same > 1",
    "point_in_polygon": f"WITH p AS ({POINTS.format('customer')}) SELECT id, r_name AS zone FROM p JOIN region ON x > r_regionkey * 2 AND x < r_regionkey * 2 + 2 AND (y < 4 OR y < 6 - 2 * abs(x - r_regionkey * 2 - 1))",
    "polygon_checks": """WITH b AS (SELECT s_suppkey AS id, 'A' || (s_suppkey % 7) AS adm1, CASE WHEN s_suppkey % 11 > 0 THEN CAST(s_suppkey % 5 AS VARCHAR) END AS adm2, s_suppkey % 6 AS k FROM supplier)
SELECT id, adm1, adm2, CAST(CASE k WHEN 2 THEN 0 WHEN 1 THEN 3 ELSE 4 END AS BIGINT) AS n_points, CASE WHEN k > 2 THEN k * 3::DOUBLE WHEN k < 2 THEN 0::DOUBLE END AS area, CASE WHEN k > 2 THEN 'ok' WHEN k = 2 THEN 'missing' WHEN k = 1 THEN 'degenerate' ELSE 'crossing' END AS geometry,
CASE WHEN k <> 2 THEN count(*) OVER (PARTITION BY k) END AS n_same_ring, count(*) OVER (PARTITION BY adm1, adm2) AS n_same_names, count(*) OVER (PARTITION BY k, adm1, adm2) > 1 AS duplicate FROM b""",
    "view_catalogue": " UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {n})) + 1 AS n_columns FROM {n}" for n in CATALOGUED),  # and the file name
    "bins_headtail_fallback": _bins_sql(
        f"{_values('l_quantity', 'lineitem')}, {', '.join(_head(8))}, ht AS (SELECT list_append(list(m) FILTER (m IS NOT NULL), 'inf'::DOUBLE) AS b FROM ({' UNION ALL '.join(f'SELECT m FROM g{i}' for i in range(8))})), "
        f"bu AS (SELECT list_append(quantile_cont(x, {[i / 7 for i in range(1, 8)]}), 'inf'::DOUBLE) AS b FROM k WHERE x <= (SELECT quantile_cont(x, 0.9::DOUBLE) FROM k)), br AS (SELECT CASE WHEN len(list_distinct(ht.b)) < 8 THEN bu.b ELSE ht.b END AS b FROM ht, bu)",
        "l_quantity",
        "lineitem",
    ),
}
