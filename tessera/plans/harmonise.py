"""Queries of the name, matching and typing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matching as ma
from ..operators import typing as ty
from .tables import table, view

# names made untidy by rule
NAMES = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || '  IV' WHEN 1 THEN '  ' || replace(p_name, ' ', ' - ') || ' ii' WHEN 2 THEN 'Zanfé PMI ' || p_name
 WHEN 3 THEN p_name || '’s 12 VIII' ELSE p_name END AS name FROM {0}"""
ROMAN_SQL = "std1"


def _std_sql(col: str, src: str) -> str:
    x = f"upper({col})"
    x = f"trim(regexp_replace(regexp_replace({x}, '[\\p{{P}}]', ' ', 'g'), '\\s+', ' ', 'g'))"
    x = f"strip_accents({x})"
    for k, v in tx.ROMAN.items():
        x = f"regexp_replace({x}, '\\b{k}\\b', '{v}', 'g')"
    return f"""SELECT *, array_to_string(list_concat(list_sort(list_filter(w, lambda t: NOT regexp_matches(t, '^[0-9]+$'))), list_sort(list_filter(w, lambda t: regexp_matches(t, '^[0-9]+$')))), ' ') AS std
FROM (SELECT *, string_split_regex(coalesce({x}, ''), ' +') AS w FROM {src})"""


def names(s, d):
    return view(s, d, NAMES.format("{part}"), "part")


# suppliers: target names are the lookup's, damaged by rule
TARGET = """SELECT n_name AS adm2, CAST(s_suppkey AS {text}) AS uid, CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN lower(s_name) WHEN 2 THEN replace(s_name, '#', ' - ') WHEN 3 THEN replace(s_name, 'Supplier', 'Suplier')
 WHEN 4 THEN 'Centre ' || CAST(s_suppkey * 37 AS {text}) WHEN 5 THEN s_name ELSE replace(s_name, '#0000', '#000') END AS hf FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""
LOOKUP = "SELECT n_name AS adm2, s_name AS hf_mfl FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_suppkey % 11 <> 3"
ARGS = {"text": "VARCHAR", "supplier": "supplier", "nation": "nation"}


def target(s, d):
    return view(s, d, TARGET.format(text="STRING", supplier="{supplier}", nation="{nation}"), "supplier", "nation")


def lookup(s, d):
    return view(s, d, LOOKUP.format(supplier="{supplier}", nation="{nation}"), "supplier", "nation")


def _match(threshold: float, one: bool):
    return lambda s, d: ma.match_facilities(target(s, d), lookup(s, d), ["adm2"], threshold, one)


STATUS = "CASE WHEN match_pct >= 95 THEN 'high' WHEN match_pct >= 80 THEN 'medium' WHEN match_pct >= 70 THEN 'low' WHEN match_pct IS NOT NULL THEN 'very low' ELSE 'unmatched' END AS match_status"


def _match_sql(threshold: float, one: bool) -> str:
    keep = "QUALIFY row_number() OVER (PARTITION BY adm2, hf_mfl ORDER BY match_pct DESC, rk, uid) = 1" if one else ""
    return f"""t0 AS (SELECT DISTINCT * FROM ({TARGET.format(**ARGS)})), l0 AS (SELECT DISTINCT * FROM ({LOOKUP.format(**ARGS)})),
t1 AS ({_std_sql('hf', 't0')} WHERE hf IS NOT NULL), l1 AS ({_std_sql('hf_mfl', 'l0')}),
pr AS (SELECT t1.adm2, uid, hf, hf_mfl, CASE WHEN upper(hf) = upper(hf_mfl) THEN 1 WHEN t1.std = l1.std THEN 2 ELSE 3 END AS rk,
  50 * jaro_similarity(t1.std, l1.std) + 50 * greatest(0, 1 - levenshtein(t1.std, l1.std) / CAST(greatest(length(t1.std), length(l1.std), 1) AS DOUBLE)) AS sc FROM t1 JOIN l1 USING (adm2)),
bs AS (SELECT *, CASE WHEN rk < 3 THEN 100 ELSE sc END AS s2 FROM pr WHERE rk < 3 OR sc >= {threshold} QUALIFY row_number() OVER (PARTITION BY adm2, uid ORDER BY rk, CASE WHEN rk < 3 THEN 100 ELSE sc END DESC, hf_mfl) = 1),
fd AS (SELECT adm2, uid, hf, rk, CAST(round_even(s2, 0) AS INTEGER) AS match_pct, hf_mfl FROM bs {keep}),
mt AS (SELECT adm2, uid, hf, CASE rk WHEN 1 THEN 'exact_admin' WHEN 2 THEN 'standardized' ELSE 'fuzzy' END AS match_method, match_pct, hf_mfl FROM fd
  UNION ALL SELECT adm2, uid, hf, CASE WHEN hf IS NULL THEN 'missing_name' ELSE 'unmatched' END, NULL, NULL FROM t0 WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.adm2 = t0.adm2 AND fd.uid = t0.uid))"""


ADMIN = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ' ' || lower(r_name) WHEN 1 THEN r_name || ' STATE' ELSE r_name END AS adm1,
 CASE c_custkey % 3 WHEN 0 THEN replace(n_name, '_', '-') WHEN 1 THEN n_name || '  ' ELSE n_name END AS adm2 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
PLACES = "SELECT r_name AS adm1, n_name AS adm2 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 2"
DECISIONS = "SELECT 'adm1' AS level, r_name || ' state' AS name_to_match, r_name AS replacement FROM {region} UNION ALL SELECT 'adm2', replace(n_name, '_', '-'), n_name FROM {nation} WHERE n_nationkey % 2 = 0"
#: Decisions that hold under one parent, some also under any, and some twice.
BY_PARENTS = """SELECT 'adm1' AS level, r_name || ' state' AS name_to_match, r_name AS replacement, CAST(NULL AS STRING) AS adm1 FROM {region}
 UNION ALL SELECT 'adm2', replace(n_name, '_', '-'), n_name || ' of ' || r_name, r_name FROM {nation}, {region} WHERE (n_nationkey + r_regionkey) % 2 = 0
 UNION ALL SELECT 'adm2', replace(n_name, '_', '-'), n_name || ' anywhere', CAST(NULL AS STRING) FROM {nation} WHERE n_nationkey % 3 = 0
 UNION ALL SELECT 'adm2', replace(n_name, '_', '-'), n_name || ' also', CAST(NULL AS STRING) FROM {nation} WHERE n_nationkey % 3 = 0"""
AARGS = {n: n for n in ("customer", "nation", "region")}
BRACES = {n: f"{{{n}}}" for n in ("customer", "nation", "region")}
CLEAN = "upper(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def admin(s, d):
    return view(s, d, ADMIN.format(**BRACES), "customer", "nation", "region")


def places(s, d):
    return view(s, d, PLACES.format(**BRACES), "nation", "region")


def decided(s, d):
    return ma.apply_decisions(admin(s, d), view(s, d, DECISIONS.format(**BRACES), "nation", "region"), ["adm1", "adm2"])


A = f"WITH a AS ({ADMIN.format(**AARGS)}), pl AS ({PLACES.format(**AARGS)}), de AS ({DECISIONS.format(**AARGS)})"
DECIDED = f"""{A}, c AS (SELECT id, {CLEAN.format('adm1')} AS adm1, {CLEAN.format('adm2')} AS adm2 FROM a), k AS (SELECT level, {CLEAN.format('name_to_match')} AS f, {CLEAN.format('replacement')} AS t FROM de),
dd AS (SELECT id, coalesce(x.t, adm1) AS adm1, coalesce(y.t, adm2) AS adm2 FROM c LEFT JOIN k x ON x.level = 'adm1' AND x.f = adm1 LEFT JOIN k y ON y.level = 'adm2' AND y.f = adm2)"""

# text columns to be typed
RAW = """SELECT CAST(o_orderkey AS {text}) AS number, lpad(CAST(o_orderkey AS {text}), 12, '0') AS padded, CAST(o_totalprice AS {text}) AS price, CAST(CAST(o_orderdate AS DATE) AS {text}) AS day,
 o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'FALSE' END AS flag, CAST(o_custkey AS {text}) AS customer_id, o_orderpriority || CAST(o_orderkey AS {text}) AS label,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS {text}) END AS maybe FROM {orders}"""
DATES = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} WHEN 2 THEN {flat} WHEN 3 THEN {iso} || 'T10:20:30' WHEN 4 THEN 'no date' ELSE {dots} END AS raw, CAST(o_orderdate AS DATE) AS truth FROM {orders}"""
SPARK_DATES = {k: f"date_format(o_orderdate, '{v}')" for k, v in {"iso": "yyyy-MM-dd", "dmy": "dd/MM/yyyy", "flat": "yyyyMMdd", "dots": "dd.MM.yyyy"}.items()}
PROFILED = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]


def raw(s, d):
    return view(s, d, RAW.format(text="STRING", orders="{orders}"), "orders")


R = f"WITH r AS ({RAW.format(text='VARCHAR', orders='orders')})"
TYPES = {"number": "integer", "padded": "character", "price": "double", "day": "date", "status": "factor", "flag": "logical", "customer_id": "character", "label": "character", "maybe": "integer"}

QUERIES = {
    "standardize_names": lambda s, d: names(s, d).select("id", tx.standardize_name("name").alias("std")),
    "standardize_names_in_order": lambda s, d: names(s, d).select("id", tx.standardize_name("name", sort_tokens=False).alias("std")),
    "clean_names": lambda s, d: names(s, d).select("id", tx.clean_name("name").alias("name")),
    "match_fuzzy": _match(85.0, False),
    "match_strict": _match(95.0, False),
    "one_to_one": _match(60.0, True),
    "coverage_crosscheck": lambda s, d: ma.coverage(_match(85.0, True)(s, d), lookup(s, d)),
    "apply_decisions": lambda s, d: decided(s, d).select("id", "adm1", "adm2"),
    "decisions_by_parents": lambda s, d: ma.apply_decisions(admin(s, d), view(s, d, BY_PARENTS.format(**BRACES), "nation", "region"), ["adm1", "adm2"]).select("id", "adm1", "adm2"),
    "match_stats": lambda s, d: ma.match_stats(decided(s, d), places(s, d), ["adm1", "adm2"]),
    "impute_parent": lambda s, d: ma.impute_parent(decided(s, d), places(s, d), "adm2", "adm1").select("id", "adm2", "adm1_imputed"),
    "distance_rank": lambda s, d: ma.nearest_names(target(s, d).where("hf is not null").select(F.col("adm2").alias("block"), F.col("hf").alias("name")).distinct(), lookup(s, d).select(F.col("adm2").alias("block"), F.col("hf_mfl").alias("candidate"))),
    "type_plan": lambda s, d: ty.type_plan(raw(s, d)),
    "parse_dates": lambda s, d: view(s, d, DATES.format(orders="{orders}", **SPARK_DATES), "orders").select("id", ty.parse_date("raw").alias("parsed")),
    "profile_dictionary": lambda s, d: ty.profile(table(s, d, "orders").select(*PROFILED)).select("variable", "n", "n_missing", "pct_missing", "n_unique"),
    "rename_by_dictionary": lambda s, d: ty.rename_by_dictionary(table(s, d, "nation").withColumnsRenamed({"n_name": "Nom  du PAYS", "n_nationkey": "Clé-pays"}), {"nom du pays": "adm1", "cle pays": "key"}),
    "event_props": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"), F.count(F.get_json_object("props", "$.k")).alias("n_k")),
}
ORACLE_SQL = {
    "standardize_names": f"WITH n AS ({NAMES.format('part')}), s AS ({_std_sql('name', 'n')}) SELECT id, std FROM s",
    "standardize_names_in_order": f"WITH n AS ({NAMES.format('part')}), s AS ({_std_sql('name', 'n')}) SELECT id, array_to_string(w, ' ') AS std FROM s",
    "clean_names": f"WITH n AS ({NAMES.format('part')}) SELECT id, {CLEAN.format('name')} AS name FROM n",
    "match_fuzzy": f"WITH {_match_sql(85.0, False)} SELECT *, {STATUS} FROM mt",
    "match_strict": f"WITH {_match_sql(95.0, False)} SELECT *, {STATUS} FROM mt",
    "one_to_one": f"WITH {_match_sql(60.0, True)} SELECT *, {STATUS} FROM mt",
    "coverage_crosscheck": f"WITH {_match_sql(85.0, True)}, g AS (SELECT count(*) AS n_lookup, count(*) FILTER (hf_mfl IN (SELECT hf_mfl FROM mt)) AS n_matched FROM l0) SELECT n_lookup, n_matched, n_lookup - n_matched AS n_only_lookup, round_even(100.0 * (n_lookup - n_matched) / n_lookup, 4) AS pct_only_lookup FROM g",
    "decisions_by_parents": f"""WITH a AS ({ADMIN.format(**AARGS)}), de AS ({BY_PARENTS.format(**AARGS)}), c AS (SELECT id, {CLEAN.format('adm1')} AS adm1, {CLEAN.format('adm2')} AS adm2 FROM a),
k AS (SELECT level, {CLEAN.format('name_to_match')} AS f, {CLEAN.format('replacement')} AS t, {CLEAN.format('adm1')} AS parent FROM de), up AS (SELECT id, coalesce((SELECT min(t) FROM k WHERE level = 'adm1' AND f = adm1), adm1) AS adm1, adm2 FROM c)
SELECT id, adm1, coalesce((SELECT min(t) FROM k WHERE level = 'adm2' AND f = adm2 AND parent = up.adm1), (SELECT min(t) FROM k WHERE level = 'adm2' AND f = adm2 AND parent IS NULL), adm2) AS adm2 FROM up""",
    "apply_decisions": f"{DECIDED} SELECT id, adm1, adm2 FROM dd",
    "match_stats": f"""{DECIDED}, t1 AS (SELECT DISTINCT adm1 AS k FROM dd), t2 AS (SELECT DISTINCT adm1 || '_' || adm2 AS k FROM dd), q1 AS (SELECT DISTINCT {CLEAN.format('adm1')} AS k FROM pl), q2 AS (SELECT DISTINCT {CLEAN.format('adm1')} || '_' || {CLEAN.format('adm2')} AS k FROM pl)
SELECT 'adm1' AS level, count(*) AS n_target, (SELECT count(*) FROM q1) AS n_lookup, count(*) FILTER (k IN (SELECT k FROM q1)) AS n_matched FROM t1 UNION ALL SELECT 'adm2', count(*), (SELECT count(*) FROM q2), count(*) FILTER (k IN (SELECT k FROM q2)) FROM t2""",
    "impute_parent": f"{DECIDED} SELECT id, adm2, coalesce((SELECT min(pl.adm1) FROM pl WHERE pl.adm2 = dd.adm2), adm2) AS adm1_imputed FROM dd",
    "distance_rank": f"""WITH {_match_sql(85.0, False)}, x AS (SELECT DISTINCT t1.adm2 AS block, hf AS name, hf_mfl AS candidate, levenshtein(t1.std, l1.std) AS distance FROM t1 JOIN l1 USING (adm2))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, name ORDER BY distance, candidate) AS rank FROM x) WHERE rank <= 3""",
    "type_plan": R + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_unique, '{k}' AS type FROM r" for c, k in TYPES.items()),
    "parse_dates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders",
    "profile_dictionary": " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_missing, round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS pct_missing, count(DISTINCT {c}) AS n_unique FROM orders" for c in PROFILED),
    "rename_by_dictionary": "SELECT n_nationkey AS key, n_name AS adm1, n_regionkey FROM nation",
    "event_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY 1",
}
