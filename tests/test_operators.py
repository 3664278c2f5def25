"""Small fixtures with known outcomes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import semantics as se
from tessera.functions import text as tx
from tessera.functions.semantics import distinct_with_null, half_even, missing_as_null, null_safe_join
from tessera.operators import activity as ac
from tessera.operators import binning as bi
from tessera.operators import matching as ma
from tessera.operators import outliers as ou
from tessera.operators import population as po
from tessera.operators import reporting as rp
from tessera.operators import typing as ty
from tessera.operators import zonal as zo
from tessera.operators.activity import INACTIVE, REPORTING, SILENT, Roles

ROLES = Roles()


def months(n, year=2023):
    return [dt.date(year + i // 12, i % 12 + 1, 1) for i in range(n)]


def panel(spark, values, start=0):
    rows = [(f"r{h}{i}", h, d, v) for h, vs in values.items() for i, (d, v) in enumerate(zip(months(len(vs)), vs))]
    return spark.createDataFrame(rows, "record_id string, hf string, date date, conf double")


def status(spark, values, method, **k):
    got = ac.classify_activity(panel(spark, values), ROLES, ["conf"], **k).orderBy("hf", "month").collect()
    return [r[method] for r in got]


def test_never_and_once(spark):
    assert status(spark, {"a": [None] * 3}, "method3") == [INACTIVE] * 3
    assert status(spark, {"a": [None, 5.0, None]}, "method1") == [INACTIVE, REPORTING, SILENT]


def test_long_gap_is_inactive_only_in_method_3(spark):
    values = {"a": [1.0, *[None] * 6, 1.0]}
    assert status(spark, values, "method3") == [REPORTING, *[INACTIVE] * 6, REPORTING]
    assert status(spark, values, "method2") == [REPORTING, *[SILENT] * 6, REPORTING]


def test_method_2_counts_duration_months(spark):
    # from the 1st of January to the 1st of July are 5 duration months only
    assert status(spark, {"a": [1.0, *[None] * 6], "b": [1.0] * 7}, "method2")[:7] == [REPORTING, *[SILENT] * 6]
    assert status(spark, {"a": [1.0, *[None] * 7], "b": [1.0] * 8}, "method2")[:8] == [REPORTING, *[INACTIVE] * 7]


def test_positive_only(spark):
    assert status(spark, {"a": [0.0, 3.0]}, "method1", positive_only=True) == [INACTIVE, REPORTING]


def test_panel_fills_missing_months(spark):
    df = panel(spark, {"a": [1.0] * 11}).where("month(date) in (1, 11)")
    assert ac.monthly_panel(df, ROLES, ["conf"]).count() == 11


def test_rate_by_dates(spark):
    rows = [("1", "a", d, 1.0, None, None) for d in months(12)] + [("2", "b", d, None, None, dt.date(2023, 5, 31)) for d in months(12)]
    df = spark.createDataFrame(rows, "record_id string, hf string, date date, conf double, op date, cl date")
    got = {r.date.month: r.reprate for r in rp.rate_by_dates(df, "conf", "date", ROLES, "op", "cl").collect()}
    assert got[5] == 0.5 and got[6] == 1.0


@pytest.mark.parametrize("gap,want", [(0, {4, 5}), (1, {2, 4, 5}), (2, {2, 4, 5})])
def test_outbreak_gaps(spark, gap, want):
    values = [1, 200, 1, 200, 200, 1, 1, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("a", d, float(v)) for d, v in zip(months(12), values)], "hf string, date date, cases double")
    got = ou.classify_outbreaks(ou.detect_outliers(df, "cases", ["hf"]), "flag_iqr", ["hf"], ["date"], gap)
    assert {r.date.month for r in got.where("flag_iqr = 'outbreak'").collect()} == want
    assert got.where("flag_consensus = 'outlier'").count() == 0


def test_correction(spark):
    rows = [("a", 1, 10.0, 99.0, "normal"), ("a", 2, 100.0, 99.0, "outlier"), ("a", 3, 15.0, 99.0, "normal"), ("a", 4, 90.0, 5.0, "outlier"), ("a", 5, 11.0, 9.0, "normal"), ("a", 6, 80.0, 9.0, "outlier")]
    df = spark.createDataFrame(rows, "hf string, t int, test double, cons double, flag string")
    got = ou.correct_outliers(df, "test", "cons", "flag", ["hf"], ["t"]).orderBy("t").collect()
    assert [(r.correction_flag, r.test_corrected) for r in got] == [("not_outlier", 10.0), ("corrected", 12.0), ("not_outlier", 15.0), ("failed_consistency", None), ("not_outlier", 11.0), ("missing_neighbors", 80.0)]


def test_names(spark):
    df = spark.createDataFrame([("Pmi Zanfe-III",), ("Zanfé PMI 3",), (None,), ("l’Ombré",)], "n string")
    assert [r[0] for r in df.select(tx.standardize_name("n")).collect()] == ["PMI ZANFE 3", "PMI ZANFE 3", "", "L OMBRE"]


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.944444), ("dixon", "dicksonx", 0.766667), ("a", "b", 0.0), ("", "", 1.0), ("same", "same", 1.0)])
def test_jaro(a, b, want):
    assert round(tx.jaro(a, b), 6) == want


def test_semantics(spark):
    df = spark.createDataFrame([(12.5, None), (13.5, "x"), (float("nan"), "x")], "v double, k string")
    assert [r[0] for r in df.where("not isnan(v)").select(half_even("v")).collect()] == [12.0, 14.0]
    assert missing_as_null(df).where("v is null").count() == 1
    assert df.agg(distinct_with_null("k")).first()[0] == 2
    assert null_safe_join(df, spark.createDataFrame([(None, 1)], "k string, w int"), ["k"]).where("w = 1").count() == 1


def test_extrapolation_uses_filled_years(spark):
    df = spark.createDataFrame([("a", 2018, 100), ("a", 2020, 110)], "g string, y int, p int")
    got = {r.y: (r.p, r.filled) for r in po.extrapolate(df, ["g"], "y", "p", [2019, 2021, 2022], 1.05).collect()}
    assert got == {2018: (100, False), 2019: (105, True), 2020: (110, False), 2021: (116, True), 2022: (122, True)}


def test_logistic_trend_recovers_a_curve(spark):
    import math

    f = lambda y: 1 / (1 + math.exp(-(0.3 * (y - 2015))))
    df = spark.createDataFrame([("a", y, f(y)) for y in range(2010, 2021)], "g string, y int, v double")
    got = po.trend_logistic(df, ["g"], "y", "v", 2010, [2022]).first()
    assert abs(got.v - f(2022)) < 1e-6


def test_headtail_and_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 1, 2, 2, 3, 10, 50]], "x double")
    got = bi.bin_counts(df, "x", bi.headtail_breaks(df, "x", 3)).orderBy("bin").collect()
    assert sum(r.n for r in got) == 9 and got[-1].upper is None


def test_types_and_renaming(spark):
    df = spark.createDataFrame([("01", "1.5", "yes", None)], "code_x string, num string, `Odd  Näme` string, none string")
    assert {r.column: r.type for r in ty.type_plan(df).collect()} == {"code_x": "character", "num": "double", "Odd  Näme": "factor", "none": "character"}
    assert ty.rename_by_dictionary(df, {"odd name": "ok"}).columns == ["code_x", "num", "ok", "none"]


def test_coordinates(spark):
    df = spark.createDataFrame([(" 12,5 ",), ("−3.25",), ("1.2.3",), ("abc",), ("NA",), ("7.",), (None,)], "c string")
    assert [r[0] for r in df.select(zo.clean_coordinate("c")).collect()] == [12.5, -3.25, 1.23, None, None, 7.0, None]


def test_ray_casting(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]))
    df = spark.createDataFrame([(2.0, 0.5), (2.0, 3.0), (0.5, 2.0), (9.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(zo.in_polygon(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True, False]


def test_points_in_zones_of_all_sizes(spark):
    import random

    rng = random.Random(5)
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    zones = [(i, square(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.01, 0.5, 1.0, 7.0, 64.0, 300.0]))) for i in range(60)] + [(99, square(3.0, 3.0, 0.0))]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(400)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 0.0), (903, 3.0, 3.0)]
    z = spark.createDataFrame(zones, "zone int, ring array<struct<x: double, y: double>>")
    p = spark.createDataFrame([(*r, "kept") for r in points], "id int, lon double, lat double, _level string")
    got = zo.points_in_zones(p, z, "lon", "lat")
    assert got.columns == ["id", "lon", "lat", "_level", "zone"]
    inside = lambda x, y, r: x is not None and r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1]
    assert sorted((r.id, r.zone) for r in got.collect()) == sorted((i, k) for i, x, y in points for k, r in zones if inside(x, y, r))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert zo.points_in_zones(p, z.limit(0), "lon", "lat").count() == 0


def test_polygon_checks(spark):
    ring = "array<struct<x: double, y: double>>"
    star = [(0.0, 3.0), (2.0, -2.0), (-3.0, 1.0), (3.0, 1.0), (-2.0, -2.0)]
    rows = [("sq", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), ("sq", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), ("star", star), ("line", [(0.0, 0.0), (1.0, 0.0)]), ("none", None), ("empty", []), (None, [(0.0, 0.0), (None, 0.0), (1.0, 1.0)])]
    rows.append(("dent", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]))
    got = {(r.n, r.n_points): r for r in zo.polygon_checks(spark.createDataFrame(rows, f"n string, ring {ring}"), ["n"]).collect()}
    assert {k[0]: r.geometry for k, r in got.items()} == {"sq": "ok", "star": "crossing", "line": "degenerate", "none": "missing", "empty": "missing", None: "degenerate", "dent": "ok"}
    assert got["sq", 4].duplicate and got["sq", 4].n_same_ring == 2 and got["sq", 4].area == 4.0 and got["dent", 5].area == 10.0
    assert not got["none", 0].duplicate and got["none", 0].n_same_ring is None


def test_crosswalk_split(spark):
    df = spark.createDataFrame([("o", "a", 100.0, 51.0), ("o", "b", 100.0, 49.0), ("o", "c", 100.0, 0.05)], "old string, new string, area_old double, area_shared double")
    got = zo.crosswalk(df).orderBy("new").collect()
    assert [(r.new, r.overlap, r.primary, r.split) for r in got] == [("a", 0.51, True, True), ("b", 0.49, False, True)]


def test_variable_names():
    from tessera.functions.variables import leaves, parse_name

    known = {"conf_rdt_hf_u5", "maltreat_com_1_4_pub", "susp"}
    p = parse_name("conf_rdt_hf_u5", known)
    assert (p.domain, p.parts, p.known) == ("conf", {"test": "rdt", "service": "hf", "age": "u5"}, "conf_rdt_hf_u5")
    assert parse_name("Conf_rdthf_u5x", known).known == "conf_rdt_hf_u5"
    assert parse_name("maltreat_com_1_4_pub", known).parts == {"service": "com", "age": "1_4", "sector": "pub"}
    assert parse_name("other_thing", known).known is None and parse_name("other_thing", known).rest == ["thing"]
    tree = {"routine": {"conf": {"var_name": "conf", "label_en": "Confirmed", "by_age": {"u5": {"var_name": "conf_u5"}}}}}
    assert [(r["domain"], r["var_name"]) for r in leaves(tree)] == [("routine", "conf"), ("routine", "conf_u5")]


def test_active_share_keeps_unknown_rows(spark):
    rows = [("1", "a", dt.date(2023, 1, 1), dt.date(2022, 1, 1), dt.date(2024, 1, 1)), ("2", "b", dt.date(2023, 1, 1), None, None), ("3", "c", dt.date(2023, 1, 1), dt.date(2023, 2, 1), dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "record_id string, hf string, date date, op date, cl date")
    got = rp.active_share_by_dates(df, "date", ROLES, "op", "cl").orderBy("record_id").collect()
    assert [r.status for r in got] == ["Active", None, "Inactive"] and got[0].active_share == 0.333333


def test_outliers_with_clashing_columns(spark):
    rows = [("a", 2000 + i // 12, i % 12 + 1, float(10 + i % 3) if i != 30 else 900.0, 7, "m") for i in range(36)]
    df = spark.createDataFrame(rows, "hf string, year int, month int, mean double, n int, reason string")
    got = ou.detect_outliers(df, "mean", ["hf"]).collect()
    assert [r.flag_consensus for r in got].count("outlier") == 1 and {r.n for r in got} == {36}
    hit = next(r for r in got if r.flag_consensus == "outlier")
    assert (hit.mean_input, hit.n_input, hit.reason_input, hit.strength) == (900.0, 7, "m", 1.0)
    with pytest.raises(ValueError):
        ou.detect_outliers(df.withColumnRenamed("hf", "sd"), "mean", ["sd"])


def test_headtail_falls_back_to_the_bulk(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (100.0,)], "x double")
    assert bi.headtail_breaks(df, "x", 5).first()[0] == [1.0, float("inf")]
    assert bi.headtail_breaks(df, "x", 2).first()[0] == [25.75, 100.0, float("inf")]
    assert bi.headtail_breaks(df.limit(0), "x", 5).first()[0][-1] == float("inf")


def test_decisions_hold_under_their_parents(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), (None, "x")], "adm1 string, adm2 string")
    said = spark.createDataFrame([("adm1", "c", "a", None), ("adm2", "x", "y1", "a"), ("adm2", "x", "y2", None), ("adm2", "x", "y3", None)], "level string, name_to_match string, replacement string, adm1 string")
    got = ma.apply_decisions(df, said, ["adm1", "adm2"]).collect()
    assert sorted((r.adm1 or "", r.adm2) for r in got) == [("", "Y2"), ("A", "Y1"), ("A", "Y1"), ("B", "Y2")]


def test_many_to_one_separate_and_numbers(spark):
    left = spark.createDataFrame([(1, "a-b-c"), (None, "a"), (1, None), (3, "")], "k int, t string")
    right = spark.createDataFrame([(1, "one"), (None, "none")], "k int, v string")
    assert sorted(r.v or "" for r in se.many_to_one_join(left, right, ["k"]).collect()) == ["", "none", "one", "one"]
    with pytest.raises(Exception, match="more than one row"):
        se.many_to_one_join(left, right.unionByName(right), ["k"]).collect()
    got = se.separate(left, "t", ["x", "y"], "-").orderBy("k", "x").collect()
    assert [(r.x, r.y) for r in got] == [("a", None), (None, None), ("a", "b-c"), ("", None)]
    assert se.separate(left, "t", ["x"], "-", "drop").where("x = 'a'").count() == 2
    nums = spark.createDataFrame([(1234.0,), (5600000.0,), (12.0,), (None,), (2000.0,)], "n double").select(se.short_number("n"), se.big_mark("n")).collect()
    assert [tuple(r) for r in nums] == [("1.2K", "1,234"), ("5.6M", "5,600,000"), ("12", "12"), (None, None), ("2K", "2,000")]


def test_bin_labels():
    inf = float("inf")
    assert bi.bin_labels(0, [120, 980, 2600, inf], 9000) == ["0–100", "100–1K", "1K–3K", ">3K"]
    assert bi.bin_labels(0, [0.31, 0.62, 1.0], 1.0) == ["0.00–0.30", "0.30–0.60", "0.60–1.00"]
    assert bi.bin_labels(0, [10, 20, 30], 30)[0] == "0–10"  # finer units where labels would meet
    assert bi.bin_labels(-60, [0, 200], 260) == ["-50 to 0", "0 to 200"]


def test_coordinates_in_degrees_and_minutes(spark):
    texts = ["12°30'E", "12°30'36\"S", "W 45 15", "7.25", "12°75'N", "abc N", None, "", "12345N"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.bround(zo.dms_coordinate("t"), 4), zo.decimal_places("t"))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == [12.5, -12.51, -45.25, 7.25, None, None, None, None, None]
    assert [g[1] for g in got][3] == 2 and got[6][1] is None


def test_examples_and_fill(spark):
    df = spark.createDataFrame([("b", None), ("b", None), ("a", None), ("c", None), (None, None)], "x string, `y z` string")
    assert sorted(tuple(r) for r in ty.examples(df, ["x", "y z"], 2).collect()) == [("x", "b, a"), ("y z", "")]
    rows = spark.createDataFrame([("g", 1, None), ("g", 2, 5.0), ("g", 3, None), ("h", 1, None)], "g string, t int, v double")
    got = {k: [r.v for r in po.filled(rows, "v", ["g"], ["t"], k).orderBy("g", "t").collect()] for k in ("down", "up", "downup")}
    assert got == {"down": [None, 5.0, 5.0, None], "up": [5.0, 5.0, None, None], "downup": [5.0, 5.0, 5.0, None]}
