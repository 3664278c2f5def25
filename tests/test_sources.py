import datetime as dt
import json
import os

import pytest

from tessera.functions.distances import METHODS, similarity
from tessera.operators.activity import Roles
from tessera.operators.validation import validate
from tessera.sources import demography, files, versioned, views, weather


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "id int, name string, score double")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "tsv", "json", "orc", "feather", "dta"])
def test_round_trip(spark, small, tmp_path, fmt):
    path = f"{tmp_path}/t.{fmt}"
    files.write(small, path)
    options = {"multiLine": False} if fmt == "json" else {}
    got = files.read(spark, path, **options)
    assert sorted((int(r["id"]), r["name"]) for r in got.collect()) == [(1, "a"), (2, "b")]


def test_geojson_csvy_and_foreign(spark, tmp_path):
    path = f"{tmp_path}/g.geojson"
    files.write(spark.createDataFrame([(1, json.dumps({"type": "Point", "coordinates": [1, 2]}))], "id int, geometry string"), path)
    row = files.read(spark, path).first()
    assert row.id == 1 and json.loads(row.geometry)["coordinates"] == [1, 2]
    with open(f"{tmp_path}/c.csvy", "w") as f:
        f.write("---\nname: x\n---\na,b\n1,2\n")
    assert files.read(spark, f"{tmp_path}/c.csvy").first().b == 2
    for bad in ("x.rds", "x.odd"):
        with pytest.raises(ValueError):
            files.read(spark, bad)


def test_array_rows(spark):
    df = spark.createDataFrame([("t", [[1.0, None], [3.0, 4.0]])], "k string, v array<array<double>>")
    got = files.array_rows(df, "v", ["i", "j"]).orderBy("i", "j").collect()
    assert [(r.i, r.j, r.v) for r in got] == [(1, 1, 1.0), (1, 2, None), (2, 1, 3.0), (2, 2, 4.0)]


def test_versions(spark, small, tmp_path):
    for day in range(1, 6):
        status = versioned.write_versioned(small.limit(day % 2 + 1), str(tmp_path), "tab", ["parquet", "csv"], today=dt.date(2024, 1, day), keep=2).collect()
        assert all(r.ok and r.bytes > 0 for r in status)
        for v in versioned.versions(str(tmp_path), "tab"):  # times of change must differ
            os.utime(v, (1e9 + 86400 * int(v.split("-")[-1][:2]),) * 2)
    assert len(versioned.versions(str(tmp_path), "tab", "parquet")) == 2
    assert versioned.latest(str(tmp_path), "tab", ["parquet"]).endswith("tab_v2024-01-05.parquet")
    assert versioned.read_latest(spark, str(tmp_path), "tab", ["parquet"]).count() == 2
    with pytest.raises(ValueError):
        versioned.write_versioned(small, str(tmp_path), "tab", ["csv"], tag="a b")
    assert not versioned.write_versioned(small, str(tmp_path), "tab", ["rds"]).first().ok


def test_views(spark, tmp_path):
    a = spark.createDataFrame([("SN", 2019, 1.0)], "country_code string, survey_year int, val double")
    a.write.partitionBy("country_code", "survey_year").parquet(f"{tmp_path}/PR")
    spark.createDataFrame([("ML", 2020, 2.0, "x")], "country_code string, survey_year int, val double, extra string").write.mode("append").partitionBy("country_code", "survey_year").parquet(f"{tmp_path}/PR")
    with open(f"{tmp_path}/PR/country_code=SN/survey_year=2019/bad.parquet", "wb") as f:
        f.write(b"no parquet")
    got = views.register_views(spark, str(tmp_path), ["PR"])
    assert spark.sql("SELECT sum(val) FROM pr WHERE country_code = 'ML'").first()[0] == 2.0
    row = views.describe(spark, got).first()
    assert (row.view, row.n_rows, row["keys"]) == ("pr", 2, ["country_code", "survey_year"])


def test_weather(spark, tmp_path):
    rows = [(n, s, float(n), float(s), 0.5, -1.0) for n in (7, 3) for s in (2, 1, 3)]
    df = spark.createDataFrame(rows, "node_id long, steps int, airtemp double, humidity double, rainfall double, landtemp double")
    weather.write_weather(df, f"file://{tmp_path}", "w")
    got = weather.read_weather(spark, f"file://{tmp_path}", "w").orderBy("node_id", "steps").collect()
    assert [(r.node_id, r.steps, r.airtemp, r.humidity) for r in got] == [(n, s, float(n), float(s)) for n in (3, 7) for s in (1, 2, 3)]
    assert weather.parse_offsets(weather.offsets_text([1, 258], 10)) == [(1, 0), (258, 40)]


def test_demography(spark):
    df = spark.createDataFrame([("Mali", 2019, 0, 1.0), ("Mali", 2021, 0, 3.0), ("Mali", 2021, 1, 1.0), ("Malindi", 2020, 0, 9.0)], "country string, year int, age int, pop double")
    assert [tuple(r) for r in demography.age_distribution(df, "mali", 2022).orderBy("age_days").collect()] == [(0, 0.75), (365, 1.0)]
    one = spark.createDataFrame([(1, "Dé à", 1.0, 2.0, 10, 36.5)], "node_id int, name string, lat double, lon double, pop int, birth_rate double")
    row = demography.documents(one).first()
    assert abs(json.loads(row.json)["Nodes"][0]["NodeAttributes"]["BirthRate"] - 0.0001) < 1e-12 and row.folder == "D_"


def test_validation_bundle(spark):
    rows = [(str(i), "a", "x", "y", dt.date(2023, i % 12 + 1, 1), 100.0 if i == 5 else 1.0, None if i % 3 else 2.0) for i in range(12)]
    df = spark.createDataFrame(rows, "record_id string, hf string, adm1 string, adm2 string, date date, test double, conf double")
    got = validate(df, Roles(), ["test", "conf"], [("test", "conf")], "2023-06-15")
    assert {r.variable: r.n_missing for r in got.missing.collect()} == {"test": 0, "conf": 8}
    assert got.consistency.first().n_failed == 4 and got.future_dates.count() == 6
    assert got.duplicate_records.count() == 0 and got.dictionary.count() == 7
    assert got.outliers.count() == 24 and got.activity.count() == 12 and got.episodes.count() >= 1
    assert got.corrections.columns[-1] == "corrected"


def test_distances(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("abc", "abc"), ("", ""), (None, "x")], "a string, b string")
    for m in [*METHODS, "soundex"]:
        got = [r[0] for r in df.select(similarity(df.a, df.b, m)).collect()]
        assert got[1] == pytest.approx(1.0) and got[3] is None and 0 <= got[0] <= 1, m
    assert METHODS["osa"]("ab", "ba") == 0.5 and METHODS["lv"]("ab", "ba") == 0.0
    assert round(METHODS["jw"]("martha", "marhta"), 4) == 0.9611
