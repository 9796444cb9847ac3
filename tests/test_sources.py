"""Readers and writers on small files."""

import gzip
import json

import pytest

from casetide.sources import readers, sinks


def test_text_catalogs(spark, tmp_path):
    kp = tmp_path / "kp.txt"
    kp.write_text("# remark\n2020 01 02 0 0.5 1 1 0.333 1.000 2.667 -1 4 5 6 7\n")
    rows = readers.three_hourly(spark, str(kp)).orderBy("time").collect()
    assert [r.kp for r in rows] == [0.333, 1.0, 2.667, None, 4.0, 5.0, 6.0, 7.0] and str(rows[1].time) == "2020-01-02 03:00:00"
    day = readers.daily_of_three_hourly(spark, str(kp)).first()
    assert (day.kp_max, round(day.kp_sum, 3)) == (7.0, 26.0)
    omni = tmp_path / "omni.txt"
    omni.write_text("2020  32   5  9999.0  4.5\n\n2020 33 0 400.0 999.9\n")
    rows = readers.ordinal_columns(spark, str(omni), {"y": (0, None), "d": (1, None), "h": (2, None), "v": (3, 9999.0), "b": (4, 999.9)})
    rows = rows.withColumn("t", readers.day_of_year_time(rows.y, rows.d, rows.h)).collect()
    assert rows[0].v is None and rows[1].b is None and str(rows[0].t) == "2020-02-01 05:00:00"
    tsv = tmp_path / "sites.tsv"
    tsv.write_text("#Site\tName\n# remark\nA1\tAlpha\nB2\t-\n")
    assert [tuple(r) for r in readers.tsv_with_units(spark, str(tsv)).collect()] == [("A1", "Alpha"), ("B2", None)]


def test_json_catalogs(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"fields": ["date", "lat", "lat-dir", "energy"], "data": [["2020-01-01 00:00:00", "10.5", "S", "2"], ["x", None, None, None]]}))
    rows = readers.matrix_json(spark, str(tmp_path / "f.json"), {"lat": "double", "lat-dir": "string", "energy": "double"})
    rows = rows.withColumn("lat", readers.signed(rows["lat"], rows["lat-dir"], "S")).collect()
    assert rows[0].lat == -10.5 and rows[1].energy is None
    (tmp_path / "n.json").write_text("﻿" + json.dumps({"recs": [{"id": 1, "key_vals": {"a": "b"}}, {"id": 2}]}))
    assert [r.id for r in readers.nested_json(spark, str(tmp_path / "n.json"), "recs", "id: int, key_vals: map<string,string>").collect()] == [1, 2]
    (tmp_path / "wiki_pageviews_Foo.json").write_text(json.dumps({"items": [{"timestamp": "2020010200", "views": 5}]}))
    r = readers.page_views(spark, str(tmp_path / "wiki_pageviews_Foo.json")).first()
    assert (r.article, str(r.date), r.views) == ("Foo", "2020-01-02", 5)
    (tmp_path / "wb.json").write_text(json.dumps([{"page": 1}, [{"countryiso3code": "USA", "date": "2020", "value": 1.5}]]))
    assert tuple(readers.indicator_json(spark, str(tmp_path / "wb.json")).first()) == ("USA", 2020, 1.5)
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}))
    assert tuple(readers.geojson_points(spark, str(tmp_path / "g.json"), "name: string").first()) == ("p", 2.0, 1.0)


def test_stations_and_storms(spark, tmp_path):
    with gzip.open(tmp_path / "123456-12345-2020.gz", "wt") as f:
        f.write("2020 01 01 00 -9999 10 10132 90 35 0 -9999 -9999\n2020 01 01 01 15 10 10132 90 35 -9999 -1 12\n2020 01 01 03 15 10 10132 90 35 9 0 0\n2020 01 01 04 15 10 10132 90 35 10 0 0\n")
    rows = readers.station_hours(spark, str(tmp_path / "*.gz")).orderBy("time").collect()
    assert [r.sky_oktas for r in rows] == [0, None, 8, 8] and rows[0].temp_c is None and rows[1].precip_1h_mm == 0.05 and rows[0].station == "123456-12345"
    (tmp_path / "storm.csv").write_text("BEGIN_DATE_TIME,CZ_TIMEZONE,EVENT_TYPE,BEGIN_LAT,BEGIN_LON\n01-JUN-10 12:00:00,CST-6,Hail,30,-90\n01-JUN-10 12:00:00,EDT,Wind,30,-90\n01-JUN-10 12:00:00,SCT,Wind,30,-90\n")
    assert sorted(str(r.time) for r in readers.storm_reports(spark, str(tmp_path / "storm.csv")).collect()) == ["2010-06-01 16:00:00", "2010-06-01 18:00:00"]


def test_elements_and_years(spark, tmp_path):
    (tmp_path / "e.tle").write_text("1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927\n2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537\n")
    r = readers.orbital_elements(spark, str(tmp_path / "e.tle")).first()
    assert r.satellite == 25544 and str(r.epoch).startswith("2008-09-20 12:25:40") and r.eccentricity == pytest.approx(0.0006703) and r.motion == pytest.approx(15.72125391, rel=1e-7)
    wide = spark.createDataFrame([("01", 5, 6)], "fips string, P2000 long, P2001 long")
    other = spark.createDataFrame([("01", 9, 7)], "fips string, P2001 long, P2002 long")
    out = readers.first_vintage([readers.years_long(wide, ["fips"], "P", range(2000, 2002), 0), readers.years_long(other, ["fips"], "P", range(2001, 2003), 1)], ["fips", "year"])
    assert sorted((r.year, r.value) for r in out.collect()) == [(2000, 5), (2001, 6), (2002, 7)]
    (tmp_path / "c.txt").write_text("header\n1 01001 1,000 2 3 4 5 6 7 8 9 10\n")
    assert readers.census_text_years(spark, str(tmp_path / "c.txt")).where("year = 1999").first().value == 1000


def test_manifests(spark):
    rows = [("a", 1, True, False, "h1"), ("a", 2, True, False, "h2"), ("a", 3, False, False, "h3"), ("a", 4, True, True, "h4"), ("../x", 5, True, False, "h")]
    m = spark.createDataFrame(rows, "dest string, line long, ok boolean, restoration boolean, sha256 string")
    latest = readers.latest_entries(m)
    assert [(r.dest, r.sha256) for r in latest.collect()] == [("a", "h2")]
    found = spark.createDataFrame([("a", "h2")], "dest string, sha256 string")
    assert readers.readiness(latest, found).first().status == "ready"


def test_registry_and_sinks(spark, tmp_path):
    path = str(tmp_path / "registry.jsonl")
    assert sinks.append_registry(path, {"family": "A", "effect": float("nan")}) == "T000001"
    assert sinks.append_registry(path, {"family": "B", "p_value": 0.5}) == "T000002"
    out = sinks.read_registry(spark, path).orderBy("test_id").collect()
    assert out[0].effect is None and out[1].p_value == 0.5
    with pytest.raises(ValueError):
        sinks.append_registry(path, {"nope": 1})
    df = spark.range(3)
    sinks.create_only(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.create_only(df, str(tmp_path / "t"))
    hidden = sinks.public_copy(spark.createDataFrame([("N", "x"), ("G", "y")], "source string, text string"), "source", "N", ["text"])
    assert [r.text for r in hidden.collect()] == [None, "y"]
