"""Boundaries, missing values and edge cases of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from casetide.functions import exprs as X
from casetide.functions import text as T
from casetide.operators import asof, controls, events, exposure, rangejoin, spatial, windows


def test_windows_are_closed_and_missing_is_not_zero(spark):
    points = spark.createDataFrame([(1, 100.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, 100.0, None, 0.0), (4, 5.0, 0.0, 0.0)], "point_id long, t double, lat double, lon double")
    one_km = math.degrees(1 / X.EARTH_KM)
    catalog = spark.createDataFrame([(90.0, 0.0, 0.0, 1.0), (110.0, 0.0, 0.0, float("nan")), (100.0, one_km * 0.999999, 0.0, 3.0), (100.0, 5.0, 0.0, 9.0), (None, 0.0, 0.0, 1.0)], "t double, lat double, lon double, v double")
    out = {r.point_id: r for r in rangejoin.window_counts(points, catalog, {"w": (-10, 10)}, [1.0], value="v", coverage=(0.0, 1000.0)).collect()}
    assert (out[1].n_w_1km, out[1].max_w_1km) == (3, 3.0)
    assert out[2].n_w_1km is None and out[3].n_w_1km is None and out[4].n_w_1km is None
    plain = {r.point_id: r.n_w for r in rangejoin.window_counts(points, catalog, {"w": (-10, 10)}).collect()}
    assert plain == {1: 4, 2: None, 3: 4, 4: 0}
    empty = rangejoin.window_counts(points, catalog.limit(0), {"w": (-10, 10)}).collect()
    assert all(r.n_w is None for r in empty)


def test_windows_of_many_scales(spark):
    points = spark.createDataFrame([(1, 1e6)], "point_id long, t double")
    catalog = spark.createDataFrame([(1e6 + d,) for d in (-2.6e6, -86400.0, -30.0, 0.0, 59.0, 86400.0)], "t double")
    out = rangejoin.window_counts(points, catalog, {"m": (-60, 60), "d": (-86400, 86400), "month": (-30 * 86400, 30 * 86400)}).first()
    assert (out.n_m, out.n_d, out.n_month) == (3, 5, 5 if 2.6e6 > 30 * 86400 else 6)


def test_backward_keeps_null_measurements(spark):
    probes = spark.createDataFrame([(1, 10.0), (1, 25.0), (2, 5.0)], "k long, t double")
    series = spark.createDataFrame([(1, 0.0, 7.0), (1, 10.0, None)], "k long, t double, v double")
    out = {(r.k, r.t): (r.matched_t, r.v) for r in asof.backward(probes, series, ["k"], ["v"], tolerance=15.0, closed=False).collect()}
    assert out == {(1, 10.0): (10.0, None), (1, 25.0): (None, None), (2, 5.0): (None, None)}


def test_nearest_ties_and_tolerance(spark):
    probes = spark.createDataFrame([(1, 100.0), (2, 500.0)], "id long, t double")
    series = spark.createDataFrame([(90.0, 1.0), (110.0, 2.0), (591.0, 3.0)], "t double, v double")
    run = lambda later: {r.id: (r.age, r.v) for r in asof.nearest(probes, series, ["v"], probe_id="id", tolerance=90.0, later_wins=later).collect()}
    assert run(True) == {1: (10.0, 2.0), 2: (None, None)}
    assert run(False)[1] == (-10.0, 1.0)


def test_radius_join_wraps(spark):
    points = spark.createDataFrame([(1, 0.0, 179.99), (2, 89.9, 10.0), (3, 45.0, 5.0)], "id long, lat double, lon double")
    sites = spark.createDataFrame([(1, 0.0, -179.99), (2, 89.9, -170.0), (3, 45.0, 7.0), (4, -89.0, 0.0)], "s long, site_lat double, site_lon double")
    out = {r.id: r.n_within for r in spatial.within_radius(points, sites, 30.0, "id").collect()}
    assert out == {1: 1, 2: 1, 3: 0}


def test_nearest_site_by_rings_equals_inline(spark, monkeypatch):
    points = spark.createDataFrame([(i, (i * 37 % 170) - 85.0, (i * 91 % 360) - 180.0) for i in range(40)] + [(99, None, 0.0)], "id long, lat double, lon double")
    sites = spark.createDataFrame([(i, (i * 53 % 160) - 80.0, (i * 71 % 360) - 180.0) for i in range(15)], "s long, site_lat double, site_lon double")
    inline = {r.id: (r.s, round(r.dist_km or -1, 6)) for r in spatial.nearest_site(points, sites, "id", "s").collect()}
    monkeypatch.setattr(spatial, "INLINE_SITES", 3)
    rings = {r.id: (r.s, round(r.dist_km or -1, 6)) for r in spatial.nearest_site(points, sites, "id", "s").collect()}
    assert inline == rings and rings[99] == (None, -1)


def test_polygons():
    import numpy as np

    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
    assert spatial.inside(square, np.array([1.0, 3.0]), np.array([1.0, 1.0])).tolist() == [True, False]
    d = spatial.distance_km(square, np.array([1.0, 3.0]), np.array([1.0, 0.0]))
    assert d[0] == 0 and d[1] == pytest.approx(111.195, rel=1e-3)


def test_daylight_saving(spark):
    cases = spark.createDataFrame([(1, dt.datetime(2015, 3, 15, 4, 30), "America/New_York"), (2, dt.datetime(2015, 3, 15, 6, 30), "America/New_York"), (3, None, "UTC")], "event_id long, utc_ts timestamp_ntz, zone string")
    refs = controls.month_referents(cases)
    one = {r.offset: r.utc_ts for r in refs.where("event_id = 1").collect()}
    assert one[-1] == dt.datetime(2015, 3, 8, 4, 30) or one[-1] == dt.datetime(2015, 3, 8, 5, 30)
    assert all(abs((v - dt.datetime(2015, 3, 15, 4, 30)).days) <= 30 for v in one.values())
    gap = {r.offset for r in refs.where("event_id = 2").collect()}  # 02:30 local doesn't exist on 8 March
    assert -1 not in gap
    check = controls.referent_check(cases.where("event_id < 3"), refs.drop("strategy")).first()
    assert (check.clock_mismatch, check.weekday_mismatch) == (0, 0)
    forward = spark.createDataFrame([(dt.datetime(2015, 3, 8, 2, 30), "America/New_York"), (dt.datetime(2015, 3, 8, 4, 30), "America/New_York")], "l timestamp, z string")
    moved = [r[0] for r in forward.select(F.date_format(X.shift_forward(F.col("l"), F.col("z")), "HH:mm")).collect()]
    assert moved == ["07:00", "08:30"]


def test_clusters_of_chains(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "n long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 52), (52, 55)], "a long, b long")
    out = {r.n: r.cluster_id for r in events.clusters(nodes, chain, "n").collect()}
    assert all(out[i] == 0 for i in range(41)) and out[45] == 45 and out[55] == 50


def test_exposures_keep_missing(spark):
    rows = spark.createDataFrame([(25.0, 0.0, 5.0), (25.01, None, None), (None, 1.0, 4.0)], "dist_large_airport_km double, wiki_ufo_views double, kp_max_prior24h double")
    out = exposure.derived(rows.withColumn("within9_gone", F.lit(1.0))).collect()
    assert [r.within25_large_airport for r in out] == [1.0, 0.0, None]
    assert [r.log_wiki_views for r in out] == [None, None, 0.0]
    assert [r.kp_storm5_prior24h for r in out] == [1.0, None, 0.0]
    assert "within9_gone" not in out[0].asDict()
    with pytest.raises(ValueError):
        exposure.subset("NOPE")


def test_names_route_to_kinds():
    kinds = {"any_gquake_pm1h_25km": "grid_quake", "iss_visible_win": "iss", "wx_clear": "weather", "any_eq_pre1d_25km": "quake", "starlink_10d": "launch", "log_wiki_views": "media", "moon_up_illum": "astro", "within25_coast": "spatial", "kp_max_prior24h": "space_weather", "zzz": "unsupported"}
    assert {k: exposure.exposure_kind(k) for k in kinds} == kinds
    assert (exposure.window_label("any_eq_pre1d_25km"), exposure.radius_label("any_eq_pre1d_25km"), exposure.radius_label("within5_x")) == ("pre1d", "25", "5")


def test_negation_ends_with_the_clause(spark):
    texts = ["not a plane", "not that. a plane", "no; a plane", "it was a plane", "unlike the very long and winding row of things a plane", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    flags = [r[0] for r in rows.select(T.affirmed(F.col("t"), T.DESCRIPTIONS["aircraft_word"])).collect()]
    assert flags == [False, True, True, True, True, False]


def test_onsets_need_known_calm(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 3.0, 6.0, 6.0, 1.0, None, 2.0, 7.0])], "k long, d long, v double")
    assert [r.d for r in windows.onsets(rows, "v", ["k"], "d").collect()] == [3]


def test_circle_support(spark):
    rows = spark.createDataFrame([(50.0, 0.0), (35.5, 0.0), (None, 0.0), (89.99, 0.0)], "lat double, lon double")
    out = [r[0] for r in rows.select(X.circle_in_boxes("lat", "lon", 100.0, [(35.0, 60.0, -12.0, 20.0)])).collect()]
    assert out == [True, False, False, False]


def test_sun_moves_with_the_clock(spark):
    rows = spark.createDataFrame([(dt.datetime(2020, 3, 20, 12, m),) for m in (0, 8)], "ts timestamp_ntz")
    ra, dec = X.sun_ra_dec("ts")
    a, b = [r[0] for r in rows.select(X.altitude_deg(ra, dec, "ts", F.lit(0.0), F.lit(88.2))).collect()]
    assert a - b == pytest.approx(2.0, abs=0.05)
