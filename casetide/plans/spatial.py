"""Queries of places: nearest sites, radius counts, neighbours and spatial statistics, on synthetic coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import controls, spatial, spatial_stats
from .registry import query, sql_haversine, sql_lat, sql_lon, table


def _placed(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumns({lat: (F.col(key) * 37) % 12000 / 100.0 - 60, lon: (F.col(key) * 91) % 36000 / 100.0 - 180})


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(table(spark, folder, "customer"), "c_custkey")


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(table(spark, folder, "supplier").withColumn("k", F.col("s_suppkey") * 131), "k", "site_lat", "site_lon")


_C = f"SELECT *, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon FROM customer"
_S = f"SELECT *, {sql_lat('(s_suppkey * 131)')} AS site_lat, {sql_lon('(s_suppkey * 131)')} AS site_lon FROM supplier"
_H = sql_haversine("lat", "lon", "site_lat", "site_lon")


@query(f"WITH c AS ({_C}), s AS ({_S}) SELECT c_custkey, round(min({_H}), 4) AS dist_km, arg_min(s_suppkey, (round({_H}, 9), s_suppkey)) AS s_suppkey FROM c, s GROUP BY 1")
def haversine_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's nearest supplier (JON-13, MTH-01)."""
    out = spatial.nearest_site(_customers(spark, folder).select("c_custkey", "lat", "lon"), _sites(spark, folder), "c_custkey", "s_suppkey")
    return out.select("c_custkey", F.round("dist_km", 4).alias("dist_km"), "s_suppkey")


@query(f"WITH c AS ({_C}), s AS ({_S}) SELECT c_custkey, count(*) FILTER ({_H} <= 1500) AS n_within, round(coalesce(sum(s_acctbal) FILTER ({_H} <= 1500), 0), 2) AS s_acctbal_within FROM c, s GROUP BY 1")
def radius_count_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers within 1,500 km and the sum of their balances (JON-15, JON-16)."""
    out = spatial.within_radius(_customers(spark, folder), _sites(spark, folder), 1500.0, "c_custkey", attribute="s_acctbal")
    return out.select("c_custkey", "n_within", F.round(F.col("s_acctbal_within").cast("double"), 2).alias("s_acctbal_within"))


@query(f"""
WITH c AS ({_C}), s AS (SELECT *, 1992 + s_suppkey % 7 AS start_year, CASE WHEN s_suppkey % 3 > 0 THEN 1994 + s_suppkey % 5 END AS end_year FROM ({_S})),
p AS (SELECT c_custkey, lat, lon, 1992 + c_custkey % 7 AS year FROM c),
m AS (SELECT p.*, CASE WHEN year >= start_year AND (end_year IS NULL OR year <= end_year) THEN {_H} END AS d FROM p, s)
SELECT c_custkey, count(*) FILTER (d <= 2000) AS n_active, round(min(d) FILTER (d <= 2000), 4) AS nearest_active_km FROM m GROUP BY 1
""")
def year_valid_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Sites active in the point's year, counted and nearest, open ends included (JON-18)."""
    end = F.when(F.col("s_suppkey") % 3 > 0, 1994 + F.col("s_suppkey") % 5)
    sites = _sites(spark, folder).withColumns({"start_year": 1992 + F.col("s_suppkey") % 7, "end_year": end})
    points = _customers(spark, folder).withColumn("year", 1992 + F.col("c_custkey") % 7)
    out = spatial.valid_sites(points, sites, 2000.0, "c_custkey")
    return out.select("c_custkey", "n_active", F.round("nearest_active_km", 4).alias("nearest_active_km"))


@query(f"""
WITH s AS ({_S}), m AS (SELECT a.s_suppkey AS site, b.s_suppkey AS neighbour, round({sql_haversine('a.site_lat', 'a.site_lon', 'b.site_lat', 'b.site_lon')}, 6) AS d FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, neighbour) AS rank FROM m)
SELECT site, rank, neighbour, round(d, 3) AS km, round(sum(d) OVER (PARTITION BY site ORDER BY rank), 3) AS reach FROM r WHERE rank <= 8
""")
def k_nearest_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Eight nearest sites of each and the running distance along them (JON-14, WIN-08)."""
    near = spatial.neighbours(_sites(spark, folder), 8, "s_suppkey", ("site_lat", "site_lon"))
    out = spatial.cumulative_by_rank(near, "s_suppkey", "km", "reach")
    return out.select(F.col("s_suppkey").alias("site"), F.col("rank").cast("long").alias("rank"), "neighbour", F.round("km", 3).alias("km"), F.round("reach", 3).alias("reach"))


@query(f"""
WITH c AS ({_C}) SELECT a.c_custkey AS a, b.c_custkey AS b, round({sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS km
FROM c a JOIN c b ON a.c_custkey < b.c_custkey AND abs(a.lat - b.lat) < 2 WHERE {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 150
""")
def radius_self_join(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of customers at most 150 km apart (JON-17)."""
    return spatial.close_pairs(_customers(spark, folder), 150.0, "c_custkey").select("a", "b", F.round("km", 4).alias("km"))


@query(f"""
WITH c AS ({_C}), p AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM c a JOIN c b ON a.c_custkey < b.c_custkey AND abs(a.lat - b.lat) < 2.5 WHERE {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200)
SELECT count(*) AS close_pairs, count(*) FILTER (abs((a * 7919) % 1000 - (b * 7919) % 1000) <= 20) AS observed FROM p
""")
def knox_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs close in place and time (STA-21); the permutation p is in ``knox_permuted``."""
    return _knox(spark, folder, 1).select("close_pairs", "observed")


@query(None)
def knox_permuted(spark: SparkSession, folder: str) -> DataFrame:
    """Knox test with 49 permutations of times (STA-21)."""
    return _knox(spark, folder, 49)


def _knox(spark: SparkSession, folder: str, replicates: int) -> DataFrame:
    events = _customers(spark, folder).select("c_custkey", "lat", "lon", ((F.col("c_custkey") * 7919) % 1000).alias("t"))
    return spatial_stats.knox(events, "c_custkey", "t", 200.0, 20.0, replicates)


@query(f"""
WITH s AS ({_S}), z AS (SELECT s_suppkey, site_lat, site_lon, s_acctbal - avg(s_acctbal) OVER () AS z FROM s),
m AS (SELECT a.s_suppkey AS a, a.z AS za, b.z AS zb, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY round({sql_haversine('a.site_lat', 'a.site_lon', 'b.site_lat', 'b.site_lon')}, 6), b.s_suppkey) AS k FROM z a JOIN z b ON a.s_suppkey <> b.s_suppkey)
SELECT round((SELECT sum(za * zb) FROM m WHERE k <= 8) / 8 / (SELECT sum(z * z) FROM z), 6) AS morans_i
""")
def morans_i_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Spatial autocorrelation over eight neighbours (STA-19); the permutation p is in ``morans_i_permuted``."""
    return _moran(spark, folder, 1).select(F.round("morans_i", 6).alias("morans_i"))


@query(None)
def morans_i_permuted(spark: SparkSession, folder: str) -> DataFrame:
    """Moran's I with 49 permutations (STA-19)."""
    return _moran(spark, folder, 49)


def _moran(spark: SparkSession, folder: str, replicates: int) -> DataFrame:
    return spatial_stats.morans_i(_sites(spark, folder), "s_acctbal", "s_suppkey", 8, replicates, at=("site_lat", "site_lon"))


@query(None)
def scan_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Circular scan over suppliers' places: orders served against an even spread (STA-20, SRT-05)."""
    served = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    areas = _sites(spark, folder).join(served, "s_suppkey", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "e": F.lit(1.0)})
    found = spatial_stats.scan_clusters(areas, "s_suppkey", "n", "e", at=("site_lat", "site_lon"), most_share=0.1, most_km=3000.0, simulations=19)
    return spark.createDataFrame(found or [], "centre long, radius_km double, n_areas long, observed double, expected double, rr double, llr double, p_mc double")


_BOXES = [(15.0, 72.0, -170.0, -50.0), (35.0, 60.0, -12.0, 20.0)]


@query(f"""
WITH c AS ({_C}), m AS (SELECT *, degrees(250 / 6371.0088) AS up, sin(250 / 6371.0088) / cos(radians(lat)) AS ratio FROM c),
g AS (SELECT *, degrees(asin(least(1.0, ratio))) AS side FROM m)
SELECT c_custkey, abs(lat) + up < 90 AND ratio < 1 AND ({' OR '.join(f'(lat - up >= {s} AND lat + up <= {n} AND lon - side >= {w} AND lon + side <= {e})' for s, n, w, e in _BOXES)}) AS supported,
  floor(lat / 0.5)::BIGINT || '_' || floor(lon / 0.5)::BIGINT AS cell FROM g
""")
def catalog_support(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a circle of 250 km lies wholly in a catalog's boxes, and the half-degree cell (FLT-21, MTH-12)."""
    return _customers(spark, folder).select("c_custkey", X.circle_in_boxes("lat", "lon", 250.0, _BOXES).alias("supported"), X.half_degree_cell("lat", "lon").alias("cell"))


@query(f"""
WITH c AS ({_C}), r AS (SELECT c_custkey, radians(lat) AS a, radians(lon) AS o, radians((c_custkey * 17) % 360) AS b, 300 / 6371.0 AS d FROM c), t AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b)) AS la FROM r)
SELECT c_custkey, round(degrees(la), 6) AS to_lat, round(degrees(o + atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * sin(la))), 6) AS to_lon FROM t
""")
def destination_points(spark: SparkSession, folder: str) -> DataFrame:
    """300 km along a bearing (MTH-02)."""
    lat, lon = X.destination("lat", "lon", (F.col("c_custkey") * 17) % 360, F.lit(300.0))
    return _customers(spark, folder).select("c_custkey", F.round(lat, 6).alias("to_lat"), F.round(lon, 6).alias("to_lon"))


_SQUARES = [("west", -100.0, -20.0), ("middle", -20.0, 60.0), ("east", 60.0, 140.0)]


@query(f"WITH c AS ({_C}) SELECT c_custkey, CASE " + " ".join(f"WHEN lat > -30 AND lat < 30 AND lon > {w} AND lon < {e} THEN '{n}'" for n, w, e in _SQUARES) + " END AS area FROM c WHERE lat NOT IN (-30, 30) AND lon NOT IN (-100, -20, 60, 140)")
def point_in_polygon(spark: SparkSession, folder: str) -> DataFrame:
    """The first polygon that holds a point (JON-20); points on an edge are left out, as neither side owns them."""
    polygons = [(n, [[(w, -30.0), (e, -30.0), (e, 30.0), (w, 30.0), (w, -30.0)]]) for n, w, e in _SQUARES]
    c = _customers(spark, folder).where(~F.col("lat").isin(-30.0, 30.0) & ~F.col("lon").isin(-100.0, -20.0, 60.0, 140.0))
    return c.select("c_custkey", spatial.containing_polygon(polygons, F.col("lat"), F.col("lon")).alias("area"))


@query(None)
def polygon_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Distance to the nearest polygon, 0 inside (JON-21)."""
    polygons = [[[(w, -30.0), (e, -30.0), (e, 30.0), (w, 30.0), (w, -30.0)]] for _, w, e in _SQUARES[::2]]
    return _customers(spark, folder).select("c_custkey", F.round(spatial.polygon_distance(polygons, F.col("lat"), F.col("lon")), 3).alias("km"))


@query(None)
def spatial_controls(spark: SparkSession, folder: str) -> DataFrame:
    """Four places a case, drawn by population in its country and decile (DOM-10, MTH-10)."""
    places = _sites(spark, folder).select(F.col("s_suppkey").alias("place_id"), F.col("site_lat").alias("place_lat"), F.col("site_lon").alias("place_lon"), (F.col("s_nationkey") % 2).alias("country"), (F.col("s_acctbal") + 2000).alias("population"))
    edges = controls.decile_edges(places, "population", ["country"], least=1)  # the places' own edges hold for the cases, too
    places = controls.deciles(places, edges, "population", ["country"])
    cases = controls.deciles(_customers(spark, folder).select(F.col("c_custkey").alias("event_id"), "lat", "lon", (F.col("c_nationkey") % 2).alias("country"), (F.col("c_acctbal") + 2000).alias("population")).where("population > 0"), edges, "population", ["country"], "decile")
    return controls.spatial_controls(cases.drop("population"), places, seed=20261004).select("event_id", "offset", "place_id")


@query("""
WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 5) AS s FROM a x JOIN a y ON x.vec_id <> y.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM m) SELECT a, rank, b, s AS similarity FROM r WHERE rank <= 3
""")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Three nearest vectors by cosine: a block-wise matrix product, the vectors being the stated query set (JON-14)."""
    return _nearest_vectors(table(spark, folder, "embeddings"), 3)


def _nearest_vectors(vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    import numpy as np
    import pandas as pd

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        unit = lambda f: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))(np.stack(f["embedding"]).astype(np.float32).astype(np.float64))
        s = np.round(unit(left) @ unit(right).T, 5)
        ids_a, ids_b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        s[ids_a[:, None] == ids_b] = -2
        order = np.lexsort((np.broadcast_to(ids_b, s.shape), -s), axis=1)[:, :k]
        out = pd.DataFrame({"a": np.repeat(ids_a, order.shape[1]), "b": ids_b[order].ravel(), "similarity": np.take_along_axis(s, order, axis=1).ravel()})
        return out[out.similarity > -2]

    blocks = max(1, -(-vectors.count() // block))
    dealt = vectors.select("vec_id", "embedding").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = dealt.withColumn("meet", F.explode(F.transform(every, lambda j: F.col("part") * blocks + j)))
    right = dealt.withColumn("meet", F.explode(F.transform(every, lambda i: i * blocks + F.col("part"))))
    met = left.groupBy("meet").cogroup(right.groupBy("meet")).applyInPandas(best, "a long, b long, similarity double")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("a", "rank", "b", "similarity")
