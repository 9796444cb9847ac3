"""Queries of reports and events: hashes, scores, clusters, cohorts, sets, aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import controls, events, exposure
from .registry import query, sql_haversine, sql_lat, sql_lon, table


@query("""
WITH u AS (SELECT o_orderkey, year(o_orderdate) AS y, ('0x' || substr(sha256('20261004:' || o_orderkey), 1, 8))::BIGINT / 4294967295.0 AS u FROM orders)
SELECT o_orderkey, round(u, 9) AS u, CASE WHEN y >= 1998 THEN 'holdout_temporal' WHEN u < 0.6 THEN 'discovery' WHEN u < 0.8 THEN 'validation' ELSE 'holdout_random' END AS split FROM u
""")
def split_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Frozen split by SHA-256, late years apart (MTH-11, DOM-07)."""
    u = X.hash_uniform(20261004, "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", F.round(u, 9).alias("u"), X.split_label(u, F.year("o_orderdate") >= 1998).alias("split"))


@query("""
WITH u AS (SELECT o_orderkey, ('0x' || substr(sha256('20261004:' || o_orderkey), 1, 8))::BIGINT / 4294967295.0 AS u FROM orders),
s AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN u < 0.6 THEN 'discovery' WHEN u < 0.8 THEN 'validation' ELSE 'holdout_random' END AS split FROM u)
SELECT split, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS sha256_ids FROM s GROUP BY split
""")
def split_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of each split's ids (DOM-07)."""
    u = X.hash_uniform(20261004, "o_orderkey")
    return events.split_manifest(table(spark, folder, "orders").select(F.col("o_orderkey").alias("event_id"), X.split_label(u).alias("split")))


@query("""
SELECT l_orderkey, l_linenumber, round(1 - (1 - l_discount * 5) * (1 - l_tax * 10) * (1 - least(1.0, l_quantity / 50)), 9) AS p_any,
  floor((1 - exp(sum(ln(greatest(1e-300, 1 - l_discount))) OVER (PARTITION BY l_orderkey))) * 10000 + 1e-6)::BIGINT AS p_order_1e4 FROM lineitem
""")
def noisy_or_score(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy-or across columns and within a group (AGG-08)."""
    li = table(spark, folder, "lineitem")
    group = li.groupBy("l_orderkey").agg(F.floor(X.noisy_or_agg("l_discount") * 10000 + 1e-6).alias("p_order_1e4"))
    p = X.noisy_or(F.col("l_discount") * 5, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    return li.join(group, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(p, 9).alias("p_any"), "p_order_1e4")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS d, l_tax * 6 AS t, l_quantity / 100 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN greatest(d, t, q) < 0.05 THEN 'none' WHEN d = greatest(d, t, q) THEN 'discount' WHEN t = greatest(d, t, q) THEN 'tax' ELSE 'quantity' END AS top,
  CASE WHEN greatest(d, t, q) >= 0.6 THEN 'LIKELY_EXPLAINED' WHEN greatest(d, t, q) >= 0.3 THEN 'AMBIGUOUS' ELSE 'UNEXPLAINED_BY_MATCHER' END AS status FROM p
""")
def argmax_label(spark: SparkSession, folder: str) -> DataFrame:
    """The largest of several chances, first of equals, and the status label (AGG-09, ARR-04, DOM-04)."""
    values = [F.col("l_discount") * 5, F.col("l_tax") * 6, F.col("l_quantity") / 100]
    top = X.first_largest(["discount", "tax", "quantity"], values, 0.05)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", top.alias("top"), X.explained_label(F.greatest(*values)).alias("status"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) AS n_orders, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top_price FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) = 1
""")
def representative_row(spark: SparkSession, folder: str) -> DataFrame:
    """The best order of each customer with group facts beside it (AGG-04, AGG-07, WIN-12, SRT-01)."""
    own = Window.partitionBy("o_custkey")
    o = table(spark, folder, "orders").withColumns({"n_orders": F.count(F.lit(1)).over(own), "top_price": F.max("o_totalprice").over(own)})
    ranked = o.withColumn("k", F.row_number().over(own.orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")))
    return ranked.where("k = 1").select("o_custkey", "o_orderkey", "o_totalprice", "n_orders", "top_price")


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS n_status, bool_or(o_orderstatus = 'P') AS any_pending, round(median(o_totalprice), 4) AS median_price, floor(avg(o_totalprice) * 100 + 1e-4)::BIGINT AS mean_cents FROM orders GROUP BY 1
""")
def distinct_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted distinct text, distinct counts, any, median and mean (AGG-01 to AGG-03, AGG-05, AGG-06)."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"), F.countDistinct("o_orderstatus").alias("n_status"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("median_price"), F.floor(F.avg("o_totalprice") * 100 + 1e-4).alias("mean_cents"),
    )


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def counts_pivoted(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by kind as columns, 0 where there are none (AGG-13, AGG-14)."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, folder, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)


@query("""
WITH d AS (SELECT lang, l.quality, l.toxic FROM documents JOIN labels l USING (doc_id)), u AS (UNPIVOT d ON quality, toxic INTO NAME label VALUE v)
SELECT lang, label, count(*) AS n, round(avg(v), 6) AS rate, round(avg((v >= 0.3)::INT), 6) AS share FROM u GROUP BY ALL
""")
def exposure_unpivot_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by language of several labels at once (AGG-16, AGG-17)."""
    d = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id")
    long = d.unpivot(["lang"], ["quality", "toxic"], "label", "v")
    return long.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("rate"), F.round(F.avg((F.col("v") >= 0.3).cast("int")), 6).alias("share"))


@query("""
SELECT year(ts) AS year, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_share, round(avg((event_type = 'purchase')::INT), 6) AS purchase_share,
  round((count(*) FILTER (event_type = 'error' AND day(ts) <= 15)) / nullif(count(*) FILTER (event_type = 'error' AND day(ts) > 15), 0), 6) AS half_ratio FROM events GROUP BY 1
""")
def rates_and_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares and the ratio of two windows, null where the second is empty (AGG-15, AGG-21)."""
    err = F.col("event_type") == "error"
    early, late = F.count_if(err & (F.day("ts") <= 15)), F.count_if(err & (F.day("ts") > 15))
    return table(spark, folder, "events").groupBy(F.year("ts").alias("year")).agg(
        F.round(F.count_if(err) / F.count(F.lit(1)), 6).alias("error_share"), F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("purchase_share"), F.round(F.try_divide(early, late), 6).alias("half_ratio")
    )


# ------------------------------------------------------------------ reports, clusters, quality


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as reports: a day, a time for most, a synthetic place near that of their customer."""
    o = table(spark, folder, "orders")
    key = F.col("o_custkey")
    timed = F.col("o_orderkey") % 4 != 0
    return o.select(
        F.col("o_orderkey").alias("report_id"), F.to_date("o_orderdate").alias("day"),
        F.when(timed, X.epoch_us("o_orderdate") / 1e6 + (F.col("o_orderkey") * 613) % 86400).alias("t"),
        ((key % 60) * 37 % 12000 / 100.0 - 60).alias("lat"), ((key % 60) * 91 % 36000 / 100.0 - 180).alias("lon"),
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 40).cast("double")).alias("radius_km"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 90).cast("double")).alias("uncertainty_min"),
        F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 100 / 100.0).alias("p_explained"), (F.col("o_totalprice") % 1000 / 100.0).alias("information_quality"),
    )


_REPORTS = """SELECT o_orderkey AS report_id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 4 <> 0 THEN epoch_us(o_orderdate) / 1e6 + (o_orderkey * 613) % 86400 END AS t,
  (o_custkey % 60) * 37 % 12000 / 100.0 - 60 AS lat, (o_custkey % 60) * 91 % 36000 / 100.0 - 180 AS lon, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 40)::DOUBLE END AS radius_km,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 90)::DOUBLE END AS uncertainty_min, o_orderpriority AS source, o_orderkey % 100 / 100.0 AS p_explained, o_totalprice % 1000 / 100.0 AS information_quality FROM orders"""
_LINKED = f"""
m AS (SELECT a.report_id AS x, b.report_id AS y, a.day = b.day AS same_day, abs(a.t - b.t) AS dt, {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d,
  coalesce(a.radius_km, 50) + coalesce(b.radius_km, 50) AS rr, least(greatest(3600.0, 60 * (coalesce(a.uncertainty_min, 720) + coalesce(b.uncertainty_min, 720))), 10800.0) AS tol
  FROM r a JOIN r b ON b.day BETWEEN a.day AND a.day + 1 AND a.report_id <> b.report_id),
p AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM m WHERE CASE WHEN dt IS NOT NULL THEN dt <= tol AND d <= greatest(50.0, rr) ELSE same_day AND d <= greatest(100.0, rr) END)"""


@query(f"WITH r AS ({_REPORTS}), {_LINKED} SELECT a, b FROM p")
def date_block_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of reports of one event: same or next day, near in time and place (JON-19)."""
    return events.linked_pairs(_reports(spark, folder))


_CLUSTERED = f"""
WITH RECURSIVE r AS ({_REPORTS}), {_LINKED}, z AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
k(node, root) AS (SELECT DISTINCT x, x FROM z UNION SELECT z.y, k.root FROM k JOIN z ON z.x = k.node), c AS (SELECT node, min(root) AS root FROM k GROUP BY node)"""


@query(f"{_CLUSTERED} SELECT report_id, coalesce(root, report_id) AS cluster_id FROM r LEFT JOIN c ON c.node = r.report_id")
def dup_components(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of reports: the least id reachable (DOM-05)."""
    r = _reports(spark, folder)
    return events.clusters(r, events.linked_pairs(r), "report_id").select("report_id", "cluster_id")


@query(f"""
{_CLUSTERED}, g AS (SELECT r.*, coalesce(root, report_id) AS cluster_id FROM r LEFT JOIN c ON c.node = r.report_id),
f AS (SELECT cluster_id, count(*) AS report_count, count(DISTINCT source) AS source_count, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, round(min(p_explained), 6) AS p_min, max(information_quality) AS best FROM g GROUP BY 1),
d AS (SELECT a.cluster_id, max({sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS km FROM g a JOIN g b USING (cluster_id) GROUP BY 1),
h AS (SELECT cluster_id, report_id FROM g QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY information_quality DESC NULLS LAST, t NULLS LAST, report_id) = 1)
SELECT cluster_id, report_id, report_count, source_count, sources, p_min, report_count >= 2 AND km >= 10 AS separated_witnesses, round(least(10.0, best + (report_count >= 2 AND km >= 10)::INT), 4) AS event_quality,
  least(10.0, best + (report_count >= 2 AND km >= 10)::INT) >= 7 AS high_quality FROM f JOIN d USING (cluster_id) JOIN h USING (cluster_id)
""")
def event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event: best report, counts, sources, separated witnesses, quality (DOM-06, AGG-10)."""
    r = _reports(spark, folder)
    out = events.rolled_up(events.clusters(r, events.linked_pairs(r), "report_id"))
    return out.select("cluster_id", "report_id", "report_count", "source_count", "sources", F.round("p_explained_min", 6).alias("p_min"), "separated_witnesses", F.round("event_quality", 4).alias("event_quality"), "high_quality")


@query("""
WITH q AS (SELECT o_orderkey AS report_id, o_orderkey % 800 AS tu, o_custkey % 70 AS rad, (o_orderkey * 7) % 12000 AS dur, 1 + o_custkey % 9 AS n FROM orders),
p AS (SELECT report_id, CASE WHEN tu <= 15 THEN 1.0 WHEN tu <= 30 THEN 0.5 WHEN tu <= 60 THEN 0.0 ELSE -1.0 END AS q_time, CASE WHEN rad <= 10 THEN 1.0 WHEN rad <= 25 THEN 0.5 WHEN rad <= 50 THEN 0.0 ELSE -2.0 END AS q_loc,
  CASE WHEN dur BETWEEN 60 AND 3600 THEN 1.0 WHEN dur >= 10 AND dur < 60 OR dur > 3600 AND dur <= 10800 THEN 0.5 WHEN dur > 10800 THEN -0.5 ELSE 0.0 END AS q_dur,
  CASE report_id % 3 WHEN 0 THEN least(1.5, 0.75 * log2(n)) WHEN 1 THEN least(1.5, 0.75 * log2(n)) / 2 ELSE 0 END AS q_wit FROM q)
SELECT report_id, q_time, q_loc, q_dur, round(q_wit, 6) AS q_wit, round(least(10.0, greatest(0.0, 3 + q_time + q_loc + q_dur + q_wit + CASE WHEN report_id % 2 = 0 THEN 1 ELSE 0 END - 0.5)), 6) AS information_quality FROM p
""")
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    """Additive quality of a report (AGG-11)."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    parts = events.information_quality({
        "uncertainty_min": (key % 800).cast("double"), "date_precision": F.lit("day"), "radius_km": (F.col("o_custkey") % 70).cast("double"), "duration_s": (key * 7 % 12000).cast("double"), "witnesses": (1 + F.col("o_custkey") % 9).cast("double"),
        "witness_basis": F.get(F.array(F.lit("structured"), F.lit("text_lower_bound"), F.lit("none")), (key % 3).cast("int")), "witness_type": F.lit(""), "radar": F.lit("NOT_REPORTED"), "photo": F.when(key % 2 == 0, "YES_STRUCTURED").otherwise("NOT_REPORTED"),
        "video": F.when(key % 2 == 1, "NOT_REPORTED"), "delay_days": F.lit(None).cast("double"), "source": F.lit("HATCH"), "hoax": F.lit(False),
    })
    shown = {k: parts[k] for k in ("q_time", "q_loc", "q_dur")} | {k: F.round(parts[k], 6) for k in ("q_wit",)}
    return o.select(key.alias("report_id"), *[v.alias(k) for k, v in shown.items()], F.round(parts["information_quality"], 6).alias("information_quality"))


@query("SELECT o_orderkey, substr(sha256(coalesce(o_orderstatus, 'None') || '|' || o_custkey || '|' || CASE WHEN o_orderkey % 7 = 0 THEN 'None' ELSE o_orderpriority END), 1, 16) AS record_hash FROM orders")
def record_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of a raw record with nulls spelled out (TXT-15)."""
    priority = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    return table(spark, folder, "orders").select("o_orderkey", X.record_hash(F.col("o_orderstatus"), F.col("o_custkey"), priority).alias("record_hash"))


# ------------------------------------------------------------------ cohorts, subsets, sets


def _cohort_events(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))
    return o.select(
        k.alias("event_id"), pick(_SOURCES, k % 5).alias("source"), pick(_COUNTRIES, F.col("o_custkey") % 8).alias("country"), pick(_SPLITS, k % 4).alias("split"),
        pick(("north_america", "europe_fr", None), k % 3).alias("geo_region"), F.when(k % 11 != 0, k * 1.0).alias("t"), (k % 900).cast("double").alias("uncertainty_min"),
    )


_SOURCES = ("NUFORC", "NUFORC", "GEIPAN", "HATCH", "NICAP")
_COUNTRIES = ("US", " usa ", "Canada", "FR", "", None, "unknown", "GB")
_SPLITS = ("discovery", "validation", "holdout_random", "holdout_temporal")


def _sql_pick(values, by: str) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[({by} + 1)::INT]"


_COHORT = f"SELECT o_orderkey AS event_id, {_sql_pick(_SOURCES, 'o_orderkey % 5')} AS source, upper(trim(coalesce({_sql_pick(_COUNTRIES, 'o_custkey % 8')}, ''))) AS country, {_sql_pick(_SPLITS, 'o_orderkey % 4')} AS split, {_sql_pick(('north_america', 'europe_fr', None), 'o_orderkey % 3')} AS geo_region, o_orderkey % 11 <> 0 AND o_orderkey % 900 < 720 AS timed FROM orders"


@query(f"""
WITH e AS ({_COHORT}), h AS (SELECT *, country IN ('US', 'USA', 'CA', 'CANADA') AS home, country NOT IN ('', 'UNKNOWN', 'UNK', 'NOT_REPORTED', 'N/A', 'NA') AS known FROM e)
SELECT cohort, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM (
SELECT 'discovery' AS cohort, event_id FROM h WHERE source = 'NUFORC' AND split = 'discovery' AND home AND NOT starts_with(coalesce(geo_region, ''), 'europe_')
UNION ALL SELECT 'E1_validation', event_id FROM h WHERE source = 'NUFORC' AND home AND split = 'validation' AND timed UNION ALL SELECT 'E2_holdout_random', event_id FROM h WHERE source = 'NUFORC' AND home AND split = 'holdout_random' AND timed
UNION ALL SELECT 'E3_holdout_temporal', event_id FROM h WHERE source = 'NUFORC' AND home AND split = 'holdout_temporal' AND timed UNION ALL SELECT 'E4_geo_GEIPAN', event_id FROM h WHERE source = 'GEIPAN' AND timed
UNION ALL SELECT 'E5_geo_NUFORC_nonUS', event_id FROM h WHERE source = 'NUFORC' AND known AND NOT home AND timed UNION ALL SELECT 'E6_src_HATCH', event_id FROM h WHERE source = 'HATCH' AND timed UNION ALL SELECT 'E8_src_NICAP', event_id FROM h WHERE source = 'NICAP' AND timed)
GROUP BY cohort
""")
def cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Discovery and evaluation cohorts in one pass (FLT-03, FLT-05, FLT-07, FLT-08)."""
    named = {"discovery": exposure.discovery_cohort()} | exposure.evaluation_cohorts()
    rows = exposure.labelled(_cohort_events(spark, folder), named, "cohort")
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query("""
WITH e AS (SELECT o_orderkey AS event_id, o_orderkey % 3 = 0 AS hq, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS un, o_orderkey % 7 = 0 AS ms, o_orderkey % 100 / 100.0 AS p FROM orders)
SELECT subset, count(*) AS n FROM (SELECT 'ALL' AS subset FROM e UNION ALL SELECT 'HQ' FROM e WHERE hq UNION ALL SELECT 'HQ_UNEXPLAINED' FROM e WHERE hq AND un UNION ALL SELECT 'MULTI_SENSOR' FROM e WHERE ms
UNION ALL SELECT 'UNEXPLAINED' FROM e WHERE un UNION ALL SELECT 'EXPLAINED' FROM e WHERE p >= 0.6) GROUP BY subset
""")
def overlapping_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """Six overlapping subsets in one pass (FLT-09 to FLT-11)."""
    k = F.col("o_orderkey")
    e = table(spark, folder, "orders").select((k % 3 == 0).alias("high_quality"), F.when(k % 5 != 0, k % 2 == 0).alias("unexplained"), (k % 7 == 0).alias("multi_sensor"), (k % 100 / 100.0).alias("p_explained"))
    return exposure.labelled(e, exposure.subsets(), "subset").groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS dist, CASE WHEN l_quantity > 10 THEN l_discount * 100 END AS kp, l_tax * 100 - 4 AS alt, l_discount * 10 AS illum FROM lineitem)
SELECT l_orderkey, l_linenumber, (dist <= 25)::INT::DOUBLE AS within25_airport, round(CASE WHEN dist IS NOT NULL THEN log10(greatest(0.5, dist)) END, 6) AS log_dist_airport_km, (kp >= 5)::INT::DOUBLE AS kp_storm5_prior24h, round((alt > 0)::INT * illum, 6) AS moon_up_illum FROM p
""")
def derived_exposures(spark: SparkSession, folder: str) -> DataFrame:
    """Exposures by name, null where a raw column is (FLT-02, FLT-16 to FLT-19, MTH-09)."""
    q = F.col("l_quantity")
    p = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 > 0, q).alias("dist_airport_km"), F.when(q > 10, F.col("l_discount") * 100).alias("kp_max_prior24h"), (F.col("l_tax") * 100 - 4).alias("moon_alt"), (F.col("l_discount") * 10).alias("moon_illum")
    )
    d = exposure.derived(p)
    return d.select("l_orderkey", "l_linenumber", "within25_airport", F.round("log_dist_airport_km", 6).alias("log_dist_airport_km"), "kp_storm5_prior24h", F.round("moon_up_illum", 6).alias("moon_up_illum"))


@query("""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'F')
SELECT k AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v
""")
def version_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows added, removed or changed between two versions (JON-03, DOM-12)."""
    o = table(spark, folder, "orders")
    old = o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderstatus <> 'F'").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return controls.changed_rows(old, new, ["o_orderkey"], ["o_totalprice"])


@query("""
SELECT s.src, count(*) AS n_left_out, count(DISTINCT e.user_id) AS n_users FROM (SELECT DISTINCT event_type AS src FROM events) s JOIN events e ON e.event_type <> s.src GROUP BY 1
""")
def leave_one_source_out(spark: SparkSession, folder: str) -> DataFrame:
    """Pools without one source, in one pass (SET-07)."""
    e = table(spark, folder, "events")
    kinds = [r.event_type for r in e.select("event_type").distinct().collect()]  # a handful of sources
    pools = e.withColumn("src", F.explode(F.array_except(F.array(*map(F.lit, sorted(kinds))), F.array("event_type"))))
    return pools.groupBy("src").agg(F.count(F.lit(1)).alias("n_left_out"), F.countDistinct("user_id").alias("n_users"))


@query("""
SELECT kind, key, name, balance FROM (SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part)
""")
def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with different columns as one table, gaps null (SET-01, SET-05, SRC-24)."""
    parts = [
        table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        table(spark, folder, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("kind", "key", "name", "balance")


@query("""
SELECT c.c_custkey, n.n_name, r.r_name, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_acctbal BETWEEN 0 AND 9000 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c.c_custkey AND x.o_orderpriority LIKE '1-%') GROUP BY ALL
""")
def lookup_and_semi_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Left, lookup and semi joins with a range predicate (FLT-01, FLT-04, JON-01, JON-02, JON-04, JON-05)."""
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer").where(F.col("c_acctbal").between(0, 9000))
    c = c.join(o.where(F.col("o_orderpriority").startswith("1-")), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    counts = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    out = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 ORDER BY quantity DESC, l_partkey LIMIT 25")
def top_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 parts sold most (SRT-02, SRT-06)."""
    return table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity")).orderBy(F.desc("quantity"), "l_partkey").limit(25)


@query("""
SELECT o_orderkey, CASE WHEN y IS NULL THEN 'no_year' WHEN y < 1994 THEN 'pre_1900' WHEN y > 1997 THEN 'future_or_bad_year' ELSE '' END AS reason,
  CASE WHEN y > 1997 AND y <= 1998 THEN '' WHEN y IS NULL THEN 'no_year' WHEN y < 1994 THEN 'pre_1900' WHEN y > 1998 THEN 'future_or_bad_year' ELSE '' END AS readmitted
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE year(o_orderdate) END AS y FROM orders)
""".replace("y < 1994", "y - 94 < 1900"))
def exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """First reason that holds, and who is let back in (FLT-06, FLT-12, FLT-13)."""
    y = F.when(F.col("o_orderkey") % 13 != 0, F.year("o_orderdate"))
    shifted = F.when(y - 94 < 1900, F.lit(1800)).otherwise(y)
    reason = events.exclusion(shifted, 1997)
    return table(spark, folder, "orders").select("o_orderkey", reason.alias("reason"), events.readmitted(reason, shifted, 1998).alias("readmitted"))
