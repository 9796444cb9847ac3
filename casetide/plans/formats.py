"""Queries of readers and writers: rows of the test tables written in a catalog's format, read back and compared."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import shared_path
from ..sources import readers, sinks
from .registry import query, table


def _put(spark: SparkSession, path: str, content: bytes) -> str:
    """A small file in the shared store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(content))
    out.close()
    return path


def _lines(rows: DataFrame, line: Column) -> str:
    """``rows`` as text files, a line each."""
    folder = shared_path(rows.sparkSession)
    rows.select(line.alias("value")).write.text(folder)
    return folder


def _nations(spark: SparkSession, folder: str) -> list:
    return table(spark, folder, "nation").orderBy("n_nationkey").collect()  # 25 rows


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """CSV written in one part and read under a schema (SRC-04, SNK-03)."""
    path = shared_path(spark)
    sinks.write_result_csv(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.csv_table(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT n_nationkey::VARCHAR AS site, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS name FROM nation")
def units_tsv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """TSV with a ``#`` before its names and a line of remarks (SRC-05)."""
    rows = [f"{r.n_nationkey}\t{r.n_name if r.n_nationkey % 5 else '-'}" for r in _nations(spark, folder)]
    return readers.tsv_with_units(spark, _put(spark, f"{shared_path(spark)}/sites.tsv", "\n".join(["#site\tname", "# remark", *rows, ""]).encode()))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN '"' || s_name END AS s_name, s_acctbal FROM supplier""")
def gazetteer_scan(spark: SparkSession, folder: str) -> DataFrame:
    """TSV without header or quoting (SRC-06)."""
    rows = table(spark, folder, "supplier")
    name = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit('"'), F.col("s_name"))).otherwise("")
    return readers.gazetteer(spark, _lines(rows, F.concat_ws("\t", "s_suppkey", name, "s_acctbal")), "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT event_id, date_trunc('hour', ts) AS time, CASE WHEN event_id % 4 > 0 THEN value END AS value FROM events")
def ordinal_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Blank-separated numbers by place, days of the year as times (SRC-07, DTE-08)."""
    shown = F.when(F.col("event_id") % 4 > 0, F.col("value").cast("string")).otherwise("9999.0")
    path = _lines(table(spark, folder, "events"), F.concat_ws("  ", F.year("ts"), F.dayofyear("ts"), F.hour("ts"), shown, "event_id"))
    rows = readers.ordinal_columns(spark, path, {"y": (0, None), "d": (1, None), "h": (2, None), "value": (3, 9999.0), "id": (4, None)})
    return rows.select(F.col("id").cast("long").alias("event_id"), readers.day_of_year_time(rows.y, rows.d, rows.h).alias("time"), "value")


def _three_hour_lines(spark: SparkSession, folder: str) -> str:
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.col("p_partkey").cast("int"))
    values = [F.when(F.col("p_partkey") * k % 11 == 0, -1).otherwise(F.col("p_partkey") * k % 11).cast("string") for k in range(1, 9)]
    return _lines(table(spark, folder, "part"), F.concat_ws(" ", F.year(day), F.month(day), F.day(day), F.lit("0 0.5 1 1"), *values))


_PARTS = "SELECT DATE '1990-01-01' + p_partkey::INT AS day, k, CASE WHEN p_partkey * k % 11 > 0 THEN (p_partkey * k % 11)::DOUBLE END AS kp FROM part, range(1, 9) t(k)"


@query(f"SELECT day::TIMESTAMP + to_hours(3 * (k - 1)) AS time, kp FROM ({_PARTS})")
def three_hour_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Eight values a line as eight rows (SRC-08)."""
    return readers.three_hourly(spark, _three_hour_lines(spark, folder))


@query(f"SELECT day, max(kp) AS kp_max, sum(kp) AS kp_sum FROM ({_PARTS}) GROUP BY 1")
def daily_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Daily aggregates of the same lines (SRC-09)."""
    return readers.daily_of_three_hourly(spark, _three_hour_lines(spark, folder))


@query("""
SELECT DISTINCT date_trunc('day', o_orderdate) + to_hours(o_orderkey % 24) AS time, substr('ABCMXZ', 1 + (o_orderkey % 6)::INT, 1) AS cls, CASE WHEN o_custkey % 30 >= 10 THEN (o_custkey % 30) / 10 ELSE o_custkey % 30 END::DOUBLE AS mag
FROM orders WHERE o_orderkey % 6 < 5
""")
def flare_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records of fixed width with valid classes, equal ones once (SRC-10)."""
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    kind = F.substring(F.lit("ABCMXZ"), (1 + F.col("o_orderkey") % 6).cast("int"), F.lit(1))
    line = F.concat(F.lit(" " * 5), F.date_format("o_orderdate", "yyMMdd"), F.lit("  "), hour, F.lit("00" + " " * 42), kind, F.lpad((F.col("o_custkey") % 30).cast("string"), 3, " "))
    return readers.flares(spark, _lines(table(spark, folder, "orders"), line))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def parts_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping CSV parts as one table, filtered, rows of one key once (SRC-11)."""
    rows, paths = table(spark, folder, "customer").select("c_custkey", "c_acctbal"), []
    for part in (rows.where("c_custkey % 3 < 2"), rows.where("c_custkey % 3 > 0")):
        paths.append(shared_path(spark))
        sinks.write_result_csv(part, paths[-1])
    return readers.parts_once(spark, paths, "c_custkey long, c_acctbal double", ["c_custkey"], F.col("c_acctbal") > 0)


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN -n_nationkey ELSE n_nationkey END::DOUBLE AS lat, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey END::INT AS energy FROM nation")
def matrix_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """JSON of field names and rows of text, hemispheres as signs (SRC-12)."""
    data = [[r.n_name, str(r.n_nationkey), "NS"[r.n_nationkey % 2], str(r.n_regionkey) if r.n_nationkey % 4 else None] for r in _nations(spark, folder)]
    path = _put(spark, f"{shared_path(spark)}/m.json", json.dumps({"fields": ["name", "lat", "lat-dir", "energy"], "data": data}).encode())
    rows = readers.matrix_json(spark, path, {"name": "string", "lat": "double", "lat-dir": "string", "energy": "int"})
    return rows.select("name", readers.signed(F.col("lat"), F.col("lat-dir"), "S").alias("lat"), "energy")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS a FROM nation")
def nested_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Nested records under a key, behind a byte-order mark (SRC-13, ARR-03)."""
    records = [{"id": r.n_nationkey} | ({"key_vals": {"a": r.n_name}} if r.n_nationkey % 3 else {}) for r in _nations(spark, folder)]
    path = _put(spark, f"{shared_path(spark)}/n.json", b"\xef\xbb\xbf" + json.dumps({"recs": records}).encode())
    return readers.nested_json(spark, path, "recs", "id: int, key_vals: map<string,string>").select("id", F.try_element_at("key_vals", F.lit("a")).alias("a"))


@query("SELECT 'R' || n_regionkey AS article, DATE '2020-01-01' + n_nationkey AS date, (n_nationkey * 10)::BIGINT AS views FROM nation")
def page_views_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file an article, named in the file's path (SRC-14)."""
    path, rows = shared_path(spark), _nations(spark, folder)
    for region in {r.n_regionkey for r in rows}:
        items = [{"timestamp": f"202001{1 + r.n_nationkey:02d}00", "views": r.n_nationkey * 10} for r in rows if r.n_regionkey == region]
        _put(spark, f"{path}/wiki_pageviews_R{region}.json", json.dumps({"items": items}).encode())
    return readers.page_views(spark, path)


@query("SELECT n_name AS country, (2000 + n_nationkey)::INT AS year, CASE WHEN n_nationkey % 2 > 0 THEN n_nationkey / 4 END::DOUBLE AS value FROM nation")
def indicator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON list of a header and the rows (SRC-15)."""
    rows = [{"countryiso3code": r.n_name, "date": str(2000 + r.n_nationkey), "value": r.n_nationkey / 4 if r.n_nationkey % 2 else None} for r in _nations(spark, folder)]
    return readers.indicator_json(spark, _put(spark, f"{shared_path(spark)}/wb.json", json.dumps([{"page": 1}, rows]).encode()))


@query("SELECT n_name AS name, (n_nationkey * 2)::DOUBLE AS lat, (-n_nationkey)::DOUBLE AS lon FROM nation WHERE n_nationkey % 6 > 0")
def geojson_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Point features of GeoJSON; other shapes are left out (SRC-17)."""
    features = [{"properties": {"name": r.n_name}, "geometry": {"type": "Point" if r.n_nationkey % 6 else "MultiPoint", "coordinates": [-float(r.n_nationkey), r.n_nationkey * 2.0]}} for r in _nations(spark, folder)]
    return readers.geojson_points(spark, _put(spark, f"{shared_path(spark)}/g.json", json.dumps({"features": features}).encode()), "name: string")


@query("""
SELECT '123456-12345' AS station, TIMESTAMP '2020-01-01' + to_hours(n_nationkey) AS time, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey / 10 END::DOUBLE AS temp_c,
  CASE WHEN n_nationkey % 12 IN (9, 10) THEN 8 WHEN n_nationkey % 12 <= 8 THEN n_nationkey % 12 END::INT AS sky_oktas, CASE WHEN n_nationkey % 7 = 0 THEN 0.05 ELSE n_nationkey / 10 END::DOUBLE AS precip_1h_mm FROM nation WHERE n_nationkey < 24
""")
def station_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly station text in gzip, with missing values, covered skies and traces of rain (SRC-19)."""
    line = lambda k: f"2020 01 01 {k:02d} {k if k % 5 else -9999} 10 10132 90 35 {k % 12} {k if k % 7 else -1} 0"
    text = "\n".join(line(r.n_nationkey) for r in _nations(spark, folder) if r.n_nationkey < 24)
    path = _put(spark, f"{shared_path(spark)}/123456-12345-2020.gz", gzip.compress(text.encode()))
    return readers.station_hours(spark, path).select("station", "time", "temp_c", "sky_oktas", "precip_1h_mm")


@query("SELECT TIMESTAMP '2010-06-01 12:00:00' + to_hours(CASE n_nationkey % 3 WHEN 0 THEN 6 ELSE 4 END) AS time, n_nationkey::DOUBLE AS lat, (-n_nationkey)::DOUBLE AS lon, n_name AS kind FROM nation WHERE n_nationkey % 3 < 2")
def storm_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Storm reports in UTC by offset or zone word; unknown zones drop out (SRC-20)."""
    rows = [f"01-JUN-10 12:00:00,{('CST-6', 'EDT', 'SCT')[r.n_nationkey % 3]},{r.n_name},{r.n_nationkey},{-r.n_nationkey}" for r in _nations(spark, folder)]
    head = "BEGIN_DATE_TIME,CZ_TIMEZONE,EVENT_TYPE,BEGIN_LAT,BEGIN_LON"
    return readers.storm_reports(spark, _put(spark, f"{shared_path(spark)}/s.csv", "\n".join([head, *rows, ""]).encode()))


@query("""
SELECT p_partkey AS fips, year::INT AS year, CASE year WHEN 2002 THEN p_partkey ELSE p_size + year - 2000 END::BIGINT AS value FROM part, (VALUES (2000), (2001), (2002)) v(year)
""")
def vintages_long(spark: SparkSession, folder: str) -> DataFrame:
    """Year columns as rows; of several vintages the first that has a year (SRC-21)."""
    part = table(spark, folder, "part").withColumn("fips", F.col("p_partkey"))
    old = part.select("fips", F.col("p_size").alias("P2000"), (F.col("p_size") + 1).alias("P2001"))
    new = part.select("fips", F.lit(-1).alias("P2001"), F.col("p_partkey").alias("P2002"))
    long = [readers.years_long(old, ["fips"], "P", range(2000, 2002), 0), readers.years_long(new, ["fips"], "P", range(2001, 2003), 1)]
    return readers.first_vintage(long, ["fips", "year"])


@query("SELECT n_name || '.txt' AS name, strlen(n_name)::BIGINT AS bytes, sha256(n_name) AS sha256 FROM nation WHERE n_nationkey < 5")
def file_digest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of whole files (SRC-03)."""
    path = shared_path(spark)
    for r in _nations(spark, folder)[:5]:
        _put(spark, f"{path}/{r.n_name}.txt", r.n_name.encode())
    found = readers.file_digests(spark, path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes", "sha256")


@query("SELECT 'd' || s_suppkey AS dest, CASE s_suppkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'ready' ELSE 'changed' END AS status FROM supplier")
def manifest_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest appended twice; the last good entry of each destination against what is there (SRC-02, ORC-04, ORC-08)."""
    path, rows = shared_path(spark), table(spark, folder, "supplier")
    entry = lambda line, ok, dest: rows.select(dest.alias("dest"), F.lit(line).alias("line"), F.lit(ok).alias("ok"), F.concat(F.lit("h"), (F.col("s_suppkey") * line).cast("string")).alias("sha256"), F.lit(False).alias("restoration"))
    name = F.concat(F.lit("d"), F.col("s_suppkey"))
    for df in (entry(1, True, name), entry(2, True, name), entry(3, False, name), entry(4, True, F.concat(F.lit("../"), name))):
        sinks.append_manifest(df, path)
    manifest = spark.read.schema("dest string, line int, ok boolean, sha256 string, restoration boolean").json(path)
    found = rows.where("s_suppkey % 3 > 0").select(name.alias("dest"), F.concat(F.lit("h"), F.when(F.col("s_suppkey") % 3 == 1, F.col("s_suppkey") * 2).otherwise(0).cast("string")).alias("sha256"))
    return readers.readiness(readers.latest_entries(manifest), found).select("dest", "status")


@query("SELECT n_regionkey AS region, CASE WHEN n_regionkey <> 1 THEN n_name END AS name, n_nationkey AS nation FROM nation")
def tables_written(spark: SparkSession, folder: str) -> DataFrame:
    """A partitioned table replaced as a whole, a table that must not exist, one source's text hidden (SNK-01, SNK-02, SNK-06, SNK-07)."""
    rows = table(spark, folder, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    path, once = shared_path(spark), shared_path(spark)
    sinks.write_table(rows.limit(3), path)
    sinks.write_table(rows, path, ["region"])
    back = spark.read.parquet(path).select(F.col("region").cast("int").alias("region"), "name", "nation")
    sinks.create_only(sinks.public_copy(back, "region", 1, ["name"]), once)
    return spark.read.parquet(once)


@query("""
SELECT unnest(['| source | files | bytes |', '|-|-|-|', '| asia | ' || count(*) FILTER (n_regionkey = 2) || ' | ' || sum(n_nationkey) FILTER (n_regionkey = 2) || ' |', '| other | ' || count(*) FILTER (n_regionkey <> 2) || ' | ' || sum(n_nationkey) FILTER (n_regionkey <> 2) || ' |']) AS line FROM nation
""")
def manifest_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes by group as a Markdown table (SNK-08, AGG-20)."""
    manifest = table(spark, folder, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey"), F.lit("/"), F.col("n_name")).alias("dest"), F.col("n_nationkey").cast("long").alias("bytes"))
    text = sinks.summary_markdown(manifest, [("asia", "^r2/")])
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query("SELECT c_nationkey, round(1 - product(1 - CASE WHEN c_custkey % 5 IN (0, 1) THEN 0 ELSE (c_custkey % 5) / 100.0 END), 8) AS chance FROM customer GROUP BY 1")
def noisy_or_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy-or of a group; null and NaN count as 0 (AGG-08)."""
    k = F.col("c_custkey") % 5
    chance = F.when(k == 1, F.lit(float("nan"))).when(k > 1, k / 100.0)
    return table(spark, folder, "customer").withColumn("p", chance).groupBy("c_nationkey").agg(F.round(X.noisy_or_agg("p"), 8).alias("chance"))
