"""Readers of the catalogs' formats. Each returns a DataFrame; parsing is Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MISSING_STATION = -9999
#: Hours from UTC of time-zone words in storm reports (fixed values).
STORM_ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AST": -4, "HST": -10, "AKST": -9, "AKDT": -8, "SST": -11, "GST": 10, "GMT": 0, "UTC": 0}


def csv_table(spark: SparkSession, path, schema: str, *, sep: str = ",", header: bool = True, **options) -> DataFrame:
    """Delimited text under a declared schema; unreadable values become null."""
    return spark.read.options(header=header, sep=sep, mode="PERMISSIVE", enforceSchema=True, **options).schema(schema).csv(path)


def tsv_with_units(spark: SparkSession, path: str) -> DataFrame:
    """TSV whose names follow a ``#`` and whose second line holds units or a remark; all columns as text."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#")).first()
    names = [n.strip() for n in head.value.lstrip("#").split("\t")] if head else []
    cells = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return body.select(*[F.nullif(F.trim(F.get(cells, i)), F.lit("-")).alias(n) for i, n in enumerate(names)])


def gazetteer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """TSV without header or quoting."""
    return csv_table(spark, path, schema, sep="\t", header=False, quote="")


def ordinal_columns(spark: SparkSession, path: str, columns: dict[str, tuple[int, float | None]]) -> DataFrame:
    """Blank-separated numbers by place; each column has its place and the value that means missing."""
    cells = F.split(F.trim("value"), r"\s+")
    pick = lambda i, gap: F.get(cells, i).try_cast("double") if gap is None else F.nullif(F.get(cells, i).try_cast("double"), F.lit(float(gap)))
    return spark.read.text(path).where(F.trim("value") != "").select(*[pick(i, gap).alias(n) for n, (i, gap) in columns.items()])


def day_of_year_time(year: Column, day: Column, hour: Column) -> Column:
    """Time without zone from year, day of the year (1 is 1 January) and hour."""
    start = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    return F.timestamp_add("HOUR", hour.cast("int"), F.date_add(start, day.cast("int") - 1).cast("timestamp_ntz"))


def three_hourly(spark: SparkSession, path: str, first_value: int = 7, n: int = 8) -> DataFrame:
    """(time, kp): the eight three-hour values of each day's line; ``#`` lines are remarks, negative values missing."""
    cells = F.split(F.trim("value"), r"\s+")
    day = F.make_date(*[F.get(cells, i).try_cast("int") for i in range(3)])
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    spread = rows.select(day.alias("day"), F.posexplode(F.slice(cells, first_value + 1, n)).alias("k", "v"))
    value = spread.v.try_cast("double")
    return spread.select(F.timestamp_add("HOUR", F.col("k") * 3, F.col("day").cast("timestamp_ntz")).alias("time"), F.when(value >= 0, value).alias("kp"))


def daily_of_three_hourly(spark: SparkSession, path: str, first_value: int = 7, n: int = 8) -> DataFrame:
    """(day, kp_max, kp_sum) of the same lines."""
    cells = F.split(F.trim("value"), r"\s+")
    values = F.filter(F.transform(F.slice(cells, first_value + 1, n), lambda c: c.try_cast("double")), lambda v: v >= 0)
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    day = F.make_date(*[F.get(cells, i).try_cast("int") for i in range(3)])
    return rows.select(day.alias("day"), F.array_max(values).alias("kp_max"), F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v)).alias("kp_sum"))


def fixed_width(spark: SparkSession, path, fields: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Records by column: name to (first, length, type); values that don't parse are null; equal records once."""
    part = lambda a, n, kind: F.nullif(F.trim(F.substring("value", a, n)), F.lit("")).try_cast(kind)
    return spark.read.text(path).select(*[part(a, n, kind).alias(name) for name, (a, n, kind) in fields.items()]).distinct()


def flares(spark: SparkSession, path) -> DataFrame:
    """(time, cls, mag) of X-ray flare records: valid classes with a start time, distinct."""
    raw = fixed_width(spark, path, {"yy": (6, 2, "int"), "mm": (8, 2, "int"), "dd": (10, 2, "int"), "hhmm": (14, 4, "string"), "cls": (60, 1, "string"), "mag": (61, 3, "double")})
    year = F.when(F.col("yy") >= 60, F.col("yy") + 1900).otherwise(F.col("yy") + 2000)
    time = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %s:%s", year, "mm", "dd", F.substring("hhmm", 1, 2), F.substring("hhmm", 3, 2)), F.lit("yyyy-MM-dd HH:mm"))
    rows = raw.withColumn("time", time.cast("timestamp_ntz")).where(F.col("cls").isin("A", "B", "C", "M", "X") & F.col("time").isNotNull())
    return rows.select("time", "cls", (F.col("mag") / F.when(F.col("mag") >= 10, 10).otherwise(1)).alias("mag")).distinct()


def parts_once(spark: SparkSession, paths: list[str], schema: str, key: list[str], keep: Column) -> DataFrame:
    """Several CSV parts as one table, rows of one key once, filtered."""
    return csv_table(spark, paths, schema).where(keep).dropDuplicates(key)


def matrix_json(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """JSON of ``fields`` and ``data`` rows of text."""
    raw = spark.read.schema("fields array<string>, data array<array<string>>").json(path, multiLine=True)
    row = raw.select("fields", F.explode("data").alias("r"))
    at = lambda n: F.get("r", (F.array_position("fields", n) - 1).cast("int"))
    return row.select(*[at(n).try_cast(t).alias(n) for n, t in types.items()])


def signed(value: Column, hemisphere: Column, negative: str) -> Column:
    return F.when(hemisphere == negative, -value).otherwise(value)


def nested_json(spark: SparkSession, path: str, key: str, record_schema: str) -> DataFrame:
    """The records of the list under ``key``; a byte-order mark at the start does no harm."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    parsed = text.select(F.from_json("v", f"struct<`{key}`: array<struct<{record_schema}>>>").alias("j"))
    return parsed.select(F.explode(F.col(f"j.`{key}`")).alias("r")).select("r.*")


def page_views(spark: SparkSession, path: str, marker: str = "wiki_pageviews_") -> DataFrame:
    """(article, date, views) of one JSON file an article, named in the file's path."""
    raw = spark.read.schema("items array<struct<timestamp: string, views: bigint>>").json(path, multiLine=True)
    article = F.regexp_extract(F.col("_metadata.file_name"), marker + r"(.+)\.json$", 1)
    rows = raw.select(article.alias("article"), F.explode("items").alias("i"))
    return rows.select("article", F.try_to_timestamp(F.substring("i.timestamp", 1, 8), F.lit("yyyyMMdd")).cast("date").alias("date"), "i.views")


def indicator_json(spark: SparkSession, path: str) -> DataFrame:
    """(country, year, value) of a list of a header and the rows."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$[1]"), "array<struct<countryiso3code: string, date: string, value: double>>")).alias("r"))
    return rows.select(F.col("r.countryiso3code").alias("country"), F.col("r.date").try_cast("int").alias("year"), "r.value")


def geojson_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features with their properties; lat, lon."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    return rows.select("f.properties.*", F.get("f.geometry.coordinates", 1).alias("lat"), F.get("f.geometry.coordinates", 0).alias("lon"))


def station_hours(spark: SparkSession, path) -> DataFrame:
    """Hourly station text (gzip or plain; unreadable files are skipped): station, time, temperature, dew point,
    pressure, wind direction and speed, sky, rain in one and six hours. Sky codes 9 and 10 count as covered (8)."""
    cells = F.split(F.trim("value"), r"\s+")
    value = lambda i: F.nullif(F.get(cells, i).try_cast("int"), F.lit(MISSING_STATION))
    rows = spark.read.option("ignoreCorruptFiles", "true").text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{6}-\d{5})", 1).alias("station"))
    time = F.timestamp_add("HOUR", F.get(cells, 3).try_cast("int"), F.make_date(*[F.get(cells, i).try_cast("int") for i in range(3)]).cast("timestamp_ntz"))
    sky, trace = value(9), lambda i: F.when(value(i) == -1, 0.05).otherwise(value(i) / 10)
    return rows.where(F.size(cells) >= 12).select(
        "station", time.alias("time"), (value(4) / 10).alias("temp_c"), (value(5) / 10).alias("dewpt_c"), (value(6) / 10).alias("slp_hpa"), value(7).alias("wind_dir"), (value(8) / 10).alias("wind_ms"),
        F.when(sky.isin(9, 10), 8).when(sky.between(0, 8), sky).alias("sky_oktas"), trace(10).alias("precip_1h_mm"), trace(11).alias("precip_6h_mm"),
    )


def storm_reports(spark: SparkSession, path) -> DataFrame:
    """(time, lat, lon, kind) in UTC; a zone that is neither a known word nor ends in a number drops the row."""
    raw = csv_table(spark, path, "BEGIN_DATE_TIME string, CZ_TIMEZONE string, EVENT_TYPE string, BEGIN_LAT double, BEGIN_LON double")
    zone = F.upper(F.trim("CZ_TIMEZONE"))
    words = F.create_map(*[F.lit(x) for kv in STORM_ZONES.items() for x in kv])
    hours = F.coalesce(F.regexp_extract(zone, r"(-?\d+)$", 1).try_cast("int"), F.try_element_at(words, F.regexp_extract(zone, r"^([A-Z]+)", 1)))
    local = F.try_to_timestamp("BEGIN_DATE_TIME", F.lit("dd-MMM-yy HH:mm:ss")).cast("timestamp_ntz")
    return raw.select(F.timestamp_add("HOUR", -hours, local).alias("time"), F.col("BEGIN_LAT").alias("lat"), F.col("BEGIN_LON").alias("lon"), F.col("EVENT_TYPE").alias("kind")).where("time IS NOT NULL")


def years_long(wide: DataFrame, keys: list[str], prefix: str, years: range, priority: int) -> DataFrame:
    """Wide year columns as rows, with the vintage's priority."""
    long = wide.unpivot(keys, [F.col(f"{prefix}{y}").cast("long").alias(str(y)) for y in years], "year", "value")
    return long.withColumn("year", F.col("year").cast("int")).withColumn("priority", F.lit(priority))


def first_vintage(vintages: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key: of the vintage with the least priority that has it."""
    order = Window.partitionBy(*keys).orderBy("priority", F.col("value").isNull())
    rows = reduce(lambda a, b: a.unionByName(b), vintages)
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "priority")


def census_text_years(spark: SparkSession, path: str, first: int = 1999) -> DataFrame:
    """(fips, year, value) of text lines: a 1, five digits of place, then yearly counts with commas, latest first."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^1\s+\d{5}\s+[\d,]+"))
    spread = rows.select(F.get(cells, 1).alias("fips"), F.posexplode(F.slice(cells, 3, 10)).alias("k", "v"))
    return spread.select("fips", (F.lit(first) - F.col("k")).alias("year"), F.replace("v", F.lit(","), F.lit("")).try_cast("long").alias("value"))


def orbital_elements(spark: SparkSession, path: str) -> DataFrame:
    """(satellite, epoch, inclination, node, eccentricity, perigee, anomaly, motion) of two-line sets in epoch order."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(r"(?m)^(1 [^\r\n]{67,68})\r?\n2 [^\r\n]{61,68}"), 1).alias("a"), F.regexp_extract_all("value", F.lit(r"(?m)^1 [^\r\n]{67,68}\r?\n(2 [^\r\n]{61,68})"), 1).alias("b"))
    pairs = text.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select("z.a", "z.b")
    number = lambda line, at, n: F.trim(F.substring(line, at, n)).try_cast("double")
    yy, day = number("a", 19, 2), number("a", 21, 12)
    start = F.make_date((yy + F.when(yy < 57, 2000).otherwise(1900)).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    epoch = F.timestamp_add("MICROSECOND", F.round((day - 1) * 86_400_000_000).cast("long"), start)
    fields = {"inclination": (9, 8), "node": (18, 8), "perigee": (35, 8), "anomaly": (44, 8), "motion": (53, 11)}
    return pairs.select(number("a", 3, 5).cast("int").alias("satellite"), epoch.alias("epoch"), *[number("b", at, n).alias(k) for k, (at, n) in fields.items()], (number("b", 27, 7) / 1e7).alias("eccentricity")).orderBy("epoch")


def file_digests(spark: SparkSession, path) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def latest_entries(manifest: DataFrame, dest: str = "dest", order: str = "line", ok: str = "ok", restoration: str = "restoration") -> DataFrame:
    """Of each destination the last successful entry that is no restoration; destinations that climb out are refused."""
    good = manifest.where(F.coalesce(F.col(ok), F.lit(False)) & ~F.coalesce(F.col(restoration), F.lit(False)) & ~F.col(dest).rlike(r"(^/)|(^|/)\.\.(/|$)"))
    return good.withColumn("__k", F.row_number().over(Window.partitionBy(dest).orderBy(F.desc(order)))).where("__k = 1").drop("__k")


def readiness(manifest: DataFrame, found: DataFrame, dest: str = "dest") -> DataFrame:
    """Each destination's status: ready, missing or changed, by digest."""
    met = manifest.select(dest, F.col("sha256").alias("expected")).join(found.select(dest, "sha256"), dest, "left")
    return met.withColumn("status", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "ready").otherwise("changed"))
