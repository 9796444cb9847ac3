"""Queries of windows in time, as-of lookups, series and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import asof, controls, matched, rangejoin, windows
from .registry import DAY, HOUR, query, sql_haversine, sql_lat, sql_lon, table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their time in seconds and a synthetic place."""
    e = table(spark, folder, "events")
    lat = (F.col("event_id") * 37) % 12000 / 100.0 - 60
    lon = (F.col("event_id") * 91) % 36000 / 100.0 - 180
    return e.withColumns({"us": X.epoch_us("ts"), "t": X.epoch_us("ts") / 1e6, "lat": lat, "lon": lon})


_E = f"SELECT *, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, {sql_lat('event_id')} AS lat, {sql_lon('event_id')} AS lon FROM events"

_FLAGSHIP = f"""
WITH e AS ({_E}),
b AS (SELECT min(t) AS lo, max(t) AS hi FROM e),
p AS (SELECT event_id, k AS shift, (k = 0)::INT AS is_case, t + k * {DAY} AS t FROM e, (VALUES (-14), (-7), (0), (7), (14)) s(k) WHERE event_type = 'purchase'),
c AS (SELECT p.* FROM p, b WHERE t - {HOUR} >= lo AND t <= hi),
n AS (SELECT c.event_id, c.shift, count(e.t) AS n FROM c LEFT JOIN e ON e.event_type = 'error' AND e.t BETWEEN c.t - {HOUR} AND c.t GROUP BY ALL),
u AS (SELECT c.event_id, c.is_case, n.n, sum(is_case) OVER w AS cases, count(*) OVER w AS size FROM c JOIN n USING (event_id, shift) WINDOW w AS (PARTITION BY c.event_id))
SELECT is_case, count(*) AS n_rows, sum(n)::BIGINT AS n_errors, count(*) FILTER (n > 0) AS n_exposed FROM u WHERE cases = 1 AND size >= 2 GROUP BY is_case
"""


@query(_FLAGSHIP)
def flagship_case_crossover_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase against the same user one and two weeks off: errors in the hour before (FLT-15, JON-06, AGG-12)."""
    e = _events(spark, folder)
    span = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    shifts = F.explode(F.array(*map(F.lit, (-14, -7, 0, 7, 14)))).alias("shift")
    points = e.where("event_type = 'purchase'").select("event_id", F.col("t").alias("t0"), shifts)
    points = points.select("event_id", (F.col("shift") == 0).cast("int").alias("is_case"), (F.col("t0") + F.col("shift") * DAY).alias("t"), F.concat_ws(":", "event_id", "shift").alias("point_id"))
    counted = rangejoin.window_counts(points, e.where("event_type = 'error'").select("t"), {"prior1h": (-HOUR, 0)}, coverage=(span.lo, span.hi))
    sets = matched.usable_sets(counted, ["n_prior1h"])
    return sets.groupBy("is_case").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_prior1h").cast("long").alias("n_errors"), F.count_if(F.col("n_prior1h") > 0).alias("n_exposed"))


_W = {"pm5m": (-300, 300), "pre1h": (-HOUR, 0), "pre1d": (-DAY, 0), "post7d": (0, 7 * DAY)}


@query(
    f"WITH e AS ({_E}) SELECT p.event_id, "
    + ", ".join(f"count(*) FILTER (c.t - p.t BETWEEN {a} AND {b}) AS n_{n}" for n, (a, b) in _W.items())
    + f" FROM e p LEFT JOIN e c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.t - p.t BETWEEN {-DAY} AND {7 * DAY} WHERE p.event_type = 'purchase' GROUP BY p.event_id"
)
def window_count_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks of the same user in windows of minutes to a week (JON-06 with a key, several scales)."""
    e = _events(spark, folder)
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    out = rangejoin.window_counts(points, e.where("event_type = 'click'").select("user_id", "t"), _W, point_id="event_id", keys=["user_id"])
    return out.select("event_id", *[f"n_{n}" for n in _W])


_R = (500, 2000)


@query(f"""
WITH e AS ({_E}), b AS (SELECT min(t) AS lo, max(t) AS hi FROM e WHERE event_type = 'error'),
m AS (SELECT p.event_id, p.t, c.t - p.t AS dt, c.value, {sql_haversine('p.lat', 'p.lon', 'c.lat', 'c.lon')} AS d
      FROM e p LEFT JOIN e c ON c.event_type = 'error' AND c.t - p.t BETWEEN {-6 * HOUR} AND {3 * HOUR} WHERE p.event_type = 'purchase')
SELECT event_id, """ + ", ".join(
    f"CASE WHEN any_value(m.t) + {a} >= any_value(lo) AND any_value(m.t) + {z} <= any_value(hi) THEN {f} FILTER (dt BETWEEN {a} AND {z} AND d <= {r}) END AS {k}_{n}_{r}km"
    for n, (a, z) in {"pre6h": (-6 * HOUR, 0), "pm3h": (-3 * HOUR, 3 * HOUR)}.items() for r in _R for k, f in (("n", "count(*)"), ("max", "max(value)"))
) + " FROM m, b GROUP BY event_id")
def window_radius_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and maxima by window and radius, null outside the catalog's coverage (JON-06, DOM-14, DOM-17)."""
    e = _events(spark, folder)
    errors = e.where("event_type = 'error'").select("t", "lat", "lon", "value")
    span = errors.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    points = e.where("event_type = 'purchase'").select("event_id", "t", "lat", "lon")
    w = {"pre6h": (-6 * HOUR, 0), "pm3h": (-3 * HOUR, 3 * HOUR)}
    out = rangejoin.window_counts(points, errors, w, list(_R), point_id="event_id", value="value", coverage=(span.lo, span.hi))
    return out.select("event_id", *[c for c in out.columns if c.startswith(("n_", "max_"))])


@query(f"""
WITH e AS ({_E}) SELECT p.event_id,
  (count(*) FILTER (c.event_type = 'error' AND c.t - p.t BETWEEN {-72 * HOUR} AND {-24 * HOUR}) > 0 AND count(*) FILTER (c.event_type = 'signup' AND c.t - p.t BETWEEN {-24 * HOUR} AND 0) > 0)::INT::DOUBLE AS seq
FROM e p LEFT JOIN e c ON c.user_id = p.user_id AND c.event_type IN ('error', 'signup') AND c.t - p.t BETWEEN {-72 * HOUR} AND 0 WHERE p.event_type = 'purchase' GROUP BY p.event_id
""")
def ordered_pair_indicator(spark: SparkSession, folder: str) -> DataFrame:
    """An error one to three days before, then a signup within the day (DOM-18)."""
    e = _events(spark, folder)
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    kind = lambda k: e.where(F.col("event_type") == k).select("user_id", "t")
    a = rangejoin.window_counts(points, kind("error"), {"a": (-72 * HOUR, -24 * HOUR)}, point_id="event_id", keys=["user_id"])
    b = rangejoin.window_counts(a, kind("signup"), {"b": (-24 * HOUR, 0)}, point_id="event_id", keys=["user_id"])
    return rangejoin.ordered_pair(b, "n_a", "n_b", "seq").select("event_id", "seq")


@query(f"""
WITH e AS ({_E}), s AS (SELECT user_id, us, max(value) AS value FROM e WHERE event_type = 'click' GROUP BY ALL)
SELECT p.event_id, CASE WHEN p.us - s.us < {6 * HOUR * 1_000_000} THEN s.us END AS matched_us, CASE WHEN p.us - s.us < {6 * HOUR * 1_000_000} THEN s.value END AS value
FROM e p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.us >= s.us WHERE p.event_type = 'purchase'
""")
def asof_last_event_by_user(spark: SparkSession, folder: str) -> DataFrame:
    """The user's last click less than six hours before each purchase (JON-07, JON-10)."""
    e = _events(spark, folder)
    series = e.where("event_type = 'click'").groupBy("user_id", "us").agg(F.max("value").alias("value"))
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    out = asof.backward(probes, series, ["user_id"], ["value"], time="us", tolerance=6 * HOUR * 1_000_000, closed=False)
    return out.select("event_id", "matched_us", "value")


@query(f"""
WITH e AS ({_E}), s AS (SELECT us, max(value) AS value FROM e WHERE event_type = 'error' GROUP BY us)
SELECT p.event_id, CASE WHEN p.us - s.us <= {2 * HOUR * 1_000_000} THEN s.us END AS matched_us, CASE WHEN p.us - s.us <= {2 * HOUR * 1_000_000} THEN s.value END AS value
FROM e p ASOF LEFT JOIN s ON p.us >= s.us WHERE p.event_type = 'purchase'
""")
def asof_global_series(spark: SparkSession, folder: str) -> DataFrame:
    """The last error at most two hours before, in a series without a key (JON-08, JON-09)."""
    e = _events(spark, folder)
    probes = e.where("event_type = 'purchase'").select("event_id", "us")
    out = asof.within(probes, e.where("event_type = 'error'").select("us", "value"), ["value"], probe_id="event_id", time="us", tolerance=2 * HOUR * 1_000_000)
    return out.select("event_id", "matched_us", "value")


@query(f"""
WITH e AS ({_E}), m AS (SELECT p.event_id, s.us - p.us AS age, s.value FROM e p JOIN e s ON s.event_type = 'click' AND s.user_id = p.user_id AND abs(s.us - p.us) <= {90 * 60_000_000 * 16} WHERE p.event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(age), age DESC, value DESC) AS k FROM m)
SELECT p.event_id, r.age, r.value FROM e p LEFT JOIN r ON r.event_id = p.event_id AND r.k = 1 WHERE p.event_type = 'purchase'
""")
def nearest_event_signed_age(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest click of the user within a day, with its signed age; ties go to the later (JON-11, JON-12)."""
    e = _events(spark, folder)
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    series = e.where("event_type = 'click'").select("user_id", "us", "value")
    return asof.nearest(probes, series, ["value"], probe_id="event_id", keys=["user_id"], time="us", tolerance=90 * 60_000_000 * 16).select("event_id", "age", "value")


@query(f"""
WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)
SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS max24h, min(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW) AS min72h,
  CASE WHEN count(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {6 * DAY - 1} PRECEDING AND CURRENT ROW) >= 3 THEN round(avg(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {6 * DAY - 1} PRECEDING AND CURRENT ROW), 6) END AS mean6
FROM e
""")
def rolling_range_max_min(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing maxima and minima by time, left end open, and a mean that needs three values (WIN-01, WIN-02, WIN-05)."""
    e = table(spark, folder, "events").withColumn("s", F.floor(X.epoch_us("ts") / 1_000_000))
    span = lambda n: windows.trailing(n, ["user_id"], "s")
    mean = windows.enough(F.col("value"), F.avg("value"), span(6 * DAY), 3)
    return e.select("event_id", F.max("value").over(span(DAY)).alias("max24h"), F.min("value").over(span(3 * DAY)).alias("min72h"), F.round(mean, 6).alias("mean6"))


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("v"))


_D = "SELECT event_type, ts::DATE AS day, count(*) AS n, round(avg(value), 4) AS v FROM events GROUP BY ALL"


@query(f"""
WITH d AS ({_D}) SELECT d.event_type, d.day, n - lag(n, 8) OVER w AS change8, d.n - p.n AS change7d, abs(d.n - lag(d.n) OVER w) AS step
FROM d LEFT JOIN (SELECT event_type, day + 7 AS day, n FROM d) p USING (event_type, day) WINDOW w AS (PARTITION BY d.event_type ORDER BY d.day)
""".replace("n - lag(n, 8)", "d.n - lag(d.n, 8)"))
def lags_and_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change over eight rows, over exactly seven days, and the absolute first difference (WIN-03, WIN-04, WIN-07)."""
    d = _daily(spark, folder).withColumn("s", F.datediff("day", F.lit("1970-01-01")) * DAY)
    out = windows.change_at(d, "n", 7 * DAY, ["event_type"], "change7d", "s")
    order = Window.partitionBy("event_type").orderBy("s")
    return out.select("event_type", "day", windows.change("n", 8, ["event_type"], "s").alias("change8"), "change7d", F.abs(F.col("n") - F.lag("n").over(order)).alias("step"))


@query(f"""
WITH d AS ({_D}), m AS (SELECT *, median(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM d)
SELECT event_type, day, round(n - avg(med) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS detrended FROM m
""")
def detrended_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts less a centred median then mean (WIN-06)."""
    out = windows.detrended(_daily(spark, folder), "n", ["event_type"], "day", "d")
    return out.select("event_type", "day", F.round("d", 6).alias("detrended"))


@query(f"""
WITH d AS ({_D}), m AS (SELECT event_type, avg(n) + 0.5 * stddev_pop(n) AS hi, avg(n) AS lo FROM d GROUP BY 1),
z AS (SELECT d.*, CASE WHEN n >= hi THEN 6.0 WHEN n < lo THEN 1.0 ELSE 4.5 END AS level FROM d JOIN m USING (event_type))
SELECT event_type, day FROM z QUALIFY level >= 5 AND count(*) FILTER (level < 4) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
""")
def onset_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Days of a high level after three calm ones (WIN-10)."""
    return windows.onsets(_levels(spark, folder), "level", ["event_type"], "day").select("event_type", "day")


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    d = _daily(spark, folder)
    own = Window.partitionBy("event_type")
    high, low = F.avg("n").over(own) + 0.5 * F.stddev_pop("n").over(own), F.avg("n").over(own)
    return d.withColumn("level", F.when(F.col("n") >= high, 6.0).when(F.col("n") < low, 1.0).otherwise(4.5))


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), e AS (SELECT min(day) AS a, max(day) AS b FROM d),
s AS (SELECT ts::DATE AS o FROM events WHERE event_type = 'error' GROUP BY 1), k AS (SELECT o FROM s, e WHERE o - 3 >= a AND o + 3 <= b)
SELECT l::INT AS lag, round(avg(d.n), 6) AS mean, count(d.n) AS n FROM k, range(-3, 4) t(l) JOIN d ON d.day = k.o + l::INT GROUP BY 1
""")
def superposed_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """Mean daily counts by lag around the days with errors (WIN-11)."""
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    daily = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    starts = e.where("event_type = 'error'").select("day").distinct()
    out = windows.epoch_average(daily, starts, "n", "day", range(-3, 4))
    return out.select("lag", F.round("mean", 6).alias("mean"), "n")


@query("""
WITH b AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z FROM events), g AS (SELECT u.user_id, d::DATE AS day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM b)),
c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, count(*) AS n_days, count(*) FILTER (coalesce(n, 0) = 0) AS n_zero, sum(coalesce(n, 0))::BIGINT AS total FROM g LEFT JOIN c USING (user_id, day) GROUP BY user_id
""")
def calendar_fill_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Every day of every user, zeros included, and what that makes (WIN-13)."""
    e = table(spark, folder, "events")
    span = e.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("z")).first()
    counts = e.where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = windows.calendar_filled(counts, "day", "n", F.lit(span.a), F.lit(span.z), e.select("user_id").distinct())
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("n") == 0).alias("n_zero"), F.sum("n").alias("total"))


@query(f"""
WITH d AS ({_D}), i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT a.event_type, a.day, a.n, b.n AS rolled FROM i a JOIN i b ON a.event_type = b.event_type AND a.i = (b.i + 5) % b.c
""")
def circular_shift(spark: SparkSession, folder: str) -> DataFrame:
    """A series moved by five places around its end (WIN-14)."""
    return windows.rolled(_daily(spark, folder), "n", ["event_type"], "day", 5, "rolled").select("event_type", "day", "n", "rolled")


_ZONES = ("America/New_York", "Europe/Paris", "Asia/Tokyo")


def _zoned(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    zone = F.get(F.array(*map(F.lit, _ZONES)), (F.col("user_id") % 3).cast("int"))
    return e.select("event_id", F.col("ts").alias("utc_ts"), zone.alias("zone"))


_Z = "SELECT event_id, ts AS utc_ts, (['America/New_York', 'Europe/Paris', 'Asia/Tokyo'])[(user_id % 3 + 1)::INT] AS zone FROM events"
_REFERENTS = f"""
WITH z AS ({_Z}), l AS (SELECT *, timezone(zone, timezone('UTC', utc_ts)) AS local FROM z),
m AS (SELECT l.*, k, local + k * INTERVAL 1 DAY AS moved FROM l, (VALUES {{offsets}}) s(k){{where}}),
u AS (SELECT event_id, k, moved, zone, timezone('UTC', timezone(zone, moved)) AS utc FROM m)
SELECT event_id, strftime(CASE WHEN timezone(zone, timezone('UTC', utc - INTERVAL 1 HOUR)) = moved THEN utc - INTERVAL 1 HOUR ELSE utc END, '%Y-%m-%d %H:%M:%S') AS utc_text, {{label}}
FROM u WHERE timezone(zone, timezone('UTC', utc)) = moved
"""


@query(_REFERENTS.format(offsets=", ".join(f"({7 * k})" for k in controls.MONTH_WEEKS), where=" WHERE month(local + k * INTERVAL 1 DAY) = month(local)", label="(k / 7)::INT AS \"offset\""))
def referents_same_month(spark: SparkSession, folder: str) -> DataFrame:
    """Same clock and weekday in other weeks of the month, daylight saving included (DOM-08, DTE-01, DTE-02)."""
    out = controls.month_referents(_zoned(spark, folder))
    return out.select("event_id", F.date_format("utc_ts", "yyyy-MM-dd HH:mm:ss").alias("utc_text"), "offset")


@query(_REFERENTS.format(offsets=", ".join(f"({k})" for k in controls.YEAR_DAYS), where="", label="k::INT AS \"offset\""))
def referents_other_years(spark: SparkSession, folder: str) -> DataFrame:
    """Same clock and weekday one and two years off (DOM-09)."""
    out = controls.year_referents(_zoned(spark, folder))
    return out.select("event_id", F.date_format("utc_ts", "yyyy-MM-dd HH:mm:ss").alias("utc_text"), "offset")


@query(None)
def referent_check(spark: SparkSession, folder: str) -> DataFrame:
    """Referents whose local clock or weekday differs from the case's: none may (DOM-11)."""
    cases = _zoned(spark, folder)
    return controls.referent_check(cases, controls.month_referents(cases).drop("strategy"))


@query(f"""
SELECT event_id, round(hour(ts) + minute(ts) / 60, 6) AS hour, isodow(ts) - 1 AS dow, strftime(ts, '%m-%d') AS mmdd, (ts - INTERVAL 12 HOUR)::DATE AS night,
  round(((hour(ts) + minute(ts) / 60 + ({sql_lon('event_id')}) / 15) % 24 + 24) % 24, 6) AS solar_hour,
  CASE WHEN minute(ts) % 30 = 0 THEN 30.0 WHEN minute(ts) % 15 = 0 THEN 15.0 WHEN minute(ts) % 5 = 0 THEN 10.0 ELSE 5.0 END AS uncertainty,
  (strftime(ts, '%m-%d') = '07-04')::INT::DOUBLE AS hol_independence_day, floor(epoch_us(ts) / 600000000)::BIGINT AS ten_minutes
FROM events
""")
def calendar_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Hour, weekday, night, solar hour, time uncertainty, holiday and ten-minute bin (DTE-04 to DTE-07, DTE-09, DTE-11)."""
    e = _events(spark, folder)
    mmdd = F.date_format("ts", "MM-dd")
    return e.select(
        "event_id", F.round(X.hour_fraction("ts"), 6).alias("hour"), F.weekday("ts").cast("long").alias("dow"), mmdd.alias("mmdd"), X.night_of("ts").alias("night"),
        F.round(X.solar_hour("ts", "lon"), 6).alias("solar_hour"), X.time_uncertainty_min(F.minute("ts"), F.hour("ts")).alias("uncertainty"),
        X.holiday_flags(mmdd)["hol_independence_day"].alias("hol_independence_day"), F.floor(X.epoch_us("ts") / 600_000_000).alias("ten_minutes"),
    )


@query(f"""
WITH a AS (SELECT event_id, epoch_us(ts) / 86400000000.0 - 10957.5 AS d, {sql_lat('event_id')} AS lat, {sql_lon('event_id')} AS lon FROM events),
g AS (SELECT *, ((280.46061837 + 360.98564736629 * d + 0.000387933 * pow(d / 36525, 2) - pow(d / 36525, 3) / 38710000) % 360 + 360) % 360 AS gmst, radians((357.528 + 0.9856003 * d) % 360) AS m, radians(23.439 - 0.0000004 * d) AS o FROM a),
s AS (SELECT *, radians((280.460 + 0.9856474 * d) % 360 + 1.915 * sin(m) + 0.020 * sin(2 * m)) AS l FROM g),
r AS (SELECT *, degrees(atan2(cos(o) * sin(l), cos(l))) AS ra, asin(sin(o) * sin(l)) AS dec FROM s)
SELECT event_id, round(gmst, 4) AS gmst, round(degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians(gmst + lon - ra)))), 4) AS sun_alt FROM r
""")
def sun_altitude(spark: SparkSession, folder: str) -> DataFrame:
    """Sidereal time and the Sun's altitude by closed forms (DTE-14, MTH-04, MTH-07)."""
    e = _events(spark, folder)
    ra, dec = X.sun_ra_dec("ts")
    return e.select("event_id", F.round(X.gmst_deg("ts"), 4).alias("gmst"), F.round(X.altitude_deg(ra, dec, "ts", "lat", "lon"), 4).alias("sun_alt"))


@query(
    "SELECT event_id, round(" + " + ".join(f"{z} * pow(10.0, {-b} * abs((((event_id % 3600) / 10.0 - {p} + 180) % 360 + 360) % 360 - 180))" for _, p, z, b in X.SHOWERS) + ", 6) AS zhr FROM events"
)
def meteor_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Summed shower rates over solar longitude (MTH-06)."""
    e = table(spark, folder, "events")
    return e.select("event_id", F.round(X.shower_rate(F.col("event_id") % 3600 / 10.0), 6).alias("zhr"))
