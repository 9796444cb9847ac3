"""Column expressions: geometry, time, probability, astronomy. All stay inside Catalyst."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in km; the destination formula keeps its own rounded value (fixed values).
EARTH_KM, EARTH_KM_ROUNDED = 6371.0088, 6371.0


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x: Column | str) -> Column:
    """Null in place of NaN and the infinities: missing has one form."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


# ------------------------------------------------------------------ geometry


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null where a coordinate is."""
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def destination(lat, lon, bearing_deg, km) -> tuple[Column, Column]:
    """(lat, lon) reached from a point after ``km`` along a bearing."""
    a, o, b, d = F.radians(col(lat)), F.radians(col(lon)), F.radians(col(bearing_deg)), col(km) / EARTH_KM_ROUNDED
    to_lat = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    to_lon = o + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to_lat))
    return F.degrees(to_lat), F.degrees(to_lon)


def place_radius_km(area_km2, population) -> Column:
    """Radius of a place: sqrt(area) / 1.5, else 10 km for 100,000 people by the square root, within 5 to 40; 10 by default."""
    area, people = col(area_km2), col(population)
    within = lambda r: F.least(F.lit(40.0), F.greatest(F.lit(5.0), r))
    return F.when(area > 0, within(F.sqrt(area) / 1.5)).when(people > 0, within(10 * F.sqrt(people / 1e5))).otherwise(10.0)


def half_degree_cell(lat, lon) -> Column:
    return F.concat_ws("_", F.floor(col(lat) / 0.5).cast("string"), F.floor(col(lon) / 0.5).cast("string"))


def valid_point(lat, lon) -> Column:
    return col(lat).between(-90, 90) & col(lon).between(-180, 180)


def circle_in_boxes(lat, lon, radius_km: float, boxes: list[tuple[float, float, float, float]]) -> Column:
    """True where the rectangle around the whole circle lies in one box (south, north, west, east)."""
    lat, lon, angle = col(lat), col(lon), radius_km / EARTH_KM
    up = math.degrees(angle)
    ratio = F.try_divide(F.lit(math.sin(angle)), F.cos(F.radians(lat)))
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))))
    inside = [(lat - up >= s) & (lat + up <= n) & (lon - side >= w) & (lon + side <= e) for s, n, w, e in boxes]
    good = valid_point(lat, lon) & (F.abs(lat) + up < 90) & (ratio < 1) & F.lit(angle < math.pi / 2)
    return F.coalesce(good & reduce(lambda a, b: a | b, inside), F.lit(False))


# ------------------------------------------------------------------ time


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


def epoch_s(ts: Column | str) -> Column:
    return epoch_us(ts) / 1_000_000


def hour_fraction(ts: Column | str) -> Column:
    return F.hour(col(ts)) + F.minute(col(ts)) / 60


def night_of(ts: Column | str) -> Column:
    """The date of the evening that a night belongs to."""
    return F.to_date(col(ts).cast("timestamp_ntz") - F.expr("INTERVAL 12 HOURS"))


def solar_hour(ts: Column | str, lon) -> Column:
    return F.pmod(hour_fraction(ts) + col(lon) / 15, F.lit(24.0))


def local_to_utc(local: Column, zone: Column) -> tuple[Column, Column]:
    """(utc, exists): a wall-clock time in a zone; it doesn't exist where the round trip changes it (spring gap).

    A repeated hour gives its first instance. Both sides are zone-less; the session zone plays no part if it is UTC.
    """
    utc = F.to_utc_timestamp(local, zone)
    return utc, F.from_utc_timestamp(utc, zone) == local.cast("timestamp")


def shift_forward(local: Column, zone: Column) -> Column:
    """UTC of a wall-clock time; one inside a gap moves to the gap's end."""
    utc, exists = local_to_utc(local, zone)
    # within a gap Spark moves by the gap's length; the first instant after it is the whole hour (or half) it hides
    moved = F.from_utc_timestamp(utc, zone)
    gap_us = epoch_us(moved) - epoch_us(local)
    back = F.timestamp_add("MICROSECOND", -F.pmod(epoch_us(moved), gap_us), utc)
    return F.when(exists, utc).otherwise(back)


def time_uncertainty_min(minute, hour, default: float = 720.0) -> Column:
    """Minutes of uncertainty told by how a time was rounded; ``default`` without a time."""
    m = col(minute)
    return (
        F.when(m.isNull() | col(hour).isNull(), F.lit(default))
        .when(m % 30 == 0, 30.0)
        .when(m % 15 == 0, 15.0)
        .when(m % 5 == 0, 10.0)
        .otherwise(5.0)
    )


# ------------------------------------------------------------------ probability and labels


def noisy_or(*chances: Column) -> Column:
    """1 - product of (1 - p), each p cut to 0..1 and null as 0."""
    clipped = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(finite(p.cast("double")), F.lit(0.0)))) for p in chances]
    return 1 - reduce(lambda a, b: a * b, [1 - p for p in clipped])


def noisy_or_agg(p: Column | str) -> Column:
    return 1 - F.product(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(finite(col(p).cast("double")), F.lit(0.0)))))


def first_largest(names: list[str], values: list[Column], floor: float, none: str = "none") -> Column:
    """The name of the largest value, the first among equals; ``none`` below ``floor``."""
    best = F.greatest(*[F.coalesce(v, F.lit(0.0)) for v in values])
    out = F.when(best < floor, none)
    for name, value in zip(names, values, strict=True):
        out = out.when(F.coalesce(value, F.lit(0.0)) == best, name)
    return out


def explained_label(p: Column | str) -> Column:
    p = col(p)
    return F.when(p >= 0.6, "LIKELY_EXPLAINED").when(p >= 0.3, "AMBIGUOUS").otherwise("UNEXPLAINED_BY_MATCHER")


def hash_uniform(seed: int, key: Column | str) -> Column:
    """A number in 0..1 from the first 32 bits of SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967295.0


def split_label(u: Column, temporal: Column | None = None) -> Column:
    """discovery below 0.6, validation below 0.8, else holdout_random; rows marked temporal go to holdout_temporal."""
    label = F.when(u < 0.6, "discovery").when(u < 0.8, "validation").otherwise("holdout_random")
    return label if temporal is None else F.when(F.coalesce(temporal, F.lit(False)), "holdout_temporal").otherwise(label)


def record_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 of the parts with ``|`` between; null reads ``None``."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


# ------------------------------------------------------------------ astronomy (closed forms)


def days_since_j2000(ts: Column | str) -> Column:
    return epoch_us(ts) / 86_400_000_000.0 - 10957.5


def gmst_deg(ts: Column | str) -> Column:
    """Greenwich mean sidereal time in degrees."""
    d = days_since_j2000(ts)
    c = d / 36525.0
    return F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * c * c - c * c * c / 38710000.0, F.lit(360.0))


def sun_ecliptic(ts: Column | str) -> tuple[Column, Column]:
    """(ecliptic longitude, obliquity) of the Sun in degrees, low precision."""
    d = days_since_j2000(ts)
    mean, anomaly = F.pmod(280.460 + 0.9856474 * d, F.lit(360.0)), F.radians(F.pmod(357.528 + 0.9856003 * d, F.lit(360.0)))
    return F.pmod(mean + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly), F.lit(360.0)), 23.439 - 0.0000004 * d


def sun_ra_dec(ts: Column | str) -> tuple[Column, Column]:
    longitude, tilt = (F.radians(x) for x in sun_ecliptic(ts))
    ra = F.pmod(F.degrees(F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude))), F.lit(360.0))
    return ra, F.degrees(F.asin(F.sin(tilt) * F.sin(longitude)))


def sun_vector(ts: Column | str) -> tuple[Column, Column, Column]:
    """Unit vector to the Sun in the equatorial frame."""
    longitude, tilt = (F.radians(x) for x in sun_ecliptic(ts))
    return F.cos(longitude), F.cos(tilt) * F.sin(longitude), F.sin(tilt) * F.sin(longitude)


def altitude_deg(ra, dec, ts, lat, lon) -> Column:
    hour = F.radians(gmst_deg(ts) + col(lon) - col(ra))
    a, d = F.radians(col(lat)), F.radians(col(dec))
    return F.degrees(F.asin(F.sin(a) * F.sin(d) + F.cos(a) * F.cos(d) * F.cos(hour)))


def azimuth_deg(ra, dec, ts, lat, lon) -> Column:
    hour = F.radians(gmst_deg(ts) + col(lon) - col(ra))
    a, d = F.radians(col(lat)), F.radians(col(dec))
    east = -F.cos(d) * F.sin(hour)
    north = F.sin(d) * F.cos(a) - F.cos(d) * F.sin(a) * F.cos(hour)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


#: Meteor showers: name, solar longitude of the peak in degrees, peak hourly rate, decay per degree (fixed values).
SHOWERS = [
    ("Quadrantids", 283.15, 110, 0.75),
    ("Lyrids", 32.32, 18, 0.22),
    ("Eta Aquariids", 45.5, 50, 0.08),
    ("S Delta Aquariids", 127.0, 25, 0.091),
    ("Perseids", 140.0, 100, 0.20),
    ("Draconids", 195.4, 10, 0.80),
    ("Orionids", 208.0, 20, 0.12),
    ("S Taurids", 197.0, 5, 0.026),
    ("N Taurids", 230.0, 5, 0.026),
    ("Leonids", 235.27, 15, 0.39),
    ("Geminids", 262.2, 150, 0.39),
    ("Ursids", 270.7, 10, 0.61),
]

#: Dates of documented meteor outbursts (fixed values).
OUTBURST_DATES = ["1998-11-17", "1999-11-18", "2001-11-18", "2002-11-19", "2011-10-08", "2012-10-08", "2005-11-05", "2015-11-05", "2022-11-05"]

#: Fixed holidays by month and day (fixed values).
HOLIDAYS = {"07-04": "independence_day", "12-31": "new_years_eve", "01-01": "new_years_day", "10-31": "halloween", "07-05": "day_after_july4", "07-03": "day_before_july4"}


def near_outburst(ts: Column | str, days: float = 1.5) -> Column:
    """1.0 within ``days`` of an outburst date, 0.0 elsewhere, null without a time."""
    day = epoch_s(ts) / 86400.0
    dates = [F.datediff(F.lit(d).cast("date"), F.lit("1970-01-01").cast("date")).cast("double") for d in OUTBURST_DATES]
    return F.when(day.isNotNull(), reduce(lambda a, b: a | b, [F.abs(day - d) <= days for d in dates]).cast("double"))


def holiday_flags(mmdd: Column) -> dict[str, Column]:
    """0/1 by holiday, null where the local date is unknown."""
    return {f"hol_{name}": F.when(mmdd.isNotNull(), (mmdd == day).cast("double")) for day, name in HOLIDAYS.items()}


def shower_rate(solar_longitude: Column | str, showers: list[tuple[str, float, float, float]] | None = None) -> Column:
    """Sum over the showers of rate x 10^(-decay x distance in solar longitude)."""
    away = lambda peak: F.abs(F.pmod(col(solar_longitude) - peak + 180.0, F.lit(360.0)) - 180.0)
    return reduce(lambda a, b: a + b, [rate * F.pow(F.lit(10.0), -decay * away(peak)) for _, peak, rate, decay in showers or SHOWERS])
