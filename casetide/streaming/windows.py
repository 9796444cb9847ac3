"""Extras on streams: window counts of a static catalog for streamed points, and late-tolerant daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_window_counts(points: DataFrame, catalog: DataFrame, lo: float, hi: float, *, point_id: str = "point_id", time: str = "ts", watermark: str = "1 day") -> DataFrame:
    """For each streamed point the events of a static catalog in [t + lo, t + hi] seconds, by bucket join.

    Points without a match are counted 0. Append mode works once the watermark passes a point's time.
    """
    width = max((hi - lo) / 2, 1.0)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    events = catalog.select(at(time).alias("__ct")).withColumn("__b", F.floor(F.col("__ct") / width))
    probes = points.withWatermark(time, watermark).withColumn("__t", at(time)).withColumn("__b", F.explode(F.sequence(F.floor((F.col("__t") + lo) / width), F.floor((F.col("__t") + hi) / width))))
    met = probes.join(F.broadcast(events) if events.count() <= 1_000_000 else events, "__b", "left")
    hit = (F.col("__ct") - F.col("__t")).between(lo, hi)
    return met.groupBy(F.window(time, "1 day"), point_id, time).agg(F.count_if(hit).alias("n")).drop("window")


def daily_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", watermark: str = "1 day") -> DataFrame:
    """Events by day and kind; those later than the watermark are left out."""
    return events.withWatermark(time, watermark).groupBy(F.window(time, "1 day"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), kind, "n")
