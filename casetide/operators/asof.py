"""As-of lookups: the last row at or before a time, or the nearest one, with a tolerance.

``backward`` merges probes and series and carries the last series row along each key: one shuffle on the key, no
candidate pairs. A null measurement still is the match; it isn't skipped for an older value. ``within`` serves series
without a key, by buckets as wide as the tolerance, since an unpartitioned window would be a single task; it carries
along each bucket, without candidate pairs, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward(probes: DataFrame, series: DataFrame, keys: list[str], values: list[str], *, time: str = "t", tolerance: float | None = None, closed: bool = True, strictly_before: bool = False) -> DataFrame:
    """``probes`` with ``values`` and ``matched_<time>`` of the last series row of their key, null where none is near enough.

    ``closed``: a distance equal to the tolerance counts.
    """
    carried = F.struct(F.col(time).alias("at"), *values)
    right = series.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("__t"), carried.alias("__m"), F.lit(1 if strictly_before else 0).alias("__side"))
    left = probes.select(*keys, F.col(time).alias("__t"), F.struct(*probes.columns).alias("__p"), F.lit(0 if strictly_before else 1).alias("__side"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__m", F.last("__m", ignorenulls=True).over(order)).where("__p IS NOT NULL")
    age = F.col("__t") - F.col("__m.at")
    near = age.isNotNull() if tolerance is None else (age <= tolerance if closed else age < tolerance)
    picked = [F.when(near, F.col(f"__m.{v}")).alias(v) for v in values]
    return found.select("__p.*", F.when(near, F.col("__m.at")).alias(f"matched_{time}"), *picked)


def within(probes: DataFrame, series: DataFrame, values: list[str], *, probe_id: str, time: str = "t", tolerance: float, closed: bool = True) -> DataFrame:
    """Backward lookup in a series without keys; the last of equal times by its values.

    Within a bucket the last row is carried along; of the bucket before only its very last row can be a match, and is added.
    """
    bucket = F.floor(F.col(time) / tolerance)
    rows = series.where(F.col(time).isNotNull()).select(bucket.alias("__b"), F.struct(F.col(time).alias("at"), *values).alias("__m"))
    right = rows.unionByName(rows.groupBy("__b").agg(F.max("__m").alias("__m")).withColumn("__b", F.col("__b") + 1)).select("__b", "__m", F.col("__m.at").alias("__t"), F.lit(0).alias("__side"))
    spread = F.coalesce(bucket, F.xxhash64(probe_id))  # probes without time find nothing, wherever they are
    left = probes.select(spread.alias("__b"), F.col(time).alias("__t"), F.struct(*probes.columns).alias("__p"), F.lit(1).alias("__side"))
    order = Window.partitionBy("__b").orderBy("__t", "__side", "__m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True)
    found = both.withColumn("__m", F.last("__m", ignorenulls=True).over(order)).where("__p IS NOT NULL")
    age = F.col("__t") - F.col("__m.at")
    near = age <= tolerance if closed else age < tolerance
    return found.select("__p.*", F.when(near, F.col("__m.at")).alias(f"matched_{time}"), *[F.when(near, F.col(f"__m.{v}")).alias(v) for v in values])


def nearest(probes: DataFrame, series: DataFrame, values: list[str], *, probe_id: str, keys: list[str] | None = None, time: str = "t", tolerance: float, later_wins: bool = True) -> DataFrame:
    """The series row nearest in time within a closed tolerance, with its signed ``age`` (series less probe).

    Of two as near, the later one wins (or the earlier), then the largest values.
    """
    keys = keys or []
    width = tolerance
    right = series.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("__at"), *values, F.floor(F.col(time) / width).alias("__b"))
    around = F.explode(F.array(*[F.floor(F.col(time) / width) + k for k in (-1, 0, 1)]))
    left = probes.where(F.col(time).isNotNull()).select(probe_id, *keys, F.col(time).alias("__t"), around.alias("__b"))
    age = F.col("__at") - F.col("__t")
    met = left.join(right, ["__b", *keys]).where(F.abs(age) <= tolerance)
    rank = F.struct(-F.abs(age), age if later_wins else -age, *values)
    best = met.groupBy(probe_id).agg(F.max_by(F.struct(age.alias("age"), *values), rank).alias("__m"))
    return probes.join(best, probe_id, "left").select(*probes.columns, F.col("__m.age").alias("age"), *[F.col(f"__m.{v}").alias(v) for v in values])
