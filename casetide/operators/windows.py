"""Windows over series: trailing ranges, lags, smoothing, onsets, calendars and aligned averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(seconds: int, keys: list[str], time: str = "t", open_left: bool = True):
    """Frame of the ``seconds`` up to and with the current row; ``time`` in whole seconds. The left end is open."""
    return Window.partitionBy(*keys).orderBy(time).rangeBetween(-(seconds - 1) if open_left else -seconds, 0)


def enough(value: Column, aggregate: Column, window, least: int) -> Column:
    """``aggregate`` where the frame has at least ``least`` values, else null."""
    return F.when(F.count(value).over(window) >= least, aggregate.over(window))


def change(value: str, rows: int, keys: list[str], time: str = "t") -> Column:
    """Difference to the value ``rows`` rows before, by position."""
    return F.col(value) - F.lag(value, rows).over(Window.partitionBy(*keys).orderBy(time))


def change_at(series: DataFrame, value: str, seconds: int, keys: list[str], name: str, time: str = "t") -> DataFrame:
    """Difference to the value exactly ``seconds`` before; null where that hour has no row. No grid is filled."""
    before = series.select(*keys, (F.col(time) + seconds).alias(time), F.col(value).alias("__before"))
    return series.join(before, [*keys, time], "left").withColumn(name, F.col(value) - F.col("__before")).drop("__before")


def smooth(value: str, keys: list[str], order: str, half_median: int = 4, half_mean: int = 2, least_median: int = 1, least_mean: int = 1) -> tuple[Column, str]:
    """Centred median then the frame for a centred mean of it (two steps, since windows don't nest)."""
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half_median, half_median)
    return F.when(F.count(value).over(around) >= least_median, F.percentile(F.col(value), F.lit(0.5)).over(around)), value


def detrended(series: DataFrame, value: str, keys: list[str], order: str, name: str, half_median: int = 4, half_mean: int = 2, least: int = 1) -> DataFrame:
    """``value`` less its smooth course: a centred median of 2h+1 rows, then a centred mean of 2k+1 rows."""
    median, _ = smooth(value, keys, order, half_median, half_mean, least)
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half_mean, half_mean)
    step = series.withColumn("__median", median)
    return step.withColumn(name, F.col(value) - F.when(F.count("__median").over(around) >= least, F.avg("__median").over(around))).drop("__median")


def onsets(series: DataFrame, value: str, keys: list[str], order: str, high: float = 5.0, low: float = 4.0, quiet: int = 3) -> DataFrame:
    """Rows with ``value`` >= ``high`` after ``quiet`` rows that are all below ``low``; a missing one isn't quiet."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-quiet, -1)
    calm = F.count(F.when(F.col(value) < low, 1)).over(before) == quiet
    return series.withColumn("__on", (F.col(value) >= high) & calm).where("__on").drop("__on")


def epoch_average(series: DataFrame, starts: DataFrame, value: str, day: str, lags: range) -> DataFrame:
    """Mean of ``value`` by lag in days around each start whose whole span lies inside the series."""
    ends = series.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    inside = starts.select(F.col(day).alias("__on")).crossJoin(F.broadcast(ends)).where((F.date_add("__on", min(lags)) >= F.col("a")) & (F.date_add("__on", max(lags)) <= F.col("b")))
    spread = inside.select("__on", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn(day, F.date_add("__on", F.col("lag")))
    return spread.join(series.select(day, value), day).groupBy("lag").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def calendar_filled(counts: DataFrame, day: str, value: str, first: Column, last: Column, keys: DataFrame | None = None) -> DataFrame:
    """Every day from ``first`` to ``last`` (for every row of ``keys``), with 0 where ``counts`` has none."""
    spark = counts.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias(day))
    grid = days if keys is None else keys.crossJoin(F.broadcast(days))
    on = [day] if keys is None else [*keys.columns, day]
    return grid.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def rolled(series: DataFrame, value: str, keys: list[str], order: str, shift: int, name: str) -> DataFrame:
    """``value`` moved along the series by ``shift`` places, circularly."""
    all_rows = Window.partitionBy(*keys)
    numbered = series.withColumn("__i", F.row_number().over(all_rows.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(all_rows))
    moved = numbered.select(*keys, F.pmod(F.col("__i") + shift, F.col("__n")).alias("__i"), F.col(value).alias(name))
    return numbered.join(moved, [*keys, "__i"]).drop("__i", "__n")


def case_value(value: str, stratum: str, case: str = "is_case") -> Column:
    """The case's value on every row of its set."""
    return F.max(F.when(F.col(case) == 1, F.col(value))).over(Window.partitionBy(stratum))
