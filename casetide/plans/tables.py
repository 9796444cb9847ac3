"""Queries of plain table operations: keyed unions, differences of ids, rows of a maximum, impossible dates, delays, cached covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

_URGENT = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


@query("SELECT c_custkey AS id, 'ordered' AS origin FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def union_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Two lists of ids as one row an id; the first list's row wins (SET-02)."""
    ordered = table(spark, folder, "orders").where(_URGENT).select(F.col("o_custkey").alias("id"), F.lit(0).alias("priority"))
    known = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("priority"))
    first = ordered.unionByName(known).groupBy("id").agg(F.min("priority").alias("priority"))
    return first.select("id", F.when(F.col("priority") == 0, "ordered").otherwise("idle").alias("origin"))


@query("SELECT c_custkey AS id, 'missing' AS status FROM customer WHERE c_nationkey > 4 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 4)")
def id_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that an expected list has and a found one hasn't, and the other way round (SET-06)."""
    expected = table(spark, folder, "customer").where("c_nationkey > 4").select(F.col("c_custkey").alias("id"))
    found = table(spark, folder, "orders").where(_URGENT).select(F.col("o_custkey").alias("id")).distinct()
    missing = expected.join(found, "id", "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(found.join(expected, "id", "left_anti").withColumn("status", F.lit("unexpected")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def largest_of_group(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's largest order, the least key of equal ones (SRT-06)."""
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(best.alias("best")).select("o_custkey", "best.*")


_SAID = "year(o_orderdate) || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0')"


@query(f"""SELECT o_orderkey, TRY_CAST({_SAID} AS DATE) AS day, CASE WHEN TRY_CAST({_SAID} AS DATE) IS NULL THEN 'month' ELSE 'day' END AS precision,
CASE WHEN TRY_CAST({_SAID} AS DATE) IS NOT NULL THEN (o_orderkey % 24)::INT END AS hour, date_diff('day', TRY_CAST({_SAID} AS DATE), DATE '1999-01-01') AS delay_days FROM orders""")
def impossible_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Stated dates that don't exist keep the month only and lose the hour; days until the report (FLT-14, DTE-10)."""
    two = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    day = F.try_to_date(F.concat_ws("-", F.year("o_orderdate").cast("string"), two(14), two(33)), "yyyy-MM-dd")
    said = table(spark, folder, "orders").select("o_orderkey", day.alias("day"))
    exact = F.col("day").isNotNull()
    return said.select(
        "o_orderkey", "day", F.when(exact, "day").otherwise("month").alias("precision"),
        F.when(exact, (F.col("o_orderkey") % 24).cast("int")).alias("hour"),
        F.datediff(F.lit("1999-01-01").cast("date"), "day").cast("long").alias("delay_days"),
    )
