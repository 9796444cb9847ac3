"""The registry of queries and their SQL, filled by the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ------------------------------------------------------------------ pieces of SQL

HOUR, DAY = 3600, 86400


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


def sql_lat(key: str) -> str:
    """Synthetic latitude of a key; the geometry tests operators, not geography."""
    return f"(({key} * 37) % 12000) / 100.0 - 60"


def sql_lon(key: str) -> str:
    return f"(({key} * 91) % 36000) / 100.0 - 180"
