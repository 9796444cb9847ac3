"""Writers: tables, result files, registries, and the public copy."""

from __future__ import annotations

import fcntl
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import spec_json

#: Fields of the registry in order (fixed values: the file format).
REGISTRY_FIELDS = (
    "test_id", "timestamp", "phase", "family", "hypothesis", "variable_a", "variable_b", "variable_c", "window", "radius_km", "model", "subset", "split", "control_strategy",
    "n_cases", "n_controls", "n_strata", "effect_measure", "effect", "ci_low", "ci_high", "p_value", "direction", "n_exposed_cases", "notes", "n_exposed_controls", "status", "inference_method", "inference_version", "scale",
)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replacing what is there; the commit protocol publishes whole results only."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_result_csv(df: DataFrame, path: str) -> None:
    """A small result as CSV with a header in one part."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def create_only(df: DataFrame, path: str) -> None:
    """Parquet that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def public_copy(reports: DataFrame, source: str, hidden_source: str, columns: list[str]) -> DataFrame:
    """``columns`` emptied for one source."""
    hide = lambda c: F.when(F.col(source) == hidden_source, F.lit(None)).otherwise(F.col(c))
    return reports.withColumns({c: hide(c) for c in columns})


def append_registry(path: str, row: dict) -> str:
    """Append a test under an exclusive lock with the next id; a text file of one JSON object a line."""
    unknown = set(row) - set(REGISTRY_FIELDS)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    with open(path, "a+", encoding="utf-8") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.seek(0)
        last = max((int(json.loads(line)["test_id"][1:]) for line in f if line.strip()), default=0)
        test_id = f"T{last + 1:06d}"
        f.write(json.dumps(json.loads(spec_json({**row, "test_id": test_id}))) + "\n")
    return test_id


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All tests; fields that older lines lack are null."""
    numbers = {"n_cases", "n_controls", "n_strata", "effect", "ci_low", "ci_high", "p_value", "n_exposed_cases", "n_exposed_controls", "scale"}
    return spark.read.schema(", ".join(f"{c} {'double' if c in numbers else 'string'}" for c in REGISTRY_FIELDS)).json(path)


def registry_from_csv(spark: SparkSession, path: str, widths: tuple[int, ...] = (25, 29, 30)) -> DataFrame:
    """An older CSV registry whose lines have 25, 29 or 30 fields, multi-line notes included; another width fails."""
    raw = spark.read.option("multiLine", True).option("escape", '"').schema(", ".join(f"c{i} string" for i in range(max(widths) + 1))).csv(path).where("c0 <> 'test_id'")
    filled: Column = F.size(F.array_compact(F.array(*[F.col(f"c{i}") for i in range(max(widths), max(widths) + 1)])))
    if raw.where(filled > 0).limit(1).count():
        raise ValueError("a line has more fields than any known layout")
    return raw.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(REGISTRY_FIELDS)])


def summary_markdown(manifest: DataFrame, groups: list[tuple[str, str]]) -> str:
    """Files and bytes by the first group whose pattern fits the destination, as a table."""
    label = F.lit("other")
    for name, pattern in reversed(groups):
        label = F.when(F.col("dest").rlike(pattern), name).otherwise(label)
    rows = manifest.groupBy(label.alias("source")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).orderBy("source").collect()
    return "\n".join(["| source | files | bytes |", "|-|-|-|", *[f"| {r.source} | {r.files} | {r.bytes} |" for r in rows]])
