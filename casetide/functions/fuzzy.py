"""String similarity by common subsequences, on a 0 to 100 scale, as Arrow UDFs."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """Twice the longest common subsequence over both lengths; two empty texts are alike."""
    if a is None or b is None:
        return 0.0
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _common(a, b) / total


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """``indel_ratio`` of the words in alphabetical order."""
    if a is None or b is None:
        return 0.0
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _over(measure):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([measure(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return run


def ratio(a: Column, b: Column) -> Column:
    return F.arrow_udf(_over(indel_ratio), "double")(a, b)


def sorted_ratio(a: Column, b: Column) -> Column:
    return F.arrow_udf(_over(token_sort_ratio), "double")(a, b)
