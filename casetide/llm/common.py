"""Shared pieces of the training-data operators: storage between jobs, word hashing, Arrow access.

Tables between jobs go to the folder that ``spark.checkpoint.dir`` names, which every executor
and the driver see. Only where that setting is absent in a local session (tests, notebooks) a folder of our own is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to a Python worker at a time. Texts may be long, so batches are short.
ARROW_ROWS = 500
#: Bytes of text hashed at a time; bounds the temporary arrays.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs, unique to the caller, deleted when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="casetide-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/casetide-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


#: Folders that the innermost ``passing_tables`` deletes at its end.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that ``materialize`` wrote inside; gives a function that writes one which stays.

    One that stays goes with the enclosing ``passing_tables``, if any. Whatever reads the others must have been written or
    collected by then.
    """
    outer, folders = _passing.get(), []
    token = _passing.set(folders)
    try:
        yield lambda df: _stored(df, outer)
    finally:
        _passing.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    return _stored(df, _passing.get(), partition_by)


def _stored(df: DataFrame, folders: list[str] | None, partition_by: list[str] | None = None) -> DataFrame:
    path = shared_folder(df.sparkSession)
    if folders is not None:
        folders.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``ARROW_ROWS`` rows, so that a batch of long texts fits a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


# --------------------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers made from ``salt`` alone, the same in every process."""
    start = (salt * 0x9E3779B97F4A7C15) & _MASK
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)) | np.uint64(1)


_BYTE_CODE = seeds(256, 11)
_BASE = 0xD1342543DE82EF95
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def _byte_tables(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    if fold:
        code[65:91] += 32
    ends = np.zeros(256, bool)
    ends[list(separators)] = True
    return _BYTE_CODE[code], ends


#: The white space of the contracts: space and the bytes 9 to 13.
SPACE = b" \t\n\x0b\x0c\r"
#: Every ASCII byte that is neither letter nor digit.
NON_WORD = bytes(i for i in range(128) if not chr(i).isalnum())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and where each row begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch of texts: 64-bit hash, byte range, and the first word of each row (plus an end)."""

    __slots__ = ("hashes", "begins", "ends", "rows")

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: bytes = SPACE, fold: bool = True):
        codes, is_end = _byte_tables(separators, fold)
        hashes, begins, ends = [], [], []
        lo, size = 0, len(data)
        while lo < size:
            hi = min(lo + CHUNK_BYTES, size)
            while hi < size:  # a chunk ends at a separator or at the end of a row
                tail = np.flatnonzero(is_end[data[max(lo, hi - 4096) : hi]])
                if len(tail):
                    hi = max(lo, hi - 4096) + int(tail[-1]) + 1
                    break
                cut = at[np.searchsorted(at, hi)]
                more = data[hi : hi + CHUNK_BYTES]
                found = np.flatnonzero(is_end[more])
                hi = min(int(cut), hi + int(found[0]) + 1 if len(found) else hi + len(more))
                if hi == cut or len(found):
                    break
            part = data[lo:hi]
            inside = ~is_end[part]
            head = inside.copy()
            head[1:] &= ~inside[:-1]
            first, last = np.searchsorted(at, [lo, hi])
            cuts = at[first:last] - lo
            cuts = cuts[cuts < len(part)]
            head[cuts] = inside[cuts]
            begin = np.flatnonzero(head)
            if len(begin):
                stop = np.zeros(len(part) + 1, bool)
                stop[1:-1] = inside[:-1] & (~inside[1:] | head[1:])
                stop[-1] = inside[-1]
                end = np.flatnonzero(stop)
                up, down = _powers(len(part) + 1)
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(codes[part] * up[: len(part)], out=sums[1:])
                hashes.append(mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
                begins.append(begin + lo)
                ends.append(end + lo)
            lo = hi
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hashes, self.begins, self.ends = join(hashes, np.uint64), join(begins, np.int64), join(ends, np.int64)
        self.rows = np.searchsorted(self.begins, at)


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles of each row and where rows begin among them.

    A row of fewer words, but at least one, has its whole sequence as one shingle.
    """
    turn = seeds(size + 1, 23)
    lengths = np.diff(rows)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    out_rows = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_rows[-1])
    begin = np.arange(total) - np.repeat(out_rows[:-1], counts) + np.repeat(rows[:-1], counts)
    words = np.repeat(np.minimum(lengths, size), counts)
    value = np.zeros(total, np.uint64)
    for k in range(size):
        has = words > k
        if has.all():
            value += hashes[begin + k] * turn[k]
        else:
            value[has] += hashes[begin[has] + k] * turn[k]
    return mix64(value + words.astype(np.uint64) * turn[size]), out_rows


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and where rows begin among them."""
    kept = [np.unique(values[rows[i] : rows[i + 1]]) for i in range(len(rows) - 1)]
    out = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
    return (np.concatenate(kept) if kept else np.zeros(0, np.uint64)), out


def minima(values: np.ndarray, rows: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each row and multiplier the least product modulo 2**64; rows without values get the largest number."""
    out = np.full((len(rows) - 1, len(multipliers)), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        scratch = np.empty(len(values), np.uint64)
        for k, m in enumerate(multipliers):
            np.multiply(values, m, out=scratch)
            out[full, k] = np.minimum.reduceat(scratch, rows[full])
    return out
