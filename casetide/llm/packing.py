"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt to shards of about ``SHARD`` rows by a hash of id and text, so a source or a group of copies
with a third of all rows is spread evenly, and each shard is packed by itself. A document's length is its words
plus one end mark; longer ones than ``capacity`` are cut into pieces, none is dropped.

Within a shard pieces come in falling length (best-fit decreasing). Open bins are ordered by residual space; the
search starts at the least residual that fits and goes on to each successor until the bin's bitmaps show neither
the piece's source nor its duplicate cluster: that is the tightest compatible bin. If none is, a bin is opened.

A duplicate cluster is a group of equal normalised texts. A null source conflicts with nothing; null text is empty
and has length 1. Repeated rows are packed each. Rows without an id are packed and returned with a null id.
Only ids, hashes and lengths are shuffled. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import normalised

CAPACITY, SHARD = 2048, 4096
RESULT = "doc_id long, piece int, word_from long, length long, bin_id long, at long"


def best_fit(pieces: Iterable[tuple[int, int | None, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece (length, source bit or None, cluster bit), in the order given."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        own_source = 0 if source is None else 1 << source
        own_cluster = 1 << cluster
        k = bisect_left(order, (length, -1))
        while k < len(order) and (sources[order[k][1]] & own_source or clusters[order[k][1]] & own_cluster):
            k += 1
        if k < len(order):
            residual, chosen = order.pop(k)
            sources[chosen] |= own_source
            clusters[chosen] |= own_cluster
        else:
            residual, chosen = capacity, len(sources)
            sources.append(own_source)
            clusters.append(own_cluster)
        out.append((chosen, capacity - residual))
        if residual > length:
            insort(order, (residual - length, chosen))
    return out


def _packer(capacity: int) -> Callable:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        source_bit = {s: i for i, s in enumerate(sorted(set(rows["source"].dropna())))}
        cluster_bit = {c: i for i, c in enumerate(sorted(set(rows["cluster"])))}
        shard = int(rows["shard"].iloc[0])
        whole, rest = [], []
        for doc, length, source, cluster in zip(rows["doc_id"], rows["length"], rows["source"], rows["cluster"], strict=True):
            for piece, start in enumerate(range(0, length, capacity)):
                size = min(capacity, length - start)
                (whole if size == capacity else rest).append((size, source_bit.get(source), cluster_bit[cluster], doc, piece, start))
        rest.sort(key=lambda p: -p[0])
        placed = best_fit([p[:3] for p in rest], capacity)
        first = 1 + max((b for b, _ in placed), default=-1)  # a piece that fills a bin needs no search
        placed += [(first + k, 0) for k in range(len(whole))]
        return pd.DataFrame(
            [(doc, piece, start, size, (shard << 32) + b, at) for (size, _, _, doc, piece, start), (b, at) in zip(rest + whole, placed, strict=True)],
            columns=["doc_id", "piece", "word_from", "length", "bin_id", "at"],
        ).astype({"doc_id": "Int64"})

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: id, piece, word_from, length, bin_id, at (its place in the bin); see the module."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(normalised(text)).alias("cluster"),
        (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("length"),
    )
    shards = max(1, -(-docs.select(F.col(id_col)).count() // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_packer(capacity), RESULT).withColumnRenamed("doc_id", id_col)
