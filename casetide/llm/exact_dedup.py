"""Exact duplicates by a heavy-hitter split, in DataFrame operations alone.

1. Each text is normalised and digested once; only (id, digest) goes on, never a text.
2. A Misra-Gries summary of the digests (Spark's ``approx_top_k``, an items sketch of bounded size that
   partial aggregation merges) names the digests that may be frequent. Every digest with more than about
   3.5 / ``tracked`` of all rows is among them.
3. The named digests are counted exactly; those that reach ``heavy_rows`` are the winners. At most ``heavy``
   rows of about 100 bytes are broadcast, so their rows, however many, are resolved without a shuffle.
4. All other digests go through an ordinary shuffle of narrow rows.

Null text counts as empty. Repeated rows with one id are members of the group like any other; the least
non-null id stays (null if a group has no other). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Digests broadcast at most.
HEAVY = 128
#: Counters of the Misra-Gries summary.
TRACKED = 4096
#: Copies from which a digest counts as heavy.
HEAVY_ROWS = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def heavy_winners(digests: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Digests with at least ``heavy_rows`` rows by exact count, among those the summary names."""
    named = digests.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top")).select(F.explode("top.item").alias("digest"))
    counted = digests.join(F.broadcast(named), "digest", "left_semi").groupBy("digest")
    return counted.agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= heavy_rows)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (see the module)."""
    digests = materialize(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")))
    winners = materialize(heavy_winners(digests, heavy, tracked, heavy_rows))
    frequent = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    ordinary = rest.join(groups, "digest")
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return frequent.unionByName(ordinary).select(
        F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged; rows repeated with one id and text count once.

    Rows are told apart by id and digest, so an id that two texts share loses only a copy. A row without an id can't be
    named as a copy and stays.
    """
    groups = exact_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col).select(F.col(id_col).alias("__id"), "keep_id", F.col("text_sha256").alias("__digest"))
    rows = materialize(groups.groupBy("__id", "__digest", "keep_id").agg(F.count(F.lit(1)).alias("n")).where("__id <> keep_id OR n > 1"))
    named = docs.withColumns({"__id": F.col(id_col), "__digest": F.when(F.col(id_col).isNotNull(), text_digest(F.col(text_col)))})
    own = ["__id", "__digest"]
    again = rows.where("__id = keep_id").select(*own)
    kept = named.join(rows.where("__id <> keep_id").select(*own), own, "left_anti")
    if again.limit(1).count():
        kept = kept.join(again, own, "left_anti").unionByName(kept.join(again, own, "left_semi").dropDuplicates(own))
    return kept.drop(*own)
