"""Queries of the training-data operators, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, langid, licences, lm_score, minhash, packing, substring_dedup, tokens, warc
from .common import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = shared_folder(spark)
    warc.write_archive(_table(spark, folder, "pages"), archive)
    return warc.archived_pages(spark, archive)


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, i::INT * 5 + 1, 5))::BIGINT) AS v,
             max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(v, lambda x:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15)::INT + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31)::INT + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31)::INT + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""


def op5_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    shards = tokens.write_tokens(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(shards)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return lm_score.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"), public_tokenizers.path("word_bpe_49k.json"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT c, n, unnest(s) AS x FROM c),
i AS (SELECT a.c AS a, b.c AS b, any_value(a.n) + any_value(b.n) - count(*) AS union_size, count(*) AS shared
      FROM u a JOIN u b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * union_size),
r(node, root) AS (SELECT c, c FROM c UNION SELECT z.y, r.root FROM r JOIN (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e) z ON z.x = r.node),
k AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(k.root, s.doc_id) AS component_id, s.doc_id = coalesce(k.root, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.node = c.c
"""


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_exact_dedup": op2_exact_dedup, "op3_substring_dedup": op3_substring_dedup, "op4_warc": op4_warc, "op5_tokens": op5_tokens, "op6_packing": op6_packing, "op7_licences": op7_licences, "op8_lm_score": op8_lm_score, "op9_minhash": op9_minhash, "op10_langid": op10_langid}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op7_licences": licences.oracle_sql(), "op9_minhash": OP9_SQL}
