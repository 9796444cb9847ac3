"""The corpus pipeline: language ID, exact and near duplicates, decontamination, packing.

Each stage takes (spark, docs, folder of tables) and works on all rows that the stage before it kept. ``run``
writes each stage's rows as Parquet in the shared folder and reads them back for the next.

Null texts, empty ones and those without letters go in the first stage. Of equal texts the least id stays, rows repeated
with one id and text once; an id that two texts share loses only a copy. Of near copies the least id of a group
stays. Rows without an id can't be named by a decision and stay until packing, which returns them with a null id. All
columns but id, text, lang and source only travel along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casetide.llm import decontam, exact_dedup, langid, minhash, packing
from casetide.llm.common import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told: null, empty, or without letters."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more; the least id of each component stays."""
    return minhash.drop_near_copies(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_dedup", near), ("decontamination", decontaminate), ("best_fit_packing", packed)]

#: Learned models, sketches and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
