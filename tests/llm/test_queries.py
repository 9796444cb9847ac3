"""The queries of the training-data operators against their SQL, and the pipeline's stages."""

import os

import pytest

from casetide.llm import queries as llm

from ..oracle import FOLDER, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, llm.queries()[name], llm.oracle_sql()[name])


def test_eleven_queries():
    import corpus_pipeline

    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "decontamination", "best_fit_packing"]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, FOLDER)
        assert after.columns == docs.columns, name
        assert after.exceptAll(kept).count() == 0
        kept = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert packed.groupBy("bin_id").sum("length").where("`sum(length)` > 2048").count() == 0
