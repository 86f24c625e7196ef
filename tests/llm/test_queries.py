"""Queries against their SQL twins, and the pipeline's stages against invariants."""

import pytest

import corpus_pipeline
import edge
from compare_util import compare, duck
from conftest import SMALL_SF
from vouch.llm import queries as Q


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, con, name):
    res = compare(Q.QUERIES[name](spark, SMALL_SF), con, Q.ORACLE[name])
    assert res["match"], res


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE) - {"op4_latent_decontam", "op13_whitening"}))
def test_one_row_for_every_document(spark, name):
    out = Q.QUERIES[name](spark, SMALL_SF)
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    assert edge.rows(out, "doc_id") == edge.rows(docs, "doc_id")


def test_pipeline_equals_its_stages_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = set(docs.select("doc_id").toPandas()["doc_id"])
        docs = corpus_pipeline.written(stage(spark, docs, SMALL_SF), "test")
        if i < 4:
            assert docs.columns == names
        assert set(docs.select("doc_id").toPandas()["doc_id"]) <= before
    whole = corpus_pipeline.run(spark, SMALL_SF)
    assert whole.count() > 0
    assert edge.rows(whole, *whole.columns) == edge.rows(docs, *whole.columns)


def test_pipeline_stages_take_edge_rows_and_empty_tables(spark):
    for start in (edge.documents(spark), edge.empty(spark)):
        docs = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.written(stage(spark, docs, SMALL_SF), f"edge-{name}")
            if i < 4:
                assert docs.columns == start.columns
        assert docs.columns[:1] == ["doc_id"]
