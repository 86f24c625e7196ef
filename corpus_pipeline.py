"""The corpus pipeline: five stages over ``documents``, each written and read again.

Documents graded toxic go; one document of each group of near copies stays;
documents that hold a benchmark item go; the rest are mixed to the target
weights of their sources (a document stays 0, 1 or 2 times) and dealt over
shards.  Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vouch.llm import queries as Q
from vouch.llm.common import written
from vouch.sources.tables import Tables

STAGES = [
    ("toxicity", Q.stage_toxicity),
    ("near_duplicates", Q.stage_near_duplicates),
    ("decontamination", Q.stage_decontamination),
    ("mixing", Q.stage_mixing),
    ("sharding", Q.stage_sharding),
]

#: SQL expresses neither the learned severity nor the latent retrieval; the
#: tests hold the rows that toxicity and near duplicates keep against a plain
#: version, those of decontamination against planted items, and mixing and
#: sharding against the SQL of their queries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
