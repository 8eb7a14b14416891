"""A training corpus from ``documents``: classify, drop near copies, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads again as
the next stage's docs. Every stage but the last returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import stages
from sievework.llm.common import remove, scratch, shared_path, table, written

STAGES = [
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminated),
    ("mix", stages.mix),
    ("shard", stages.shard),
]

#: The classifier and the fingerprints have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage wrote inside is deleted after it, and its own table once the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
