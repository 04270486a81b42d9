"""The training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldcounts.llm.common import cut, table
from fieldcounts.llm.minhash import dedup_stage
from fieldcounts.llm.packing import packing_stage
from fieldcounts.llm.pii import pii_stage
from fieldcounts.llm.quality import quality_stage
from fieldcounts.llm.substring import substring_stage

STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("substring dedup", substring_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Trained and tokenising stages have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
