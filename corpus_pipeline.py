"""A training-data pipeline over ``documents``: quality rules, near-duplicates, personal data, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all that the stage before it kept.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.bpe import stage_bpe
from barloom.llm.common import table
from barloom.llm.mixing import stage_mixing
from barloom.llm.neardup import stage_neardup
from barloom.llm.pii import stage_pii
from barloom.llm.quality import stage_quality
from barloom.session import ensure_checkpoint_dir

STAGES = [
    ("quality", stage_quality),
    ("neardup", stage_neardup),
    ("pii", stage_pii),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: SQL cannot express hashed n-gram scores, sketches and alignments, or pair merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage returns is written as Parquet and read again by the next."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
