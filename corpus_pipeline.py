"""The corpus pipeline: quality rules, language ID, line dedup, SimHash near-dedup and packing of ``documents``.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` writes every stage's result as
Parquet to the cluster's shared folder and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vectrill.llm._common import ensure_checkpoint_dir
from vectrill.llm.langid import language_stage
from vectrill.llm.linededup import line_dedup_stage
from vectrill.llm.packing import packing_stage
from vectrill.llm.quality import quality_stage
from vectrill.llm.simhash import simhash_stage
from vectrill.sources.storage import Files

STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("packing", packing_stage),
]

#: Learned profiles, XXH64 fingerprints and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows, read back from its table. A stage's table goes when the next
    one's is written; the last one is the caller's to remove."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    files = Files(spark, base)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            files.delete(f"{base}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
