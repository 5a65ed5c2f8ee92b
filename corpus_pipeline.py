"""Training corpus from raw documents: toxicity, quality, near-duplicates, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps with their columns, the last one the packed pieces. :func:`run`
writes each stage's result to the shared folder and reads it back, so a lost
executor costs a stage's task, not the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.llm.queries import drop_low_quality, drop_near_duplicates, drop_toxic, pack_documents
from strataline.llm.storage import staged

STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_dup", drop_near_duplicates),
    ("packing", pack_documents),
]

# Label models, samplings and tokenizers are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
