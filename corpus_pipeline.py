"""The corpus pipeline: toxic documents, exact copies, near copies and leaked benchmark items go, the rest is packed.

Each stage reads what its predecessor has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mathloom.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from mathloom.llm.shared import Scratch

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard", ngram_join.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: A fitted classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
