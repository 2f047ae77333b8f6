"""A training corpus from raw documents: each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glasswake.llm.common import cut, table
from glasswake.llm.queries import stage_mix, stage_near_duplicates, stage_pack, stage_quality, stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("quality_rules", stage_quality),
    ("simhash_near_dedup", stage_near_duplicates),
    ("mixing", stage_mix),
    ("best_fit_packing", stage_pack),
]

#: A trained classifier, 64-bit hashing and a tokenizer have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
