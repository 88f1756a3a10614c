"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import stages
from gridloom.llm.workspace import discard, keep, scope, stored, table

STAGES = [
    ("toxicity", stages.clean),
    ("neardup", stages.deduplicated),
    ("decontamination", stages.decontaminated),
    ("secrets", stages.without_secrets),
    ("packing", stages.sequences),
]

#: A trained network and a tokenizer have no SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's result is a table in the shared folder; what it needed on the way, and the
    result of the stage before, go as soon as it stands."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scope(spark):
            docs = keep(stored(stage(spark, before, sf_dir), f"stage-{name}"))
        discard(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
