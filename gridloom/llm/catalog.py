"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import oracles
from gridloom.llm.ann import nearest
from gridloom.llm.decontam import NEAR, contamination
from gridloom.llm.langid import languages
from gridloom.llm.licenses import licensed
from gridloom.llm.neardup import near_duplicates
from gridloom.llm.packing import packed
from gridloom.llm.repeats import without_repeats
from gridloom.llm.secrets import digest
from gridloom.llm.sharding import sharded
from gridloom.llm.toxicity import toxicity
from gridloom.llm.workspace import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op8_decontam_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_decontam with the proximity matches in further columns."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=NEAR).drop("h")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_packing, op4_langid, op5_licenses, op6_sharding, op7_neardup, op8_decontam, op8_decontam_near, op9_ann, op10_repeats)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": oracles.secret_spans(), "op5_licenses": oracles.license_notices(), "op7_neardup": oracles.near_duplicates(), "op8_decontam": oracles.decontamination(), "op8_decontam_near": oracles.proximity()}
