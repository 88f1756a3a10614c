"""Stages of a corpus pipeline: each takes and returns documents, but for the last, which packs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.decontam import contamination
from gridloom.llm.neardup import copies
from gridloom.llm.packing import packed
from gridloom.llm.secrets import redacted
from gridloom.llm.toxicity import toxicity
from gridloom.llm.workspace import fresh, stored, table

#: Keys of rows to drop are broadcast up to this many.
BROADCAST_KEYS = 500_000


def _without(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    keys = stored(keys.distinct(), "dropped")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_anti")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from the labelled rows among docs.

    Only texts go to the classifier and only the checksums of rejected texts come back; a text's score depends on nothing else."""
    text = F.col("text").cast("string")
    sums = (F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text))
    names = [fresh(docs, f"toxic_{k}") for k in range(len(sums))]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    judged = toxicity(docs.select("doc_id", lang.alias("lang"), text.alias("text")), table(spark, sf_dir, "labels"))
    bad = judged.filter("predicted = 1").select(*[c.alias(n) for c, n in zip(sums, names, strict=True)])
    return _without(docs.withColumns(dict(zip(names, sums, strict=True))), bad, names).select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of the smallest doc_id in each component of near copies, and one row of those with
    equal doc_id and text. Different texts of one doc_id count each for itself. Rows with a null doc_id stay."""
    hashed = docs.withColumns({"id_": F.col("doc_id").cast("long"), "h_": F.xxhash64(F.col("text").cast("string"))})
    out = _without(hashed, copies(docs).toDF("id_", "h_"), ["id_", "h_"]).select(docs.columns)
    twice = out.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    if twice.isEmpty():
        return out
    ids = F.broadcast(twice) if twice.count() <= BROADCAST_KEYS else twice
    again = out.join(ids, "doc_id", "left_semi")
    # maps have no order of their own
    order = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes if c != "doc_id"]
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*order))
    again = again.select(*docs.columns, first.alias("row_in_group_")).filter("row_in_group_ = 1").select(docs.columns)
    return out.join(ids, "doc_id", "left_anti").select(docs.columns).union(again)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with passages of the benchmark."""
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "h")
    keys = stored(bad.distinct(), "contaminated")
    keys = (F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys).alias("k")
    d = docs.alias("d")
    same = (F.xxhash64(F.col("d.text").cast("string")) == F.col("k.h")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id"))
    return d.join(keys, same, "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets give way to a mark; n_chars follows."""
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences."""
    return stored(packed(docs).drop("ids"), "sequences")
