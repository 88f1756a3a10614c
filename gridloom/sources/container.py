"""Coded tables in Parquet: one row per stream and a header with schema and plan."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import codecs as C
from gridloom.operators import dependencies as D

VERSION = 2


def write_container(df: DataFrame, path: str, block: int = 65_536) -> None:
    """Long columns of df (with pos) as streams: the plan of dependencies first, then what stays, block by block, each column
    under the codec that costs it least. Columns with nulls are an error."""
    cols = [c for c in df.columns if c != "pos"]
    plan = D.analyze(df, cols)
    kept = D.apply(df, plan)
    C.best_streams(kept, [c for c in kept.columns if c != "pos"], block).write.mode("overwrite").parquet(f"{path}/streams")
    head = {"version": VERSION, "columns": cols, "plan": [asdict(s) for s in plan], "n": df.count(), "block": block}
    df.sparkSession.createDataFrame([(json.dumps(head),)], "header string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> dict:
    head = json.loads(spark.read.parquet(f"{path}/header").first()[0])
    if head["version"] > VERSION:
        raise ValueError("the container is of a later version")
    return head


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """The table back, with pos; checksums of all streams are verified."""
    head = read_header(spark, path)
    plan = [D.Step(**s) for s in head["plan"]]
    gone = {s.target for s in plan if s.kind != "residual"}
    stored = [c for c in head["columns"] if c not in gone]
    coded = spark.read.parquet(f"{path}/streams")
    cells = C.restored(coded if head["version"] > 1 else coded.withColumn("codec", F.lit("ctx")))
    wide = cells.groupBy("pos").agg(*[F.max(F.when(F.col("col") == c, F.col("v"))).alias(c) for c in stored])
    if not stored:
        wide = spark.range(head["n"]).select(F.col("id").alias("pos"))
    return D.invert(wide, plan).select("pos", *head["columns"])


def same_header(a: dict, b: dict) -> list[str]:
    """Keys whose values differ."""
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
