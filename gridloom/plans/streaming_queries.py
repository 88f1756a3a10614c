"""Streaming queries over the driver's tables, run to their end by available-now triggers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.sources import views as V
from gridloom.sources.store import shared_folder
from gridloom.streaming.sessions import stream_profile, stream_sessions


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = V.read(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("user_id").alias("sid"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("cls"), F.round(F.col("value") * 100).cast("long").alias("val"))


def finished(df: DataFrame) -> DataFrame:
    """The rows of a streaming aggregate over what is there now. Complete mode: windows that no watermark has closed count too.
    Each batch replaces the table of the one before in the shared folder; nothing passes the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = df.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows"))
    out.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS cls, count(*) AS n, CAST(min(round(value * 100)) AS BIGINT) AS lo, CAST(max(round(value * 100)) AS BIGINT) AS hi FROM events GROUP BY ALL".replace("time_bucket(INTERVAL '1 day', ts) AS start", "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day"))
def streaming_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tumbling windows."""
    out = finished(stream_profile(_events(spark, sf_dir), "1 day"))
    return out.select(F.datediff(F.date_trunc("day", "start").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), "cls", "n", "lo", "hi")


@query("""g AS (SELECT user_id AS sid, ts, CAST(round(value * 100) AS BIGINT) AS val, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY sid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT sid, count(*) AS n, CAST(sum(val) AS BIGINT) AS total FROM s GROUP BY sid, k""")
def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of two hours."""
    return finished(stream_sessions(_events(spark, sf_dir), "2 hours")).select("sid", "n", "total")
