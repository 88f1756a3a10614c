"""Streaming forms of the session and value-profile operators.

The batch operator takes its gap from the data; a stream can't look ahead, so the gap is a parameter, for
example one that the batch operator found before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, gap: str, late: str = "10 minutes", by: str = "sid", time: str = "ts", value: str = "val") -> DataFrame:
    """(by, start, end, n, total) of sessions closed by the watermark; rows later than `late` are dropped, which
    is what the watermark means."""
    w = F.session_window(F.col(time), gap)
    s = events.withWatermark(time, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def stream_profile(events: DataFrame, window: str, late: str = "10 minutes", key: str = "cls", time: str = "ts", value: str = "val") -> DataFrame:
    """(start, key, n, lo, hi) of tumbling windows: rows and range of the value."""
    p = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return p.select(F.col("w.start").alias("start"), key, "n", "lo", "hi")
