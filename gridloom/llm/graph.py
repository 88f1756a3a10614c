"""Connected components of an edge table; only a short one, whose rows are counted first, is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.workspace import discard, stored


#: Edges that the driver gets at most (1.6 MB); a longer table is worked on by rounds of joins.
LOCAL_EDGES = 100_000


def _joined(edges: pa.Table) -> pa.Table:
    """components() of a collected table."""
    ends = np.stack([edges.column(k).to_numpy() for k in (0, 1)])
    nodes, at = np.unique(ends, return_inverse=True)
    up = list(range(len(nodes)))  # nodes are sorted: the root of each tree is its smallest

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in at.reshape(2, -1).T.tolist():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    least = nodes[[root(k) for k in range(len(nodes))]] if len(nodes) else nodes
    moved = least != nodes
    return pa.table({"u": pa.array(nodes[moved], pa.int64()), "v": pa.array(least[moved], pa.int64())})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): each node that has an edge and is not the smallest of its component, with that
    smallest node. Alternates large and small stars until nothing changes; each round is a table in
    the shared folder. Rows with nulls and self links are ignored."""
    some = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    few = some.limit(LOCAL_EDGES + 1)
    if few.count() <= LOCAL_EDGES:
        return stored(edges.sparkSession.createDataFrame(_joined(few.toArrow()), "u long, v long"), "stars")
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        before, now = now, stored(_small_star(_large_star(now)), "stars")
        discard(before)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == seen:
            return now
        seen = tuple(got)
    raise RuntimeError("components did not settle")
