"""Shards of nearly equal size by sampled splitters.

A sample in which a record's chance grows with its size gives quantiles of the key; records are
range-partitioned by them into many more ranges than shards, and ranges that turn out overfull are
subdivided by a denser sample of their own. The key is a hash of the text followed by one of doc_id, so
equal texts lie together and yet a group of copies of any size can be divided; the last bits of the second hash tell
rows of equal text and doc_id apart. Exact sizes of the ranges then place the boundaries of shards, inside a range where need be.
What the driver holds, samples and sums of ranges, is bounded by MOST_RANGES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.workspace import stored

SHARDS = 16
RANGES = 512
#: Rows that a range is meant to hold at most; more rows make more ranges.
RANGE_ROWS = 100_000
#: Yet never more ranges than these; beyond, ranges get longer.
MOST_RANGES = 8192
#: Bits of a key that tell equal rows apart.
ROW_BITS = 20
#: Expected size of the sample for each range.
PER_RANGE = 40
OVERFULL = 2.0


def _chosen(rows: DataFrame, total: int, want: int, seed: int) -> list[tuple[int, int, float]]:
    """Keys (k, t) and weights of about `want` rows, drawn in proportion to size."""
    chance = F.col("size") * (want / max(1, total))
    draw = F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    got = rows.filter(draw < chance).select("k", "t", F.greatest(F.lit(1.0), chance)).collect()
    return sorted(tuple(r) for r in got)


def _quantiles(drawn: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    if not drawn or parts < 2:
        return []
    w = np.cumsum([x[2] for x in drawn])
    at = np.searchsorted(w, w[-1] * np.arange(1, parts) / parts, "left")
    return sorted({drawn[int(i)][:2] for i in at})


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """rows with r, the number of splitters that are at or below the key."""
    ks = np.array([x[0] for x in splitters], np.int64)
    ts = np.array([x[1] for x in splitters], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, t = (b.column(b.schema.names.index(x)).to_numpy() for x in ("k", "t"))
            low, high = np.searchsorted(ks, k, "left"), np.searchsorted(ks, k, "right")
            r = low.copy()
            for key in np.unique(k[low < high]):
                a, z = np.searchsorted(ks, key, "left"), np.searchsorted(ks, key, "right")
                own = k == key
                r[own] = a + np.searchsorted(ts[a:z], t[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int64))], names=[*b.schema.names, "r"])

    return rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, k long, t long, r long")


def sharded(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 1; a null text has size 1 and the checksum of no bytes.
    Shards are intervals of the key order, of sizes within one record of total/shards. Equal rows may take each
    other's slots; rows with a null doc_id sort before others of the same text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_id = F.coalesce(F.xxhash64(F.col("doc_id").cast("long")), F.lit(-(1 << 63)))
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"), by_id.bitwiseAND(F.lit(-1 << ROW_BITS)).bitwiseOR(row).alias("t"))
    rows = stored(rows, "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(max(ranges, -(-n // range_rows)), max(ranges, MOST_RANGES))
    splitters = _quantiles(_chosen(rows, total, PER_RANGE * parts, 11), parts)
    for turn in range(4):
        placed = _ranged(rows, splitters)
        sums = {r: (c, s) for r, c, s in placed.groupBy("r").agg(F.count("*"), F.sum("size")).collect()}
        fat = [r for r, (c, s) in sums.items() if c > 1 and (s > OVERFULL * total / parts or c > OVERFULL * max(n / parts, 50))]
        if not fat or turn == 3:
            break
        ids = rows.sparkSession.createDataFrame([(r,) for r in fat], "r long")
        drawn = _chosen(placed.join(F.broadcast(ids), "r"), sum(sums[r][1] for r in fat), 8 * PER_RANGE * len(fat), 12 + turn)
        bounds = [(-(1 << 63), -(1 << 63)), *splitters, (1 << 63, 0)]
        new = set(splitters)
        for r in fat:
            own = [x for x in drawn if bounds[r] <= x[:2] < bounds[r + 1]]
            new.update(_quantiles(own, 2 * int(np.ceil(max(sums[r][1] * parts / total, sums[r][0] * parts / n)))))
        if len(new) == len(splitters):
            break
        splitters = sorted(new)
    order = sorted(sums)
    before = np.cumsum([(0, 0), *[sums[r] for r in order]], axis=0)[:-1].tolist()
    starts = rows.sparkSession.createDataFrame([(int(r), int(c), int(s)) for r, (c, s) in zip(order, before, strict=True)], "r long, c0 long, s0 long")
    own = Window.partitionBy("r").orderBy("k", "t")
    dealt = placed.withColumn("i", F.row_number().over(own).cast("long") - 1).withColumn("b", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    dealt = dealt.join(F.broadcast(starts), "r").withColumn("i", F.col("i") + F.col("c0"))
    mid = (F.coalesce("b", F.lit(0)) + F.col("s0")).cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(mid * shards / F.lit(max(1, 2 * total))).cast("int"))
    dealt = stored(dealt.select("doc_id", "size", "text_crc32", "i", shard.alias("shard")), "dealt")
    heads = dealt.groupBy("shard").agg(F.min("i").alias("i0"))
    out = dealt.join(F.broadcast(heads), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("i") - F.col("i0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
