"""Long repeated byte strings, by a run-length compressed Burrows-Wheeler transform.

1. Every string of `length` bytes has an anchor: the least hash of its 64-byte grams. Consecutive strings with one
   anchor form a context. Equal strings have equal anchors, so only contexts whose anchor's gram occurs
   again can hold a repeat; equal contexts are kept once, with their count.
2. The distinct contexts that share an anchor come together in one bucket. There a suffix array gives the
   Burrows-Wheeler transform, of which only the runs are kept, with text positions sampled at both ends of
   each. The longest match of a text position elsewhere is found at those samples and streamed along
   the text: between samples it shrinks by one byte a step.
3. Starts whose match reaches `length`, and all of a context that occurs twice, go back to the texts.

Counts by anchor are tables before they are joined, so adaptive execution can split the rows of one anchor.

An anchor with more than HOT distinct contexts isn't gathered: its strings are counted by hash at their
place relative to the anchor, which any number of tasks can share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textkit import chunks, mix, powers
from gridloom.llm.workspace import discard, stored

LENGTH = 200
GRAM = 64
HOT = 20_000
#: Context bytes that a bucket is meant to hold.
BUCKET_BYTES = 1 << 20
BROADCAST_ROWS = 1_000_000
_POS = np.uint64((1 << 28) - 1)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values."""
    n = len(key)
    pad = -n % width
    block = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return total, q


def contexts(off: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last start, anchor position (all within the row), gram hash and context hash."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length:
        return none
    if n > int(_POS):
        raise ValueError("a text of over 256 MB")
    total, q = _prefix(data)
    g = mix((total[gram:] - total[:-gram]) * q[: n - gram + 1])
    key = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    end = np.repeat(off[1:], np.diff(off))[: n - length + 1]
    start = np.flatnonzero(np.arange(n - length + 1) + length <= end)
    if not len(start):
        return none
    at = (_least(key, length - gram + 1)[start] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    a, b, p = start[new], start[last], at[new]
    row = np.searchsorted(off, a, "right") - 1
    whole = mix((total[b + length] - total[a]) * q[a])
    whole = mix(whole + np.uint64(0x9E3779B97F4A7C15) * ((p - a) * 1009 + (b - a)).astype(np.uint64))
    return row, a - off[row], b - off[row], p - off[row], g[p].view(np.int64), whole.view(np.int64)


def ranks(text: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 8, 16, ... bytes, until no two are equal. Positions past the
    end rank lowest."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | pad[k : k + n]
    depth, out = 8, []
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        r = np.empty(n, np.int64)
        r[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
        out.append((depth, r))
        if int(r[order[-1]]) == n or depth >= 4 * n:
            return out
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - depth)] = r[depth:]
        key = (r * (n + 1) + ahead).astype(np.uint64)
        depth *= 2


def common(text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b (pairs)."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    for depth, r in reversed(levels):
        x, y = a + out, b + out
        ok = (x + depth <= n) & (y + depth <= n)
        out[ok] += np.where(r[x[ok]] == r[y[ok]], depth, 0)
    live = np.ones(len(a), bool)
    for _ in range(8):
        x, y = a + out, b + out
        live &= (x < n) & (y < n)
        live[live] = text[x[live]] == text[y[live]]
        out += live
    return out


def matching(text: np.ndarray) -> np.ndarray:
    """For every position the length of its longest match that starts elsewhere in text."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    levels = ranks(text)
    suffix = np.empty(n, np.int64)
    suffix[levels[-1][1] - 1] = np.arange(n)
    bwt = np.where(suffix > 0, text[suffix - 1], 0).astype(np.int16)
    bwt[suffix == 0] = -1
    cut = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # the heads of runs but the first
    best = np.zeros(n, np.int64)
    for own, other in ((cut, cut - 1), (cut - 1, cut)):  # run heads with the suffix before, run ends with the one after
        at, to = suffix[own], suffix[other]
        value = np.full(n, -1, np.int64)
        value[at] = common(text, levels, at, to)
        last = np.maximum.accumulate(np.where(value >= 0, np.arange(n), -1))
        flow = np.where(last >= 0, value[np.maximum(last, 0)] - (np.arange(n) - last), 0)
        best = np.maximum(best, flow)
    return best


def _bucket(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """(g, s, lo, hi): runs of starts of each context whose match elsewhere is long enough."""
    parts, begin, at = [], [], 0
    for x in rows["bytes"]:
        begin.append(at)
        parts.append(np.frombuffer(x, np.uint8))
        parts.append(np.full(1, 255, np.uint8))
        at += len(x) + 1
    hit = matching(np.concatenate(parts)) >= length
    begin = np.array(begin)
    size = rows["bytes"].str.len().to_numpy()
    inside = np.zeros(at + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + size - length + 1, -1)
    hit &= np.cumsum(inside[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    row = np.searchsorted(begin, lo, "right") - 1
    return pd.DataFrame({"g": rows["g"].to_numpy()[row], "s": rows["s"].to_numpy()[row], "lo": lo - begin[row], "hi": hi - begin[row]})


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), (F.crc32(text.cast("binary")) * F.lit(1 << 31) + F.octet_length(text)).alias("h2"))


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, off, data in chunks(b.column(0), 1 << 20):
                row, lo, hi, p, g, s = contexts(off, data, length, gram)
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(p, pa.int32()), pa.array(g), pa.array(s)], names=["h1", "h2", "lo", "hi", "p", "g", "s"])

    return docs.select("text", "h1", "h2").mapInArrow(run, "h1 long, h2 long, lo int, hi int, p int, g long, s long")


def _some(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def removals(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(h1, h2, lo, hi): runs of starts of repeated strings in each distinct text."""
    found = stored(_anchors(keyed, length, gram), "anchors")
    again = stored(found.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g"), "again")
    every, found = found, stored(found.join(again, "g", "left_semi"), "repeated")
    discard(every, again)
    kinds = stored(found.groupBy("g", "s").agg(F.count("*").alias("c"), F.min(F.struct("h1", "h2", "lo", "hi", "p")).alias("x")).select("g", "s", "c", "x.*"), "contexts")
    many = stored(kinds.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1"), "many")
    open_ = kinds.join(many, "g")
    wanted = open_.groupBy("h1", "h2").agg(F.collect_list(F.struct("g", "s", "lo", "hi", "p", "k")).alias("x"))
    wanted = stored(wanted, "wanted")
    texts = keyed.select("h1", "h2", "text").join(_some(wanted.select("h1", "h2")), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, x in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = text.as_py().encode()
                out += [(c["g"], c["s"], c["k"], c["p"] - c["lo"], raw[c["lo"] : c["hi"] + length]) for c in x]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "s", "k", "o", "bytes"])

    pieces = stored(texts.join(wanted, ["h1", "h2"]).select("text", "x").mapInArrow(cut, "g long, s long, k long, o int, bytes binary"), "pieces")
    discard(many, wanted)
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    cold = pieces.filter(F.col("k") <= HOT).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    marks = cold.select("bucket", "g", "s", "bytes").groupBy("bucket").applyInPandas(lambda p: _bucket(p, length), "g long, s long, lo long, hi long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, s, o, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                raw = np.frombuffer(x.as_py(), np.uint8)
                total, q = _prefix(raw)
                n = len(raw) - length + 1
                w = mix((total[length:] - total[:-length]) * q[:n]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array([s] * n), pa.array(np.arange(n)), pa.array(o - np.arange(n)), pa.array(w)], names=["g", "s", "lo", "o", "w"])

    hot = pieces.filter(F.col("k") > HOT)
    if hot.limit(1).count():
        each = stored(hot.select("g", "s", "o", "bytes").mapInArrow(spread, "g long, s long, lo long, o long, w long"), "strings")
        twice = each.groupBy("g", "o", "w").agg(F.count("*").alias("c")).filter("c > 1").select("g", "o", "w")
        marks = marks.union(each.join(twice, ["g", "o", "w"]).select("g", "s", "lo", F.col("lo").alias("hi")))
    marks = stored(marks, "marks")
    discard(pieces)
    place = found.join(kinds.filter("c > 1").select("g", "s"), ["g", "s"], "left_semi").select("h1", "h2", "lo", "hi")
    single = kinds.filter("c = 1").select("g", "s", "h1", "h2", F.col("lo").alias("at"))
    part = single.join(marks, ["g", "s"]).select("h1", "h2", (F.col("at") + F.col("lo")).cast("int").alias("lo"), (F.col("at") + F.col("hi")).cast("int").alias("hi"))
    return place.union(part).distinct()


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (start and end
    bytes of what goes). Bytes covered by a string of `length` bytes that also starts elsewhere, in this row
    or another, go. Null and short texts lose nothing unless they reach `length`; a row that is repeated
    whole loses everything from that length on. What stays need not be valid UTF-8, so it is given as
    spans and a checksum."""
    keyed = _keyed(docs)
    runs = stored(removals(keyed, length, gram).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs")), "runs")
    hit = runs.select("h1", "h2")
    if hit.count() <= BROADCAST_ROWS:
        ids = F.broadcast(hit)
        touched, rest = keyed.join(ids, ["h1", "h2"], "left_semi"), keyed.join(ids, ["h1", "h2"], "left_anti")
        joined = touched.join(runs, ["h1", "h2"])
    else:
        joined, rest = keyed.join(runs, ["h1", "h2"], "left"), None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, count, sha, spans = [], [], [], [], []
            for text, x in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                merged: list[list[int]] = []
                for r in x or ():
                    if merged and r["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["hi"] + length)
                    else:
                        merged.append([r["lo"], r["hi"] + length])
                h, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    h.update(raw[at:lo])
                    at = hi
                h.update(raw[at:])
                n.append(len(raw))
                gone.append(sum(hi - lo for lo, hi in merged))
                count.append(len(merged))
                sha.append(h.hexdigest())
                spans.append([{"start": lo, "end": hi} for lo, hi in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (n, gone, count)], pa.array(sha, pa.string()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    out = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(apply, schema)
    if rest is None:
        return out
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.union(rest.select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long"), zero, zero, F.sha2(F.col("text").cast("binary"), 256), empty))
