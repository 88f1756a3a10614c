"""Nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts, by recursive bisection of its
slowest-mixing direction. A small network learns to tell a vector's part from the vector; it puts each row of
the table into one part and routes each query to its most probable parts, where candidates are ranked
by exact inner products. How many parts a query visits is chosen on the sample, for the recall wanted.

Parts that would hold too many rows are partitioned again in the same way, each by a network of its own, fitted on a
sample of its rows; so the number of parts grows with the table, and neither rows nor queries are copied more often the
larger it gets. Of the parts of all levels a query visits those whose probabilities have the largest product.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.workspace import discard, stored

#: The most rows on which the partition is fitted.
SAMPLE_ROWS = 4096
PARTS = 16
NEIGHBOURS = 20
RECALL = 0.97
#: Rows of a part that one task searches; a table gets so many levels that parts hold about that many.
BLOCK_ROWS = 50_000
BLOCK_QUERIES = 10_000
#: Parts that a query visits at most where there are several levels.
VISITS = 48


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _bisect(near: np.ndarray, nodes: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced parts of the graph on nodes."""
    label = np.zeros(len(nodes), np.int64)
    if parts < 2 or len(nodes) < 2 * parts:
        return label
    where = np.full(near.shape[0], -1)
    where[nodes] = np.arange(len(nodes))
    to = where[near[nodes]]
    src, dst = np.repeat(np.arange(len(nodes)), near.shape[1]), to.ravel()
    ok = dst >= 0
    src, dst = np.concatenate([src[ok], dst[ok]]), np.concatenate([dst[ok], src[ok]])
    degree = np.bincount(src, minlength=len(nodes)) + 1.0
    v = rng.normal(size=len(nodes))
    for _ in range(60):
        v = (v + (v + np.bincount(src, weights=v[dst], minlength=len(nodes))) / degree) / 2
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-30
    order = np.argsort(v, kind="stable")
    half = parts // 2
    cut = len(nodes) * half // parts
    label[order[:cut]] = _bisect(near, nodes[order[:cut]], half, rng)
    label[order[cut:]] = half + _bisect(near, nodes[order[cut:]], parts - half, rng)
    return label


def fit(x: np.ndarray, parts: int = PARTS, k: int = NEIGHBOURS, recall: float = RECALL, hidden: int = 64, epochs: int = 40, seed: int = 5) -> Router:
    rng = np.random.default_rng(seed)
    n, d = x.shape
    x = x.astype(np.float64)
    near = np.empty((n, min(k, max(1, n - 1))), np.int64)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        near[a : a + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if n > 1 else 0
    parts = max(1, min(parts, n // 8))
    label = _bisect(near, np.arange(n), parts, rng)
    own = np.zeros((n, parts))
    np.add.at(own, (np.repeat(np.arange(n), near.shape[1]), label[near].ravel()), 0.5 / near.shape[1])
    own[np.arange(n), label] += 0.5
    scale = 1 / (x.std() + 1e-12)
    p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs if parts > 1 else 0):
        for at in np.array_split(rng.permutation(n), max(1, n // 128)):
            xb, t = x[at] * scale, t + 1
            h = np.maximum(xb @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - own[at]) / len(at)
            gh = (g @ p[2].T) * (h > 0)
            for q, gr in enumerate((xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[q] = 0.9 * m[q] + 0.1 * gr
                v[q] = 0.99 * v[q] + 0.01 * gr * gr
                p[q] = p[q] - 0.003 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.99**t)) + 1e-8)
    out = Router(p[0] * scale, p[1], p[2], p[3], parts)
    z = out.logits(x)
    home, ranks = z.argmax(1), np.argsort(np.argsort(-z, axis=1), axis=1)
    hit = ranks[np.arange(n)[:, None], home[near]]
    share = np.bincount(hit.ravel(), minlength=parts).cumsum() / hit.size
    out.probes = int(min(parts, np.searchsorted(share, recall) + 1))
    return out


def _valid(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with a key and a vector that isn't null or zero and has only finite components."""
    v = F.col(value).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0.0))


def top(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) of every query in this block, ties to the smaller id.
    Scores are summed in the order of the components, so equal vectors get equal scores."""
    a, b, c = [], [], []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        s[qids[at : at + 256, None] == ids[None, :]] = -np.inf
        least = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        for i in range(len(s)):
            own = np.flatnonzero((s[i] >= least[i] - slack[i]) & np.isfinite(s[i]))
            if not len(own):
                continue
            exact = np.cumsum(x[own] * q[at + i], axis=1)[:, -1]
            best = np.lexsort((ids[own], -exact))[:k]
            a.append(np.full(len(best), qids[at + i]))
            b.append(ids[own[best]])
            c.append(exact[best])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def _log_shares(router: Router, x: np.ndarray) -> np.ndarray:
    z = router.logits(x)
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _placed(p: pd.DataFrame, router: Router, parts: int) -> pd.DataFrame:
    """Rows with the number of their part below the part that they are in."""
    return p.assign(part=p["part"].to_numpy() * parts + router.logits(np.stack(p["v"])).argmax(1))


def _routed(p: pd.DataFrame, router: Router, parts: int) -> pd.DataFrame:
    """A row for each of the most probable parts, with the sum of the log probabilities on the way."""
    z = _log_shares(router, np.stack(p["v"]))
    at = np.argsort(-z, axis=1)[:, : router.probes]
    out = p.loc[p.index.repeat(at.shape[1])]
    return out.assign(part=out["part"].to_numpy() * parts + at.ravel(), w=out["w"].to_numpy() + np.take_along_axis(z, at, 1).ravel())


ROW = "id long, v array<double>, part long, w double"


def _salted(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """rows with a salt s, so that no (part, s) has many more than `most` of them; and the parts' numbers of salts as table."""
    return rows.join(counts.select("part", F.ceil(F.col("c") / most).cast("int").alias("k")), "part").withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))


def _deeper(rows: DataFrame, routers: DataFrame, parts: int, place, most: int) -> DataFrame:
    """place() of the rows of each part by the part's own router."""
    counts = stored(rows.groupBy("part").agg(F.count("*").alias("c")), "counts")
    known = routers.join(counts, "part").withColumn("s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / most).cast("int") - 1)))

    def run(x: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return x[["id", "v", "part", "w"]]
        x = x[["id", "v", "part", "w"]]
        if not len(r):  # a part of so few rows that none was drawn stays whole
            return x.assign(part=x["part"] * parts)
        return place(x, pickle.loads(r["router"].iloc[0]), parts)

    return _salted(rows, counts, most).groupBy("part", "s").cogroup(known.groupBy("part", "s")).applyInPandas(run, ROW)


def _search(base: DataFrame, asked: DataFrame, k: int, block_rows: int, block_queries: int) -> DataFrame:
    """The k best of each query in each part that it visits. A large part is cut into blocks of rows and of queries."""
    n = base.groupBy("part").agg(F.count("*").alias("c")).select("part", F.ceil(F.col("c") / block_rows).cast("int").alias("nb"))
    m = asked.groupBy("part").agg(F.count("*").alias("c")).select("part", F.ceil(F.col("c") / block_queries).cast("int").alias("nq"))
    blocks = stored(n.join(m, "part"), "blocks")
    salt = lambda seed, count: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    x = base.select("id", "v", "part").join(blocks, "part").withColumn("b", salt(1, "nb")).withColumn("q", all_of("nq"))
    y = asked.select("id", "v", "part").join(blocks, "part").withColumn("q", salt(2, "nq")).withColumn("b", all_of("nb"))

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        a, b, c = top(np.stack(x["v"]), x["id"].to_numpy(), np.stack(q["v"]), q["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    by = ["part", "b", "q"]
    keep = ["id", "v", *by]
    found = x.select(keep).groupBy(*by).cogroup(y.select(keep).groupBy(*by)).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", value: str = "embedding", parts: int = PARTS, recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row whose key is
    divisible by `every`, its own row left out.

    Vectors that are null, zero, hold null or non-finite components, or aren't of the table's most
    common length take no part. Of rows with one key a single one counts, that of the smallest vector.
    A query whose parts hold fewer than k others is searched in all parts. An empty table gives no rows."""
    rows = _valid(vectors, key, value)
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    d = sizes[0] if sizes else 0
    rows = stored(rows.filter(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    if not got:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = rows.count()
    levels = max(1, math.ceil(math.log(max(1, n / block_rows)) / math.log(parts))) if parts > 1 else 1
    near, wanted = min(k, 20), recall ** (1 / levels)
    router = spark.sparkContext.broadcast(fit(np.array([r[1] for r in got]), parts, near, wanted))

    def each(place):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in it:
                if len(p):
                    yield place(p, router.value, parts)

        return run

    start = rows.withColumns({"part": F.lit(0).cast("long"), "w": F.lit(0.0)})
    base = start.mapInPandas(each(_placed), ROW)
    asked = start.filter(F.col("id") % every == 0).mapInPandas(each(_routed), ROW)

    def own(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [p["part"].iloc[0]], "router": [pickle.dumps(fit(np.stack(p["v"]), parts, near, wanted))]})

    for level in range(1, levels):
        base, asked = stored(base, "placed"), stored(asked, "routed")
        # a part's sample: its rows of least hash, drawn from about four times as many
        part = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("id", F.lit(level)), "id"))
        draw = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1, 4 * SAMPLE_ROWS * parts**level / n))
        sample = base.filter(draw).withColumn("k", part).filter(F.col("k") <= SAMPLE_ROWS)
        routers = stored(sample.groupBy("part").applyInPandas(own, "part long, router binary"), "routers")
        whole = base
        base = stored(_deeper(base, routers, parts, _placed, block_rows), "placed")
        visit = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "part"))
        asked = _deeper(asked, routers, parts, _routed, block_queries).withColumn("r", visit).filter(F.col("r") <= VISITS).drop("r")
        discard(whole)
    base, asked = stored(base, "base"), stored(asked, "asked")
    found = stored(_search(base, asked, k, block_rows, block_queries), "found")
    want = min(k, n - 1)
    full = found.groupBy("query_id").agg(F.count("*").alias("c")).filter(F.col("c") >= want).select(F.col("query_id").alias("id"))
    short = stored(rows.filter(F.col("id") % every == 0).join(full, "id", "left_anti"), "short") if want else None
    if short is not None and not short.isEmpty():
        everywhere = short.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts**levels - 1).cast("long"))))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(_search(base, everywhere, k, block_rows, block_queries))
    return found
