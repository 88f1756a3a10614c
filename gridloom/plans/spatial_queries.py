"""Queries on points: neighbours, surveys, octrees and structure."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.operators import entropy as H
from gridloom.operators import ordered as O
from gridloom.operators import spatial as S
from gridloom.plans.column_queries import cond_sql, h_sql, verdict_sql
from gridloom.plans.registry import query
from gridloom.sources import views as V
from gridloom.sources.store import kept

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def knn_sql(k: int, a: str = "pts_emb", b: str = "pts_emb", same: bool = True) -> str:
    return f"SELECT pos, rank, npos, d2 FROM (SELECT a.pos, b.pos AS npos, {D2} AS d2, CAST(row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS INTEGER) AS rank FROM {a} a JOIN {b} b ON {'a.pos <> b.pos' if same else 'true'}) WHERE rank <= {k}"


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pts_emb(spark, sf_dir)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _emb(spark, sf_dir)
    return e.filter("pos % 2 = 0"), e.filter("pos % 2 = 1")


HALVES = "ta AS (SELECT * FROM pts_emb WHERE pos % 2 = 0), tb AS (SELECT * FROM pts_emb WHERE pos % 2 = 1)"


@query(f"k AS ({knn_sql(4)}) SELECT pos, rank, npos, round(d2, 9) AS d2 FROM k", ("pts_emb",))
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    return S.knn(e, e, 4, same=True).withColumn("d2", F.round("d2", 9))


@query(f"SELECT a.pos, count(b.pos) AS n FROM pts_emb a LEFT JOIN pts_emb b ON a.pos <> b.pos AND {D2} <= 0.01 GROUP BY a.pos", ("pts_emb",))
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    hit = S.near_pairs(e, e, 0.1).filter("pos <> npos and d2 <= 0.01").groupBy("pos").agg(F.count("*").alias("n"))
    return e.select("pos").join(hit, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"))


_CAUSAL = f"""k AS ({knn_sql(7)}), c AS (SELECT k.pos, npos, row_number() OVER (PARTITION BY k.pos ORDER BY rank) AS r FROM k WHERE npos < k.pos),
p AS (SELECT c.pos, sum(e.label) AS s, count(*) AS c FROM c JOIN pts_emb e ON e.pos = c.npos WHERE r <= 3 GROUP BY c.pos),
r AS (SELECT e.label - coalesce(CASE WHEN s >= 0 THEN floor((2.0 * s + c) / (2 * c)) ELSE -floor((-2.0 * s + c) / (2 * c)) END, q.label, 0) AS r FROM pts_emb e LEFT JOIN p ON p.pos = e.pos LEFT JOIN pts_emb q ON q.pos = e.pos - 1)"""


@query(f"{_CAUSAL} SELECT CAST(r AS BIGINT) AS residual, count(*) AS n FROM r GROUP BY 1", ("pts_emb",))
def causal_knn_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the seven nearest points the first three that come earlier in storage order predict the label; without
    any, the point before does."""
    e = _emb(spark, sf_dir)
    earlier = S.knn(e, e, 7, same=True).filter("npos < pos")
    earlier = earlier.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("rank"))).filter("r <= 3")
    label = e.select(F.col("pos").alias("npos"), F.col("label").alias("nl"))
    p = earlier.join(label, "npos").groupBy("pos").agg(E.mean_round(F.sum("nl"), F.count("*")).alias("guess"))
    before = e.select((F.col("pos") + 1).alias("pos"), F.col("label").alias("prev"))
    r = e.join(p, "pos", "left").join(before, "pos", "left").select((F.col("label") - F.coalesce("guess", "prev", F.lit(0))).alias("residual"))
    return r.groupBy("residual").agg(F.count("*").alias("n"))


@query("""p AS (SELECT a.pos, a.pos - b.pos AS back, abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) AS l1 FROM pts_li a JOIN pts_li b ON b.pos < a.pos AND b.pos >= a.pos - 16),
m AS (SELECT pos, min((l1, back)) AS m FROM p GROUP BY pos) SELECT CAST(m[2] AS INTEGER) AS back, count(*) AS n, CAST(sum(m[1]) AS BIGINT) AS l1 FROM m GROUP BY 1""".replace("m[2]", "struct_extract(m, 2)").replace("m[1]", "struct_extract(m, 1)"), ("pts_li",))
def back_window_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest by L1 of the last 16 rows, ties to the latest."""
    w = 16
    li = O.with_lags(V.pts_li(spark, sf_dir).select("pos", "x", "y", "z"), {f"l{k}": (F.struct("x", "y", "z"), k) for k in range(1, w + 1)})
    l1 = lambda k: sum((F.abs(F.col(c) - F.col(f"l{k}.{c}")) for c in "yz"), F.abs(F.col("x") - F.col(f"l{k}.x")))
    best = F.array_min(F.filter(F.array(*[F.struct(l1(k).alias("l1"), F.lit(k).alias("back")) for k in range(1, w + 1)]), lambda s: s["l1"].isNotNull()))
    return li.select(best.alias("m")).filter("m is not null").groupBy(F.col("m.back").alias("back")).agg(F.count("*").alias("n"), F.sum("m.l1").alias("l1"))


@query(f"k AS ({knn_sql(1)}), o AS (SELECT sqrt(d2) AS d, row_number() OVER (ORDER BY d2) - 1 AS i, count(*) OVER () AS n FROM k) SELECT n, round(d, 9) AS spacing FROM o WHERE i = n // 2", ("pts_emb",))
def point_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    d = S.knn(e, e, 1, same=True)
    n, med = d.count(), O.upper_median(d, "d2")
    return spark.createDataFrame([(n, round(float(np.sqrt(med)), 9) if n else None)], "n long, spacing double")


@query(f"k AS ({knn_sql(1)}) SELECT count(*) AS n, round(stddev_pop(sqrt(d2)) / avg(sqrt(d2)), 6) AS cv FROM k", ("pts_emb",))
def nn_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    d = F.sqrt("d2")
    return S.knn(e, e, 1, same=True).agg(F.count("*").alias("n"), F.round(F.stddev_pop(d) / F.avg(d), 6).alias("cv"))


@query(f"k AS ({knn_sql(6)}) SELECT rank, round(avg(sqrt(d2)), 6) AS mean, round(stddev_pop(sqrt(d2)) / avg(sqrt(d2)), 6) AS cv FROM k GROUP BY rank", ("pts_emb",))
def neighbour_rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    d = F.sqrt("d2")
    return S.knn(e, e, 6, same=True).groupBy("rank").agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_pop(d) / F.avg(d), 6).alias("cv"))


def _side_sql(name: str, a: str, b: str) -> str:
    return f"SELECT '{name}' AS side, count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS hausdorff, round(max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN d END), 6) AS p95 FROM (SELECT sqrt(d2) AS d, row_number() OVER (ORDER BY d2) - 1 AS i, count(*) OVER () AS n FROM ({knn_sql(1, a, b, False)}))"


@query(f"{HALVES} {_side_sql('ab', 'ta', 'tb')} UNION ALL {_side_sql('ba', 'tb', 'ta')}", ("pts_emb",))
def chamfer_hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    out = []
    for name, p, q in (("ab", a, b), ("ba", b, a)):
        d = S.knn(p, q, 1)
        p95 = O.order_statistic(d, "d2", 0.95)
        out.append(d.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.round(F.avg(F.sqrt("d2")), 6).alias("mean"), F.round(F.sqrt(F.max("d2")), 6).alias("hausdorff"), F.round(F.sqrt(F.lit(p95)), 6).alias("p95")))
    return out[0].union(out[1])


@query(f"""{HALVES}, k AS ({knn_sql(1, 'ta', 'tb', False)}), r AS (SELECT CAST(round((a.x - b.x) / 0.02) AS BIGINT) AS rx, CAST(round((a.y - b.y) / 0.02) AS BIGINT) AS ry, CAST(round((a.z - b.z) / 0.02) AS BIGINT) AS rz FROM k JOIN ta a USING (pos) JOIN tb b ON b.pos = k.npos),
l AS (SELECT 'x' AS col, rx AS v FROM r UNION ALL SELECT 'y', ry FROM r UNION ALL SELECT 'z', rz FROM r) {h_sql('l')}""", ("pts_emb",))
def nearest_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    k = S.knn(a, b, 1).join(a.select("pos", *"xyz"), "pos").join(b.select(F.col("pos").alias("npos"), *[F.col(c).alias(f"n{c}") for c in "xyz"]), "npos")
    return H.order0(k, {c: E.quantize(F.col(c) - F.col(f"n{c}"), 0.02) for c in "xyz"})


DEPTH = 5


def occ_sql(source: str, depth: int = DEPTH) -> str:
    q = lambda c: f"CAST(least(greatest(floor(({c} + 1) / 2 * {1 << depth}), 0), {(1 << depth) - 1}) AS BIGINT)"
    return f"""SELECT level, x >> 1 AS px, y >> 1 AS py, z >> 1 AS pz, CAST(bit_or(1 << CAST((x & 1) * 4 + (y & 1) * 2 + (z & 1) AS INTEGER)) AS BIGINT) AS byte FROM (
SELECT DISTINCT level, {', '.join(f'{q(c)} >> ({depth} - level) AS {c}' for c in 'xyz')} FROM {source}, (SELECT unnest(range(1, {depth + 1})) AS level)) GROUP BY ALL"""


@query(f"o AS ({occ_sql('pts_emb')}), h AS ({h_sql('o', 'level', 'byte')}) SELECT CAST(level AS INTEGER) AS level, n AS parents, h, (SELECT CAST(sum(bit_count(byte)) AS BIGINT) FROM o WHERE o.level = h.level) AS children FROM h", ("pts_emb",))
def octree_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.occupancy(_emb(spark, sf_dir), DEPTH).groupBy("level", "byte").agg(F.count("*").alias("c"))
    h = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    return o.groupBy("level").agg(F.sum("c").alias("parents"), F.round(h, 6).alias("h"), F.sum(F.bit_count("byte") * F.col("c")).alias("children"))


def _conditional_by_level(cells: DataFrame, hit: bool) -> DataFrame:
    bits = lambda c: F.log2(F.sum(c)) - F.sum(F.col(c) * F.log2(c)) / F.sum(c)
    cells = cells.groupBy("level", "byte", "ctx").agg(F.count("*").alias("k"))
    joint = cells.groupBy("level").agg(bits("k").alias("joint"), F.sum("k").alias("n"), F.sum(F.when(F.col("ctx") != 256, F.col("k")).otherwise(0)).alias("hits"))
    given = cells.groupBy("level", "ctx").agg(F.sum("k").alias("k")).groupBy("level").agg(bits("k").alias("given"))
    plain = cells.groupBy("level", "byte").agg(F.sum("k").alias("k")).groupBy("level").agg(bits("k").alias("h"))
    out = joint.join(given, "level").join(plain, "level")
    cols = ["level", "n", F.round("h", 6).alias("h"), F.round(F.col("joint") - F.col("given"), 6).alias("h_given")]
    return out.select(*cols, *([F.round(F.col("hits") / F.col("n"), 6).alias("hit")] if hit else []))


def _level_sql(cells: str, hit: bool) -> str:
    h = "log2(sum(k)) - sum(k * log2(k)) / sum(k)"
    return f"""c AS (SELECT level, byte, ctx, count(*) AS k FROM ({cells}) GROUP BY ALL),
j AS (SELECT level, {h} AS joint, CAST(sum(k) AS BIGINT) AS n, sum(CASE WHEN ctx <> 256 THEN k ELSE 0 END) / sum(k) AS hit FROM c GROUP BY level),
g AS (SELECT level, {h} AS given FROM (SELECT level, ctx, sum(k) AS k FROM c GROUP BY ALL) GROUP BY level), p AS (SELECT level, {h} AS h FROM (SELECT level, byte, sum(k) AS k FROM c GROUP BY ALL) GROUP BY level)
SELECT CAST(level AS INTEGER) AS level, n, round(h, 6) AS h, round(joint - given, 6) AS h_given{', round(hit, 6) AS hit' if hit else ''} FROM j JOIN g USING (level) JOIN p USING (level)"""


@query(f"{HALVES}, oa AS ({occ_sql('ta')}), ob AS ({occ_sql('tb')}), " + _level_sql("SELECT a.level, a.byte, coalesce(b.byte, 256) AS ctx FROM oa a LEFT JOIN ob b USING (level, px, py, pz)", True), ("pts_emb",))
def octree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy bytes of one survey given the other's at the same node (256: no such node)."""
    a, b = _halves(spark, sf_dir)
    key = ["level", "px", "py", "pz"]
    both = S.occupancy(a, DEPTH).join(S.occupancy(b, DEPTH).withColumnRenamed("byte", "ref"), key, "left")
    return _conditional_by_level(both.select("level", "byte", F.coalesce("ref", F.lit(256)).alias("ctx")), True)


@query(f"o AS ({occ_sql('pts_emb')}), " + _level_sql("SELECT c.level, c.byte, p.byte AS ctx FROM o c JOIN o p ON p.level = c.level - 1 AND p.px = c.px >> 1 AND p.py = c.py >> 1 AND p.pz = c.pz >> 1", False), ("pts_emb",))
def octree_context_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy bytes given the parent's."""
    o = S.occupancy(_emb(spark, sf_dir), DEPTH)
    up = o.select((F.col("level") + 1).alias("level"), *[F.col(f"p{c}").alias(f"g{c}") for c in "xyz"], F.col("byte").alias("ctx"))
    child = o.withColumns({f"g{c}": F.shiftright(f"p{c}", 1) for c in "xyz"})
    return _conditional_by_level(child.join(up, ["level", "gx", "gy", "gz"]).select("level", "byte", "ctx"), False)


def _shift_sql(s: int) -> str:
    c = [f"(x >> {s})", f"(y >> {max(0, s - 8)})", f"(z >> {max(0, s - 8)})"]
    return f"SELECT {s} AS shift, {c[0]} AS a, {c[1]} AS b, {c[2]} AS c FROM pts_li"


@query(f"""l AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(_shift_sql(s) for s in range(0, 16, 3))})), o AS (SELECT shift, (a & 1) + 2 * (b & 1) + 4 * (c & 1) AS v FROM l), h AS ({h_sql('o', 'shift')}) SELECT CAST(shift AS INTEGER) AS shift, n AS cells, h, {verdict_sql('h', E.LEVEL_VERDICTS)} AS verdict FROM h""", ("pts_li",))
def regime_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells and entropy of the child octant for nested cell sizes."""
    li = V.pts_li(spark, sf_dir)
    at = lambda c, s: F.shiftright(c, s)
    cells = F.array(*[F.struct(F.lit(s).alias("shift"), at("x", s).alias("a"), at("y", max(0, s - 8)).alias("b"), at("z", max(0, s - 8)).alias("c")) for s in range(0, 16, 3)])
    each = li.select(F.explode(cells).alias("s")).select("s.*").distinct()
    one = lambda c, w: F.col(c).bitwiseAND(F.lit(1).cast("long")) * w
    o = each.groupBy("shift", (one("a", 1) + one("b", 2) + one("c", 4)).alias("v")).agg(F.count("*").alias("k"))
    r = o.groupBy("shift").agg(F.sum("k").alias("cells"), F.round(F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k"), 6).alias("h"))
    return r.withColumn("verdict", E.verdict(F.col("h"), E.LEVEL_VERDICTS))


STEPS = (0.02, 0.05, 0.1, 0.2)


@query(" UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS step, count(DISTINCT (floor(x / {s}), floor(y / {s}), floor(z / {s}))) AS voxels FROM pts_emb" for s in STEPS), ("pts_emb",))
def distinct_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    cells = e.select(F.explode(F.array(*[F.struct(F.lit(s).alias("step"), *[E.cell(F.col(c), s).alias(c) for c in "xyz"]) for s in STEPS])).alias("s")).select("s.*").distinct()
    return cells.groupBy("step").agg(F.count("*").alias("voxels"))


@query("""d AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pts_emb a JOIN pts_emb b ON a.pos <> b.pos), h AS (SELECT CAST(floor(d / 0.0025) AS INTEGER) AS bin, count(*) AS pairs FROM d WHERE d < 0.2 GROUP BY 1),
s AS (SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM pts_emb)
SELECT bin, pairs, round(pairs / (n * (n / area) * pi() * 0.0025 * 0.0025 * ((bin + 1) * (bin + 1) - bin * bin)), 6) AS g FROM h, s""", ("pts_emb",))
def radial_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts of the plane in 80 shells up to 0.2, over those of a uniform cloud."""
    e = _emb(spark, sf_dir)
    pairs = S.near_pairs(e, e, 0.2, ("x", "y")).filter("pos <> npos").withColumn("d", F.sqrt("d2")).filter("d < 0.2")
    h = pairs.groupBy(F.floor(F.col("d") / 0.0025).cast("int").alias("bin")).agg(F.count("*").alias("pairs"))
    s = e.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    b = F.col("bin")
    shell = F.pi() * 0.0025 * 0.0025 * ((b + 1) * (b + 1) - b * b)
    return h.crossJoin(F.broadcast(s)).select("bin", "pairs", F.round(F.col("pairs") / (F.col("n") * (F.col("n") / F.col("area")) * shell), 6).alias("g"))


@query("""e AS (SELECT asin(greatest(-1, least(1, z / sqrt(x*x + y*y + z*z)))) AS el FROM pts_emb WHERE x*x + y*y + z*z > 0), r AS (SELECT min(el) AS lo, max(el) AS hi FROM e),
h AS (SELECT CAST(least(31, floor((el - lo) / (hi - lo) * 32)) AS INTEGER) AS bin, count(*) AS n FROM e, r GROUP BY 1), a AS (SELECT bin, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(32)) AS INTEGER) AS bin) LEFT JOIN h USING (bin)),
m AS (SELECT bin, n, n > 0.05 * max(n) OVER () AS up FROM a) SELECT bin, n, up AND NOT coalesce(lag(up) OVER (ORDER BY bin), false) AS ring FROM m""", ("pts_emb",))
def ring_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation histogram of 32 bins, and where a run of bins above a twentieth of the peak begins."""
    x, y, z = (F.col(c) for c in "xyz")
    r = F.sqrt(x * x + y * y + z * z)
    e = _emb(spark, sf_dir).filter(r > 0).select(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))).alias("el"))
    lo, hi = e.agg(F.min("el"), F.max("el")).first()
    bin_ = F.least(F.lit(31), F.floor(F.try_divide(F.col("el") - lo, F.lit(hi) - lo) * 32)).cast("int")
    h = spark.range(32).select(F.col("id").cast("int").alias("bin")).join(e.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("bin")  # 32 rows
    up = F.col("n") > 0.05 * F.max("n").over(Window.partitionBy())
    return h.withColumn("up", up).select("bin", "n", (F.col("up") & ~F.coalesce(F.lag("up").over(w), F.lit(False))).alias("ring"))


@query("""m AS (SELECT *, round(avg(label) OVER (PARTITION BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1))) AS m FROM pts_emb), o AS (SELECT abs(label - m) AS e, row_number() OVER (ORDER BY abs(label - m)) - 1 AS i, count(*) OVER () AS n FROM m)
SELECT count(*) AS n, round(avg(e), 6) AS mean_err, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN e END) AS p95 FROM o""", ("pts_emb",))
def leaf_mean_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select("label", *[E.cell(F.col(c), 0.1).alias(c) for c in "xyz"])
    means = e.groupBy("x", "y", "z").agg(F.round(F.avg("label")).alias("m"))
    d = e.join(means, ["x", "y", "z"]).select(F.abs(F.col("label") - F.col("m")).alias("e"))
    p95 = O.order_statistic(d, "e", 0.95)
    return d.agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean_err")).withColumn("p95", F.lit(p95).cast("double"))


@query()
def surface_leaves_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane of every leaf cell that holds four points: count, flatness and octahedral code of the normal."""
    e = _emb(spark, sf_dir)
    key = F.xxhash64(*[E.cell(F.col(c), 0.2) for c in "xyz"])
    leaf = S.eigen3(e.withColumn("leaf", key), "leaf").filter("n >= 4")
    u, v = E.octahedral(F.col("nx"), F.col("ny"), F.col("nz"))
    return leaf.select("leaf", "n", F.round("l0", 9).alias("l0"), u.alias("u"), v.alias("v"))


def octant_experiment(e: DataFrame, size: float) -> DataFrame:
    """(cells, coverage, h, h_given, hit): the child octant in which an occupied cell's points first lie, and how much the plane through its
    occupied neighbouring cells (six at least) tells of it. coverage is the share of cells with such a plane; over those, h and
    h_given are the octant's entropy and that given the plane's guess, and hit the share of guesses that are right."""
    half = e.select(*[F.floor(F.col(c) / (size / 2)).cast("long").alias(c) for c in "xyz"]).distinct()
    octant = sum((F.col(c).bitwiseAND(F.lit(1).cast("long")) * (1 << i) for i, c in enumerate("xyz")), F.lit(0))
    cells = half.groupBy(*[F.shiftright(c, 1).alias(c) for c in "xyz"]).agg(F.min(octant).alias("octant"))
    points = kept(cells.select(F.xxhash64("x", "y", "z").alias("pos"), *[(F.col(c) + 0.5).alias(c) for c in "xyz"], "octant"))
    near = S.near_pairs(points, points, 1.0).filter("pos <> npos").select("pos", *[(F.col(f"n{c}") - F.col(c)).alias(c) for c in "xyz"])
    plane = S.eigen3(near, "pos").filter("n >= 6")
    guess = sum((F.when(F.col(f"n{c}") >= 0, 1 << i).otherwise(0) for i, c in enumerate("xyz")), F.lit(0))
    both = kept(points.join(plane.select("pos", guess.alias("guess")), "pos").select("octant", "guess"))
    h = H.conditional(both, {"p": ("octant", "guess")}).select("joint", "given", "conditional")
    plain = H.order0(both, {"o": "octant"}).select("h")
    n = points.agg(F.count("*").alias("cells"))
    hits = both.agg(F.count("*").alias("m"), F.avg((F.col("octant") == F.col("guess")).cast("double")).alias("hit"))
    out = n.join(hits).join(h, how="left", on=F.lit(True)).join(plain, how="left", on=F.lit(True))  # single rows
    return out.select("cells", F.round(F.try_divide(F.col("m"), F.col("cells")), 6).alias("coverage"), "h", F.col("conditional").alias("h_given"), F.round("hit", 6).alias("hit"))


@query()
def octant_predictability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octant_experiment(_emb(spark, sf_dir), 0.1)


@query()
def hexatic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean bond-orientational order of degree 4 and 6 in the plane of six neighbours."""
    each = S.hexatic(_emb(spark, sf_dir))
    return each.agg(F.count("*").alias("n"), *[F.round(F.avg(f"psi{m}"), 6).alias(f"psi{m}") for m in (4, 6)])


@query()
def plane_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of one survey's points from the other's local planes."""
    a, b = _halves(spark, sf_dir)
    d = kept(S.plane_distances(a, b))
    p95 = O.order_statistic(d, "d", 0.95)
    return d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rms"), F.round(F.lit(p95).cast("double"), 6).alias("p95"), F.round(F.max("d"), 6).alias("worst"))


@query()
def planar_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation from the local plane over neighbourhoods that are nearly flat; 0 if fewer than 100 are."""
    n = S.normals(_emb(spark, sf_dir), 8)
    flat = n.filter("flat < 0.02")
    return flat.agg(F.count("*").alias("planar"), F.round(F.when(F.count("*") >= 100, F.sqrt(F.avg("l0"))).otherwise(0.0), 9).alias("sigma"))


def _axis_sql(c: str) -> str:
    return f"""SELECT '{c}' AS axis, count(*) AS levels, min(gap) AS min_gap, max(CASE WHEN i = n // 2 THEN gap END) AS med_gap, round(sum(CASE WHEN gap % mg = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS on_grid FROM (
SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n, min(gap) OVER () AS mg FROM (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT {c} AS v FROM pts_li)) WHERE gap IS NOT NULL)"""


@query(" UNION ALL ".join(_axis_sql(c) for c in "xyz"), ("pts_li",))
def axis_grid_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between distinct values of each axis: smallest, upper median and share on the smallest's grid."""
    out = []
    for c in "xyz":
        v = V.with_position(V.pts_li(spark, sf_dir).select(F.col(c).alias("v")).distinct(), "v")
        gaps = O.with_lags(v, {"p": ("v", 1)}).select((F.col("v") - F.col("p")).alias("gap")).filter("gap is not null").persist()
        least, med = gaps.agg(F.min("gap")).first()[0], O.upper_median(gaps, "gap")
        share = F.round(F.sum(F.when(F.col("gap") % F.lit(least or 1) == 0, 1).otherwise(0)) / F.count("*"), 6)
        out.append(gaps.agg(F.lit(c).alias("axis"), F.count("*").alias("levels"), F.lit(least).cast("long").alias("min_gap"), F.lit(med).cast("long").alias("med_gap"), share.alias("on_grid")))
    return reduce(DataFrame.union, out)


@query()
def acquisition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five signals of how a cloud was taken, clipped to 0..1, and their mean."""
    cv = nn_cv(spark, sf_dir).select((1 - F.col("cv")).alias("v"))
    hexa = hexatic_order(spark, sf_dir).select(F.greatest("psi4", "psi6").alias("v"))
    turn = azimuth(spark, sf_dir)
    gain = _gain(spark, sf_dir)
    flat = planar_noise_floor(spark, sf_dir).select((F.col("planar") / F.lit(max(1, _emb(spark, sf_dir).count()))).alias("v"))
    parts = {"regularity": cv, "hexatic": hexa, "azimuth": turn, "morton": gain, "planarity": flat}
    each = reduce(DataFrame.union, [d.select(F.lit(k).alias("signal"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v").cast("double"))), 6).alias("score")) for k, d in parts.items()])
    return each.union(each.agg(F.lit("mean").alias("signal"), F.round(F.avg("score"), 6).alias("score")))


def azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.plans.column_queries import azimuth_monotonicity

    return azimuth_monotonicity(spark, sf_dir).select((2 * F.abs(F.col("monotone") - 0.5)).alias("v"))


def _gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.plans.column_queries import morton_gain

    return morton_gain(spark, sf_dir).select((F.col("gain") / F.col("storage_bits") * -1).alias("v"))


@query()
def rotation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference cost of the quantised cloud as it stands, along its principal axes and turned by 45 degrees."""
    e = _emb(spark, sf_dir)
    m = e.agg(*[F.covar_pop(a, b) for a in "xyz" for b in "xyz"]).first()
    pca = np.linalg.eigh(np.array(m, float).reshape(3, 3))[1].T
    c = 0.5**0.5
    turns = {"base": np.eye(3), "pca": pca, "turned": np.array([[c, -c, 0], [c, c, 0], [0, 0, 1.0]])}
    out = []
    for name, r in turns.items():
        q = e.select("pos", *[E.quantize(sum((F.col(b) * float(r[i][j]) for j, b in enumerate("xyz")), F.lit(0.0)), 0.001).alias(a) for i, a in enumerate("xyz")])
        d = O.differences(q, ["x", "y", "z"])
        out.append(d.agg(F.lit(name).alias("orientation"), F.sum(O.bits("x_d1") + O.bits("y_d1") + O.bits("z_d1")).alias("bits")))
    return reduce(DataFrame.union, out)


@query("SELECT b AS bit, round(avg((CASE WHEN v < 0 THEN v + 4294967296 ELSE v END >> b) & 1), 6) AS ones FROM (SELECT CAST(vec_id * 2654435761 % 4294967296 AS BIGINT) AS v FROM embeddings), (SELECT CAST(unnest(range(32)) AS INTEGER) AS b) GROUP BY b")
def integer_bit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("vec_id") * 2654435761) % 4294967296
    e = V.read(spark, sf_dir, "embeddings").select(v.alias("v"))
    bits = F.array(*[F.struct(F.lit(b).alias("bit"), F.shiftright("v", b).bitwiseAND(F.lit(1).cast("long")).alias("one")) for b in range(32)])
    return e.select(F.explode(bits).alias("s")).groupBy(F.col("s.bit").alias("bit")).agg(F.round(F.avg("s.one"), 6).alias("ones"))


@query()
def float_bit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of the 32 bits of the first component: entropy, and entropy given the same bit of the row before."""
    @F.pandas_udf("long")
    def raw(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy(np.float32).view(np.uint32).astype(np.int64))

    e = V.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), raw(F.col("embedding")[0]).alias("v"))
    e = O.with_lags(e, {"p": ("v", 1)})
    bit = lambda c, b: F.shiftright(F.coalesce(c, F.lit(0)), b).bitwiseAND(F.lit(1).cast("long"))
    return H.conditional(e, {f"bit{b:02d}": (bit("v", b), bit("p", b)) for b in range(32)}).select(F.col("col").alias("bit"), F.col("conditional"), "joint")
