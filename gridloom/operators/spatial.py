"""Neighbour joins on a grid of cells, octree occupancy and structure measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import mean_round

AXES = ("x", "y", "z")


def distance2(a: str = "", b: str = "n", axes: tuple[str, ...] = AXES) -> Column:
    terms = [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in axes]
    return sum(terms[1:], terms[0])


def near_pairs(left: DataFrame, right: DataFrame, size: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Pairs (pos, npos, d2 and the coordinates) of left with right within neighbouring cells of edge size: an
    equi-join on cells, where each left row asks the cells around its own."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    l = left.select("pos", *axes, *[at(c).alias(f"c{c}") for c in axes])
    for c in axes:
        l = l.withColumn(f"o{c}", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"o{c}")).drop(f"o{c}")
    r = right.select(F.col("pos").alias("npos"), *[F.col(c).alias(f"n{c}") for c in axes], *[at(c).alias(f"c{c}") for c in axes])
    return l.join(r, [f"c{c}" for c in axes]).drop(*[f"c{c}" for c in axes]).withColumn("d2", distance2(axes=axes))


def knn(left: DataFrame, right: DataFrame, k: int, same: bool = False, axes: tuple[str, ...] = AXES, size: float | None = None) -> DataFrame:
    """(pos, rank, npos, d2): the k nearest rows of right for each row of left, ties to the smaller pos.

    A row is done once its k-th neighbour is no farther than a cell's edge; the rest go on with cells of twice
    the edge, so the result is exact. same: left and right are one table, whose rows don't meet themselves."""
    stats = right.agg(F.count("*"), *[f(c) for c in axes for f in (F.min, F.max)]).first()
    n, spans = stats[0], [stats[2 + 2 * i] - stats[1 + 2 * i] if stats[0] else 0 for i in range(len(axes))]
    have = max(0, n - 1 if same else n)
    k_real = min(k, have)
    if not k_real:
        return left.select("pos", F.lit(0).alias("rank"), F.col("pos").alias("npos"), F.lit(0.0).alias("d2")).limit(0)
    widest = max(max(spans), 1e-12)
    size = size or max(widest / max(1.0, (n / (2.0 * k_real)) ** (1 / len(axes))), widest * 1e-6)
    out, rest = None, left
    for _ in range(40):
        pairs = near_pairs(rest, right, size, axes)
        if same:
            pairs = pairs.filter("pos <> npos")
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy("d2", "npos"))).filter(F.col("rank") <= k_real).select("pos", "rank", "npos", "d2")
        ranked = ranked.withColumn("far", F.max("d2").over(Window.partitionBy("pos"))).withColumn("got", F.count("*").over(Window.partitionBy("pos")))
        whole = size > 2 * widest
        done = ranked if whole else ranked.filter((F.col("got") == k_real) & (F.col("far") <= size * size))
        done = done.drop("far", "got").persist()
        out = done if out is None else out.union(done)
        rest = rest.join(done.select("pos").distinct(), "pos", "left_anti").persist()
        if whole or rest.isEmpty():
            break
        size *= 2
    return out


def occupancy(df: DataFrame, depth: int, low: float = -1.0, side: float = 2.0) -> DataFrame:
    """(level, px, py, pz, byte): for each parent node of each level the bits of its occupied children, bit
    x<<2 | y<<1 | z. Points outside the cube count in its outermost cells."""
    top = 1 << depth
    at = lambda c: F.least(F.greatest(F.floor((F.col(c) - low) / side * top), F.lit(0)), F.lit(top - 1)).cast("long")
    leaves = df.select(*[at(c).alias(c) for c in AXES]).distinct()
    each = leaves.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    node = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    each = each.select("level", *[node(c).alias(c) for c in AXES]).distinct()
    bit = F.expr("shiftleft(1L, cast((x & 1) * 4 + (y & 1) * 2 + (z & 1) as int))")
    return each.groupBy("level", *[F.shiftright(c, 1).alias(f"p{c}") for c in AXES]).agg(F.bit_or(bit).alias("byte"))


def eigen3(df: DataFrame, key: str) -> DataFrame:
    """(key, n, l0, l1, l2, nx, ny, nz): ascending eigenvalues of each group's covariance and the normal.
    The six moments are aggregated by Spark; only the 3 x 3 matrices go to numpy."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    m = df.groupBy(key).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs])

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            c = p[[f"{a}{b}" for a, b in pairs]].to_numpy()
            w, v = np.linalg.eigh(c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)) if len(p) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            yield pd.DataFrame({key: p[key], "n": p["n"], **{f"l{i}": w[:, i] for i in range(3)}, **{f"n{c}": v[:, i, 0] for i, c in enumerate(AXES)}})

    return m.mapInPandas(solve, f"{key} long, n long, l0 double, l1 double, l2 double, nx double, ny double, nz double")


def neighbourhoods(df: DataFrame, k: int) -> DataFrame:
    """Offsets of the k nearest neighbours of each point: (pos, x, y, z) relative to the point."""
    n = knn(df, df, k, same=True)
    there = df.select(F.col("pos").alias("npos"), *[F.col(c).alias(f"n{c}") for c in AXES])
    return n.join(there, "npos").join(df.select("pos", *AXES), "pos").select("pos", "rank", *[(F.col(f"n{c}") - F.col(c)).alias(c) for c in AXES])


def normals(df: DataFrame, k: int = 12, up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """(pos, nx, ny, nz, flat): smallest eigenvector of the neighbourhood, turned towards up, and the
    smallest eigenvalue's share."""
    e = eigen3(neighbourhoods(df, k), "pos")
    side = sum((F.col(f"n{c}") * F.lit(u) for c, u in zip(AXES, up, strict=True)), F.lit(0.0))
    total = F.col("l0") + F.col("l1") + F.col("l2")
    return e.select("pos", *[F.when(side < 0, -F.col(f"n{c}")).otherwise(F.col(f"n{c}")).alias(f"n{c}") for c in AXES], F.when(total > 0, F.greatest(F.col("l0"), F.lit(0.0)) / total).otherwise(0.0).alias("flat"), F.greatest(F.col("l0"), F.lit(0.0)).alias("l0"))


def earlier(df: DataFrame, k: int) -> DataFrame:
    """(pos, r, npos): of the k nearest points those that come earlier in storage order, numbered from the nearest."""
    near = knn(df, df, k, same=True).filter("npos < pos")
    return near.select("pos", F.row_number().over(Window.partitionBy("pos").orderBy("rank")).alias("r"), "npos")


def left_over(values: DataFrame, near: DataFrame, cols: list[str], p: int) -> DataFrame:
    """values (pos, cols) with c_s, what the rounded mean over the first p of near leaves of a column, and c_near, whether there
    was any; where not, the row of the position before decides, or 0."""
    there = values.select(F.col("pos").alias("npos"), *[F.col(c).alias(f"n_{c}") for c in cols])
    means = near.filter(F.col("r") <= p).join(there, "npos").groupBy("pos").agg(*[mean_round(F.sum(f"n_{c}"), F.count("*")).alias(f"m_{c}") for c in cols])
    before = values.select((F.col("pos") + 1).alias("pos"), *[F.col(c).alias(f"b_{c}") for c in cols])
    out = values.join(means, "pos", "left").join(before, "pos", "left")
    new = {f"{c}_s": F.col(c) - F.coalesce(f"m_{c}", f"b_{c}", F.lit(0)) for c in cols} | {f"{c}_near": F.col(f"m_{c}").isNotNull() for c in cols}
    return out.withColumns(new).drop(*[f"{x}_{c}" for c in cols for x in "mb"])


def _legendre(degree: int, t: Column) -> Column:
    """Legendre polynomial by its recurrence."""
    a, b = F.lit(1.0), t
    for n in range(1, degree):
        a, b = b, ((2 * n + 1) * t * b - n * a) / (n + 1)
    return b if degree else a


def bond_order(df: DataFrame, k: int, degrees: tuple[int, ...]) -> DataFrame:
    """(pos, q<l>): bond order of each point's k neighbours. The sum over spherical harmonics of degree l is, by their
    addition theorem, the mean of the Legendre polynomial of the cosines between all pairs of bonds. Neighbours at
    the point's own place have no direction and are left out."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    bonds = neighbourhoods(df, k).withColumn("r", r).filter("r > 0")
    bonds = bonds.groupBy("pos").agg(F.collect_list(F.struct(*[(F.col(c) / F.col("r")).alias(c) for c in AXES])).alias("u"))
    dot = lambda p, q: sum((p[c] * q[c] for c in AXES[1:]), p[AXES[0]] * q[AXES[0]])
    pairs = bonds.withColumn("p", F.explode("u")).withColumn("q", F.explode("u"))
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("p"), F.col("q"))))
    return pairs.select("pos", t.alias("t")).groupBy("pos").agg(*[F.sqrt(F.greatest(F.lit(0.0), F.avg(_legendre(l, F.col("t"))))).alias(f"q{l}") for l in degrees])


def hexatic(df: DataFrame, k: int = 6, orders: tuple[int, ...] = (4, 6)) -> DataFrame:
    """(pos, psi<m>): bond-orientational order in the plane of each point's k neighbours, whose normal is that of their
    covariance; the angles are taken against any two directions of the plane."""
    near = neighbourhoods(df, k)
    n = eigen3(near, "pos").select("pos", "nx", "ny", "nz")
    b = near.select("pos", *AXES).join(n, "pos")
    flat = F.abs("nx") < 0.9  # a direction that isn't the normal's: x, or y where the normal is near x
    ux, uy, uz = F.when(flat, 0.0).otherwise(-F.col("nz")), F.when(flat, F.col("nz")).otherwise(0.0), F.when(flat, -F.col("ny")).otherwise(F.col("nx"))
    b = b.withColumns({"ux": ux, "uy": uy, "uz": uz})
    size = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    b = b.withColumns({f"u{c}": F.col(f"u{c}") / size for c in AXES})
    cross = {"vx": F.col("ny") * F.col("uz") - F.col("nz") * F.col("uy"), "vy": F.col("nz") * F.col("ux") - F.col("nx") * F.col("uz"), "vz": F.col("nx") * F.col("uy") - F.col("ny") * F.col("ux")}
    b = b.withColumns(cross)
    along = lambda a: sum((F.col(f"{a}{c}") * F.col(c) for c in AXES[1:]), F.col(f"{a}x") * F.col("x"))
    b = b.select("pos", F.atan2(along("v"), along("u")).alias("t"))
    mean = lambda m: F.sqrt(F.pow(F.avg(F.cos(m * F.col("t"))), F.lit(2.0)) + F.pow(F.avg(F.sin(m * F.col("t"))), F.lit(2.0)))
    return b.groupBy("pos").agg(*[mean(m).alias(f"psi{m}") for m in orders])


def plane_distances(left: DataFrame, right: DataFrame, k: int = 12) -> DataFrame:
    """(pos, d): distance of each point of right from the plane through the k points of left nearest to it."""
    near = knn(right, left, k)
    there = left.select(F.col("pos").alias("npos"), *AXES)
    b = near.join(there, "npos").select("pos", *AXES)
    centre = b.groupBy("pos").agg(*[F.avg(c).alias(f"m{c}") for c in AXES])
    both = eigen3(b, "pos").join(centre, "pos").join(right.select("pos", *AXES), "pos")
    d = sum((F.col(f"n{c}") * (F.col(c) - F.col(f"m{c}")) for c in AXES[1:]), F.col("nx") * (F.col("x") - F.col("mx")))
    return both.select("pos", F.abs(d).alias("d"))
