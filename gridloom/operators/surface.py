"""Lossy geometry under an error budget, signed distance fields, feature size and surface leaves."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import polar, quantize, unpolar
from gridloom.operators.entropy import order0
from gridloom.operators.ordered import differences
from gridloom.operators.spatial import AXES, eigen3, knn, near_pairs, normals


def _error(back: list[Column]) -> Column:
    return F.sqrt(sum(((F.col(c) - b) * (F.col(c) - b) for c, b in zip(AXES, back, strict=True)), F.lit(0.0)))


def _grid(step: float) -> tuple[list[Column], list[Column]]:
    q = [quantize(F.col(c), step) for c in AXES]
    return q, [k * step for k in q]


def _polar(step: float, center: tuple[float, float, float], reach: float) -> tuple[list[Column], list[Column]]:
    """Range by step; angles by the step over the largest range, so that arcs stay below it."""
    angle = step / max(reach, 1e-12)
    r, a, e = polar(*[F.col(c) - o for c, o in zip(AXES, center, strict=True)])
    q = [quantize(r, step), quantize(a, angle), quantize(e, angle)]
    return q, [b + o for b, o in zip(unpolar(q[0] * step, q[1] * angle, q[2] * angle), center, strict=True)]


def geometry_candidates(df: DataFrame, eps: float, rounds: int = 14) -> list[dict]:
    """Grid and polar representations whose step uses up the error budget: doubled while the largest error
    over all rows stays within it, then bisected geometrically. Rows with NaN or infinite coordinates are refused."""
    finite = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in AXES]
    bad, n, *s = df.agg(F.sum((finite[0] | finite[1] | finite[2]).cast("int")), F.count("*"), *[f(c) for c in AXES for f in (F.min, F.max, F.avg)]).first()
    if bad:
        raise ValueError("coordinates must be finite")
    if not n:
        return []
    low, high, mean = s[0::3], s[1::3], s[2::3]
    extent = max(b - a for a, b in zip(low, high, strict=True))
    away = math.sqrt(sum(max(abs(a), abs(b)) ** 2 for a, b in zip(low, high, strict=True)))
    kinds: dict[str, Callable[[float], tuple]] = {"grid": _grid}
    if away <= 10 * max(extent, 1e-12):
        kinds["polar-origin"] = lambda t: _polar(t, (0.0, 0.0, 0.0), away)
    kinds["polar-centroid"] = lambda t: _polar(t, tuple(mean), math.sqrt(3) * extent)
    out = []
    for name, make in kinds.items():
        worst = lambda t, make=make: df.agg(F.max(_error(make(t)[1]))).first()[0]
        good = eps / 4
        if worst(good) > eps:
            continue
        for _ in range(8):
            if worst(2 * good) > eps:
                break
            good *= 2
        bad_ = 2 * good
        for _ in range(rounds):
            mid = math.sqrt(good * bad_)
            good, bad_ = (mid, bad_) if worst(mid) <= eps else (good, mid)
        coded = differences(df.select("pos", *[k.alias(f"k{i}") for i, k in enumerate(make(good)[0])]), ["k0", "k1", "k2"])
        bits = order0(coded, {f"k{i}": f"k{i}_d1" for i in range(3)}).agg(F.sum("h")).first()[0]
        out.append({"kind": name, "step": good, "max_err": worst(good), "bits": bits})
    return out


def choose_geometry(candidates: list[dict], eps: float) -> dict | None:
    """The cheapest candidate within the budget (with a fiftieth of tolerance)."""
    fit = [c for c in candidates if c["max_err"] <= 1.02 * eps]
    return min(fit, key=lambda c: (c["bits"], c["kind"]), default=None)


def signed_distance(df: DataFrame, voxel: float, k: int = 12, band: int = 3) -> DataFrame:
    """(ix, iy, iz, sdf) of voxels within `band` voxels of a point: signed distance to the local planes of
    the k nearest points, weighted by a Gaussian of the voxel size."""
    flat = normals(df, k).select("pos", *[f"n{c}" for c in AXES])
    pts = df.join(flat.select("pos", *[F.col(f"n{c}").alias(f"m{c}") for c in AXES]), "pos")
    offs = F.array(*[F.lit(o) for o in range(-band, band + 1)])
    v = df.select(*[F.floor(F.col(c) / voxel).cast("long").alias(f"i{c}") for c in AXES]).distinct()
    for c in AXES:
        v = v.withColumn("o", F.explode(offs)).withColumn(f"i{c}", F.col(f"i{c}") + F.col("o")).drop("o")
    v = v.distinct().withColumns({c: (F.col(f"i{c}") + 0.5) * voxel for c in AXES}).withColumn("pos", F.xxhash64("ix", "iy", "iz"))
    pairs = near_pairs(v, pts.select("pos", *AXES), band * voxel).filter(F.col("d2") <= (band * voxel) ** 2)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy("d2", "npos"))).filter(F.col("rank") <= k)
    side = pairs.join(pts.select(F.col("pos").alias("npos"), *[f"m{c}" for c in AXES]), "npos")
    w = F.exp(-F.col("d2") / (2 * voxel * voxel))
    along = sum(((F.col(c) - F.col(f"n{c}")) * F.col(f"m{c}") for c in AXES), F.lit(0.0))
    sdf = side.groupBy("pos").agg((F.sum(w * along) / F.sum(w)).alias("sdf"))
    return v.join(sdf, "pos").select("ix", "iy", "iz", "sdf")


def zero_crossings(sdf: DataFrame, voxel: float) -> DataFrame:
    """(x, y, z) where the field changes sign between neighbouring voxels, by linear interpolation."""
    out = None
    for axis in AXES:
        there = sdf.select(*[(F.col(f"i{c}") - (1 if c == axis else 0)).alias(f"i{c}") for c in AXES], F.col("sdf").alias("s2"))
        hit = sdf.join(there, [f"i{c}" for c in AXES]).filter("(sdf < 0) <> (s2 < 0)")
        t = F.col("sdf") / (F.col("sdf") - F.col("s2"))
        part = hit.select(*[((F.col(f"i{c}") + 0.5 + (t if c == axis else 0)) * voxel).alias(c) for c in AXES])
        out = part if out is None else out.union(part)
    return out


def thinned(df: DataFrame, most: int) -> DataFrame:
    """x, y, z of df, or, if it has more than `most` rows, the centres of gravity of its voxels, whose edge doubles until at
    most that many are left; a point then stands for all within one voxel's diagonal."""
    p = df.select(*AXES)
    n, *ends = p.agg(F.count("*"), *[f(c) for c in AXES for f in (F.min, F.max)]).first()
    if n <= most:
        return p
    edge = max(max(ends[2 * k + 1] - ends[2 * k] for k in range(3)), 1e-12) / most**0.5
    while True:
        cells = p.groupBy(*[F.floor(F.col(c) / edge).alias(f"i{c}") for c in AXES]).agg(*[F.avg(c).alias(c) for c in AXES]).select(*AXES)
        if cells.count() <= most:
            return cells
        edge *= 2


def local_feature_size(df: DataFrame, surface: DataFrame, most_rows: int = 20_000, separation: float = 32.0) -> DataFrame:
    """(pos, lfs): df has pos, x, y, z and normals nx, ny, nz. A ball that touches a point along its normal m is free of a
    surface point at v from it if its radius is at most |v|^2 / (2 v.m); lfs is the least of these radii on either side, over
    surface points that the ball's centre sees at `separation` degrees or more from the point (closer ones are noise
    of the surface). Without any it is the surface's extent. The surface is broadcast, thinned() to most_rows at most."""
    rows = thinned(surface, most_rows).toPandas().to_numpy(float)
    shared = df.sparkSession.sparkContext.broadcast(rows)
    least = math.sin(math.radians(separation) / 2)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        span = float(np.ptp(s, axis=0).max()) if len(s) else 0.0
        for p in it:
            x, n = p[list(AXES)].to_numpy(float), p[[f"n{c}" for c in AXES]].to_numpy(float)
            best = np.full(len(x), span)
            for at in range(0, len(x) if len(s) else 0, 64):
                a, m = x[at : at + 64], n[at : at + 64]
                d2 = ((s[None] - a[:, None]) ** 2).sum(2)
                along = np.abs(m @ s.T - (a * m).sum(1)[:, None])  # either side
                seen = (d2 > 1e-18) & (along >= least * np.sqrt(d2))
                r = np.where(seen, d2 / np.where(seen, 2 * along, 1), span)
                best[at : at + 64] = np.minimum(r.min(1), span)
            yield pd.DataFrame({"pos": p["pos"], "lfs": best})

    return df.select("pos", *AXES, *[f"n{c}" for c in AXES]).mapInPandas(run, "pos long, lfs double")


def smoothed(df: DataFrame, radius: float) -> DataFrame:
    """Points moved onto the plane of their neighbours within radius."""
    pairs = near_pairs(df, df, radius).filter(F.col("d2") <= radius * radius)
    mean = pairs.groupBy("pos").agg(*[F.avg(f"n{c}").alias(f"g{c}") for c in AXES], F.count("*").alias("k"))
    plane = eigen3(pairs.select("pos", *[F.col(f"n{c}").alias(c) for c in AXES]), "pos").select("pos", *[f"n{c}" for c in AXES])
    both = df.join(mean, "pos").join(plane, "pos")
    t = sum(((F.col(c) - F.col(f"g{c}")) * F.col(f"n{c}") for c in AXES), F.lit(0.0))
    return both.select("pos", *[F.when(F.col("k") >= 3, F.col(c) - t * F.col(f"n{c}")).otherwise(F.col(c)).alias(c) for c in AXES], *[f"n{c}" for c in AXES])


def adaptive_leaves(df: DataFrame, eps: float, most: int = 64, depth: int = 8, low: float = -1.0, side: float = 2.0) -> DataFrame:
    """(level, ix, iy, iz, n, rms): octree cells that are flat within eps or hold few points; others split, level by level."""
    out, rest = None, df
    for level in range(1, depth + 1):
        size = side / (1 << level)
        at = rest.withColumns({f"i{c}": F.floor((F.col(c) - low) / size).cast("long") for c in AXES}).withColumn("leaf", F.xxhash64("ix", "iy", "iz"))
        shape = eigen3(at, "leaf").select("leaf", "n", F.sqrt(F.greatest("l0", F.lit(0.0))).alias("rms"))
        cells = at.select("leaf", "ix", "iy", "iz").distinct().join(shape, "leaf")
        done = (F.col("rms") <= eps) | (F.col("n") <= most // 16) if level < depth else F.lit(True)
        part = cells.filter(done).select(F.lit(level).alias("level"), "ix", "iy", "iz", "n", "rms")
        out = part if out is None else out.union(part)
        if level == depth:
            break
        rest = at.join(cells.filter(~done).select("leaf"), "leaf", "left_semi").select(df.columns).persist()
        if rest.isEmpty():
            break
    return out


def noise_budget(df: DataFrame, k: int = 12) -> float:
    """Standard deviation from the local plane over nearly flat neighbourhoods; 0 if fewer than 100 are."""
    n, s = normals(df, k).filter("flat < 0.02").agg(F.count("*"), F.sqrt(F.avg("l0"))).first()
    return float(s) if n >= 100 else 0.0


def spacing(df: DataFrame) -> DataFrame:
    return knn(df, df, 1, same=True).select(F.sqrt("d2").alias("d"))


def tightened(df: DataFrame, cols: list[str], eps: float, kind: str = "float", rounds: int = 6) -> tuple[float, float, int]:
    """(step, worst, turns): the grid step, from the widest that eps allows, at which values come back within eps after they are
    rounded to the output's type; each turn takes off what the last one missed by, `rounds` turns at most. Values that the
    type itself can't hold within eps are an error."""
    step, worst = 2 * eps / len(cols) ** 0.5, 0.0
    for turn in range(rounds + 1):
        err = sum((F.pow((F.round(F.col(c) / step) * step).cast(kind).cast("double") - F.col(c), F.lit(2.0)) for c in cols[1:]), F.pow((F.round(F.col(cols[0]) / step) * step).cast(kind).cast("double") - F.col(cols[0]), F.lit(2.0)))
        worst = float(df.agg(F.coalesce(F.max(F.sqrt(err)), F.lit(0.0))).first()[0])
        if worst <= eps:
            return step, worst, turn
        step *= max(0.1, 0.999 * (2 - worst / eps))
    raise ValueError(f"the output type can't keep an error of {eps}")
