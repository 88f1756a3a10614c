"""Scan lines: splitting a sweep into two lines, fitting a line, and stateful column codings of one block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Direction of the largest spread and the deviation across it."""
    c = np.cov(x, y, bias=True) if len(x) > 1 else np.zeros((2, 2))
    w, v = np.linalg.eigh(c)
    return float(np.arctan2(v[1, 1], v[0, 1])), float(np.sqrt(max(w[0], 0.0)))


def thinness(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, spread, thinness): deviation along and across the principal axis of each group's points, from the closed
    form of the eigenvalues of their covariance."""
    m = df.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"))
    mid, half = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"))
    return m.select(*by, "n", F.sqrt(mid + half).alias("spread"), F.sqrt(F.greatest(mid - half, F.lit(0.0))).alias("thinness"))


def split_lines(x: np.ndarray, y: np.ndarray, rounds: int = 12, least: int = 10) -> np.ndarray:
    """0 or 1 for each point: an EM split into two straight lines that starts from alternate points and stops
    once nothing moves, after `rounds` rounds or when a side would have fewer than `least` points."""
    label = np.arange(len(x)) % 2
    for _ in range(rounds):
        d = []
        for k in (0, 1):
            own = label == k
            a, _ = principal(x[own], y[own])
            d.append(np.abs(-(x - x[own].mean()) * np.sin(a) + (y - y[own].mean()) * np.cos(a)))
        new = (d[1] < d[0]).astype(int)
        if (new == label).all() or min(new.sum(), len(new) - new.sum()) < least:
            break
        label = new
    return label


def fit_line(t: np.ndarray, v: np.ndarray, z: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Levenberg-Marquardt fit of v = s + (h - z) tan(a + w t): the parameters s, h, a, w."""
    t0, z0 = t.mean(), z.mean()
    span = max(float(np.ptp(z)), float(np.ptp(v)), 1.0)
    p = np.array([v.mean(), z0 + span, 0.0, (np.ptp(v) / span) / max(float(np.ptp(t)), 1.0) * (1 if np.corrcoef(t, v)[0, 1] >= 0 else -1) if np.ptp(t) > 0 and np.ptp(v) > 0 else 0.0])

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.clip(p[2] + p[3] * (t - t0), -1.5, 1.5)
        tan, sec = np.tan(a), 1 / np.cos(a) ** 2
        return p[0] + (p[1] - z) * tan, np.stack([np.ones_like(t), tan, (p[1] - z) * sec, (p[1] - z) * sec * (t - t0)], 1)

    f, j = model(p)
    cost, damp = float(((v - f) ** 2).sum()), 1e-3
    for _ in range(rounds):
        h = j.T @ j
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (v - f), rcond=None)[0]
        g, k = model(p + step)
        new = float(((v - g) ** 2).sum())
        if new < cost:
            done = cost - new < 1e-9 * cost
            p, f, j, cost, damp = p + step, g, k, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return p


def bits(r: np.ndarray) -> int:
    """Summed bit lengths of zigzag residuals."""
    z = np.where(r >= 0, 2 * r, -2 * r - 1).astype(np.float64)
    return int(np.where(z > 0, np.floor(np.log2(np.maximum(z, 1))) + 1, 0).sum())


def sweep_fits(df: DataFrame, by: list[str], time: str, value: str, height: str) -> DataFrame:
    """One row for each sweep: n, whether it splits into two lines, and the bits of value's residuals by differences and by
    the fitted line with its rounded parameters; the fit is accepted only if it is cheaper."""

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([time, "pos"])
        t, v, z = (p[c].to_numpy(float) for c in (time, value, height))
        plain = bits(np.diff(p[value].to_numpy(np.int64), prepend=np.int64(0)))
        line = plain
        if len(p) >= 8:
            q = fit_line(t, v, z)
            a = np.clip(q[2] + q[3] * (t - t.mean()), -1.5, 1.5)
            line = bits(np.round(v - (q[0] + (q[1] - z) * np.tan(a))).astype(np.int64)) + 4 * 32
        two = False
        if len(p) >= 40:
            label = split_lines(t - t.mean(), v)
            whole = principal(t, v)[1]
            parts = [principal(t[label == k], v[label == k])[1] for k in (0, 1) if (label == k).any()]
            two = len(parts) == 2 and len(p) * np.log2(max(whole, 1e-9)) > sum((label == k).sum() * np.log2(max(parts[k], 1e-9)) for k in (0, 1)) + len(p)
        return pd.DataFrame([(*key, len(p), two, plain, line, line < plain)], columns=[*by, "n", "two_lines", "delta_bits", "line_bits", "fitted"])

    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by) + ", n long, two_lines boolean, delta_bits long, line_bits long, fitted boolean"
    return df.groupBy(*by).applyInPandas(one, schema)


def difference_cache(v: np.ndarray, size: int = 1024) -> np.ndarray:
    """For each difference its place in a move-to-front list of the last `size` distinct ones, or -1."""
    recent: list[int] = []
    out = []
    for d in np.diff(v, prepend=v[:1] * 0).tolist():
        if d in recent:
            k = recent.index(d)
            recent.pop(k)
            out.append(k)
        else:
            out.append(-1)
        recent.insert(0, d)
        del recent[size:]
    return np.array(out, np.int64)


def cache_profile(df: DataFrame, col: str, block: int = 8192, size: int = 1024) -> DataFrame:
    """(block, n, hits, mean_place): how well the cache of differences predicts each block."""

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        k = difference_cache(p.sort_values("pos")[col].to_numpy(np.int64), size)
        hit = k[k >= 0]
        return pd.DataFrame([(key[0], len(k), len(hit), float(hit.mean()) if len(hit) else 0.0)], columns=["block", "n", "hits", "mean_place"])

    return df.select("pos", col, F.floor(F.col("pos") / block).alias("block")).groupBy("block").applyInPandas(one, "block long, n long, hits long, mean_place double")


def surface_predictions(df: DataFrame, shift: int = 6, block: int = 8192) -> DataFrame:
    """(block, n, bits, delta_bits): z from the latest points of the 3 x 3 cells around, against differences of z."""

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        seen: dict[tuple[int, int], int] = {}
        r, last = [], 0
        for x, y, z in zip((p["x"].to_numpy() >> shift).tolist(), (p["y"].to_numpy() >> shift).tolist(), p["z"].tolist(), strict=True):
            near = [seen[k] for k in ((x + a, y + b) for a in (0, -1, 1) for b in (0, -1, 1)) if k in seen]
            guess = min(near, key=lambda v: abs(v - last)) if near else last
            r.append(z - guess)
            seen[x, y] = last = z
        return pd.DataFrame([(key[0], len(p), bits(np.array(r)), bits(np.diff(p["z"].to_numpy(), prepend=0)))], columns=["block", "n", "bits", "delta_bits"])

    return df.select("pos", "x", "y", "z", F.floor(F.col("pos") / block).alias("block")).groupBy("block").applyInPandas(one, "block long, n long, bits long, delta_bits long")
