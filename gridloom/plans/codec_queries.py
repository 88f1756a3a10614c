"""Queries on geometry and attribute codecs, world coordinates, grids and structure reports."""

from __future__ import annotations

import lzma
import math
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.operators import codecs as C
from gridloom.operators import entropy as H
from gridloom.operators import ordered as O
from gridloom.operators import scan
from gridloom.operators import spatial as S
from gridloom.plans.column_queries import GEO, blen, cond_sql, h_sql, lag, long_sql, med3, modes_sql, spread_sql, zz
from gridloom.plans.dependency_queries import column_gcds
from gridloom.plans.registry import query
from gridloom.plans.spatial_queries import knn_sql, occ_sql, octant_experiment
from gridloom.sources import views as V
from gridloom.sources.store import kept


def _u(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


R_STEP, ANGLE_STEP, SCALE, OFFSET = 0.002, 0.0001, 0.01, 100.0
_WORLD = ("int", "float", "polar")


@query(f"""p AS (SELECT *, round(sqrt(x*x + y*y + z*z) / {R_STEP}) * {R_STEP} AS r, round(atan2(y, x) / {ANGLE_STEP}) * {ANGLE_STEP} AS a, round(CASE WHEN x*x + y*y + z*z > 0 THEN asin(greatest(-1, least(1, z / sqrt(x*x + y*y + z*z)))) ELSE 0 END / {ANGLE_STEP}) * {ANGLE_STEP} AS e FROM pts_emb),
w AS (SELECT 'int' AS repr, x * {SCALE} + {OFFSET} AS x, y * {SCALE} + {OFFSET} AS y, z * {SCALE} + {OFFSET} AS z FROM pts_li UNION ALL SELECT 'float', x, y, z FROM pts_emb UNION ALL SELECT 'polar', r * cos(e) * cos(a), r * cos(e) * sin(a), r * sin(e) FROM p)
SELECT repr, count(*) AS n, {', '.join(f'round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}, round(avg({c}), 6) AS mean_{c}' for c in 'xyz')} FROM w GROUP BY repr""", ("pts_li", "pts_emb"))
def world_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of integer, float and polar representations brought back to the world."""
    e = V.pts_emb(spark, sf_dir)
    r, a, el = E.polar(F.col("x"), F.col("y"), F.col("z"))
    polar = e.select(F.round(r / R_STEP).alias("x"), F.round(a / ANGLE_STEP).alias("y"), F.round(el / ANGLE_STEP).alias("z"))
    tables = dict(zip(_WORLD, (V.pts_li(spark, sf_dir), e, polar), strict=True))
    parts = []
    for kind, df in tables.items():
        w = E.world(kind, *[F.col(c) for c in "xyz"], scale=(SCALE,) * 3, offset=(OFFSET,) * 3, r_step=R_STEP, angle_step=ANGLE_STEP)
        p = df.select(*[v.alias(c) for v, c in zip(w, "xyz", strict=True)])
        parts.append(p.agg(F.lit(kind).alias("repr"), F.count("*").alias("n"), *[f for c in "xyz" for f in (F.round(F.min(c), 6).alias(f"min_{c}"), F.round(F.max(c), 6).alias(f"max_{c}"), F.round(F.avg(c), 6).alias(f"mean_{c}"))]))
    return reduce(DataFrame.union, parts)


@query(f"d AS (SELECT {zz(f'x - {lag("x")}')} AS z FROM pts_li), l AS ({_u([f'SELECT {b} AS plane, (z >> {8 * b}) & 255 AS v FROM d' for b in range(8)])}), h AS ({h_sql('l', 'plane')}) SELECT CAST(plane AS INTEGER) AS plane, n, h FROM h", ("pts_li",))
def byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each byte of a column's zigzag differences."""
    z = O.differences(V.pts_li(spark, sf_dir).select("pos", "x"), ["x"]).select(E.zigzag(F.col("x_d1")).alias("z"))
    h = H.order0(z, {str(b): E.byte_plane(F.col("z"), b) for b in range(8)})
    return h.select(F.col("col").cast("int").alias("plane"), "n", "h")


TOP = (1 << 21) - 1


def _cells_sql(kind: str) -> str:
    span = {c: f"h{c} - l{c}" if kind == "axis" else "greatest(hx - lx, hy - ly, hz - lz)" for c in GEO}
    q = [f"CAST(floor(({c} - l{c}) * CAST({TOP} AS DOUBLE) / greatest({span[c]}, 1)) AS BIGINT) AS q{c}" for c in GEO]
    code = " + ".join(spread_sql(f"q{c}", 21, s) for c, s in zip(GEO, (2, 1, 0), strict=True))
    cost = " + ".join(blen(zz(f"{c} - coalesce(lag({c}) OVER (ORDER BY code, pos), 0)")) for c in GEO)
    return f"SELECT '{kind}' AS kind, count(*) AS n, count(DISTINCT code) AS codes, CAST(sum(code % 1000003) AS BIGINT) AS total, CAST(sum(bits) AS BIGINT) AS bits FROM (SELECT code, {cost} AS bits FROM (SELECT pos, x, y, z, {code} AS code FROM (SELECT *, {', '.join(q)} FROM pts_li, b)))"


@query(f"b AS (SELECT {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in GEO)} FROM pts_li) {_u([_cells_sql(k) for k in ('axis', 'cube')])}", ("pts_li",))
def morton_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morton order on 2**21 cells of each axis' own range, and of a cube around all of them; x in the highest bit."""
    li = kept(V.pts_li(spark, sf_dir).select("pos", *GEO))
    ends = li.agg(*[f(c) for c in GEO for f in (F.min, F.max)]).first()
    low = dict(zip(GEO, ends[::2], strict=True))
    spans = {c: max(ends[2 * k + 1] - ends[2 * k], 1) if ends[0] is not None else 1 for k, c in enumerate(GEO)}
    codes = {}
    for kind in ("axis", "cube"):
        q = [F.floor((F.col(c) - F.lit(low[c])) * F.lit(float(TOP)) / F.lit(spans[c] if kind == "axis" else max(spans.values()))).cast("long") for c in GEO]
        codes[kind] = E.morton(*q, bits=21, x_low=False)
    both = kept(li.withColumns(codes))  # numbering reads its rows four times
    parts = []
    for kind in codes:
        coded = V.with_position(both.select("pos", *GEO, F.col(kind).alias("code")), "code", "pos", name="rank")
        d = O.with_lags(coded, {"before": ("code", 1)} | {f"_{c}": (c, 1) for c in GEO}, order="rank")
        cost = reduce(lambda a, b: a + b, [O.bits(E.wsub(F.col(c), F.col(f"_{c}"))) for c in GEO])
        new = F.col("code").isNotNull() & ~F.col("code").eqNullSafe(F.col("before"))  # rows are in the order of codes
        d = d.withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(0)) for c in GEO})
        parts.append(d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_if(new).alias("codes"), F.sum(F.col("code") % 1000003).alias("total"), F.sum(cost).alias("bits")))
    return reduce(DataFrame.union, parts)


def _class_sql(name: str, e: str) -> str:
    return f"""SELECT '{name}' AS col, class, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT v, CAST(CASE WHEN levels <= 64 THEN CASE WHEN top <= 3 THEN top ELSE 0 END ELSE (CASE WHEN v > q1 THEN 1 ELSE 0 END) + (CASE WHEN v > q2 THEN 1 ELSE 0 END) + (CASE WHEN v > q3 THEN 1 ELSE 0 END) END AS INTEGER) AS class FROM (
SELECT v, (SELECT count(DISTINCT v) FROM s_{name}) AS levels, t.top, q1, q2, q3 FROM s_{name} JOIN (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS top FROM s_{name} GROUP BY v) t USING (v),
(SELECT max(CASE WHEN i = n // 4 THEN v END) AS q1, max(CASE WHEN i = n // 2 THEN v END) AS q2, max(CASE WHEN i = n * 3 // 4 THEN v END) AS q3 FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM s_{name})))) GROUP BY class"""


_CLASSED = {"z": "z", "x": "x", "dx": f"abs(x - {lag('x')})"}


@query(", ".join(f"s_{n} AS (SELECT {e} AS v FROM pts_li)" for n, e in _CLASSED.items()) + " " + _u([f"SELECT * FROM ({_class_sql(n, e)})" for n, e in _CLASSED.items()]), ("pts_li",))
def value_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four classes of a column, of few values (z), of many (x) and of the size of differences (dx)."""
    d = O.differences(V.pts_li(spark, sf_dir).select("pos", "x", "z"), ["x"]).withColumn("dx", F.abs("x_d1"))
    parts = []
    for n in _CLASSED:
        c = O.value_class(d, n)
        parts.append(d.select(F.col(n).alias("v"), c.alias("class")).groupBy("class").agg(F.lit(n).alias("col"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    return reduce(DataFrame.union, parts).select("col", "class", "n", "lo", "hi")


def _trend_sql(c: str) -> str:
    d = [f"(l{k} - l{k + 1})" for k in range(1, 4)]
    t = f"(CASE WHEN pos >= 4 THEN {med3(*d)} ELSE 0 END)"
    r = [f"({c} - coalesce(l1, 0) - {v})" for v in ("0", t, f"CAST(floor({t} / 2.0) AS BIGINT)")]
    src = f"(SELECT pos, {c}, {', '.join(f'lag({c}, {k}) OVER (ORDER BY pos) AS l{k}' for k in range(1, 5))} FROM pts_li)"
    return _u([f"SELECT '{c}' AS col, '{name}' AS trend, CAST(sum({blen(zz(e))}) AS BIGINT) AS bits FROM {src}" for name, e in zip(E.TRENDS, r, strict=True)])


@query(_u([_trend_sql(c) for c in GEO]), ("pts_li",))
def trend_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference cost with no trend, with the median of the last three differences and with half of it; the trend begins
    once three differences between rows are known."""
    li = O.with_lags(V.pts_li(spark, sf_dir).select("pos", *GEO), {f"{c}l{k}": (c, k) for c in GEO for k in range(1, 5)})
    r = {}
    for c in GEO:
        d = [F.col(f"{c}l{k}") - F.col(f"{c}l{k + 1}") for k in range(1, 4)]
        for name in E.TRENDS:
            r[f"{c}:{name}"] = F.col(c) - F.coalesce(f"{c}l1", F.lit(0)) - E.trend(name, d, F.col("pos"))
    total = li.select(*[e.alias(n) for n, e in r.items()]).agg(*[F.sum(O.bits(F.col(f"`{n}`"))).alias(n) for n in r])
    cells = [F.struct(F.lit(n.split(":")[0]).alias("col"), F.lit(n.split(":")[1]).alias("trend"), F.col(f"`{n}`").alias("bits")) for n in r]
    return total.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


@query("u AS (SELECT x, CAST('0x' || substr(md5(CAST(pos AS VARCHAR) || ':' || '7'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM pts_li) SELECT CAST(floor(u * 10) AS INTEGER) AS bin, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, round(min(u), 9) AS lo, round(max(u), 9) AS hi FROM u GROUP BY 1", ("pts_li",))
def hash_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded numbers in [0, 1) for each row, the same on any cluster; a bin is a random sample without replacement."""
    u = V.pts_li(spark, sf_dir).select("x", E.hash_uniform(F.col("pos"), 7).alias("u"))
    return u.groupBy(F.floor(F.col("u") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.round(F.min("u"), 9).alias("lo"), F.round(F.max("u"), 9).alias("hi"))


_QS = {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0}


@query("SELECT l_returnflag AS grp, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice / l_quantity, {q}), 6) AS {n}" for n, q in _QS.items()) + " FROM lineitem GROUP BY 1")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, quartiles and median of a ratio by group."""
    r = F.col("l_extendedprice") / F.col("l_quantity")
    return V.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.count("*").alias("n"), *[F.round(F.percentile(r, F.lit(q)), 6).alias(n) for n, q in _QS.items()])


def _v3_sql() -> str:
    tables = ", ".join(f"m_{c} AS ({modes_sql(c)})" for c in GEO)
    joined = "g AS (SELECT a.pos, " + ", ".join(f"{t}.r{m} AS {c}{m}" for t, c in zip("abc", GEO, strict=True) for m in range(8)) + " FROM m_x a JOIN m_y b USING (pos) JOIN m_z c USING (pos))"
    lagged = "f AS (SELECT *, " + ", ".join(f"coalesce(lag(x{m}) OVER (ORDER BY pos), 0) AS p{m}" for m in range(8)) + " FROM g)"
    pairs = {}
    for m in range(8):
        size = {c: f"least({blen(zz(f'{c}{m}'))}, 23)" for c in ("x", "y", "p")}
        for s in (0, 1):
            pairs[f"{E.MODES[m]}/{s}:x"] = (zz(f"x{m}"), f"{size['p']} >> {s}")
            pairs[f"{E.MODES[m]}/{s}:y"] = (zz(f"y{m}"), f"{size['x']} >> {s}")
            pairs[f"{E.MODES[m]}/{s}:z"] = (zz(f"z{m}"), f"({size['x']} >> {s}) * 32 + ({size['y']} >> {s})")
    cells = cond_sql("f", pairs)
    return f"{tables}, {joined}, {lagged}, c AS (WITH {cells}) SELECT split_part(col, '/', 1) AS mode, CAST(split_part(split_part(col, '/', 2), ':', 1) AS INTEGER) AS shift, round(sum(conditional), 5) AS bits FROM c GROUP BY 1, 2"


@query(_v3_sql(), ("pts_li",))
def geometry_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a row of three coordinates under each predictor, where the size of one axis' residual is the context of the next
    axis (and the last row's first residual that of the first); sizes whole or halved."""
    r = O.all_residuals(V.pts_li(spark, sf_dir).select("pos", *GEO), GEO)
    r = O.with_lags(r, {f"p{m}": (f"x_r{m}", 1) for m in range(8)})
    size = lambda c, s: F.shiftright(E.bucket(E.zigzag(c)), s)
    pairs = {}
    for m in range(8):
        last = F.coalesce(f"p{m}", F.lit(0)).cast("long")
        for s in (0, 1):
            x, y = size(F.col(f"x_r{m}"), s), size(F.col(f"y_r{m}"), s)
            for c, ctx in (("x", size(last, s)), ("y", x), ("z", x * 32 + y)):
                pairs[f"{E.MODES[m]}/{s}:{c}"] = (E.zigzag(F.col(f"{c}_r{m}")), ctx)
    h = H.conditional(r, pairs)
    mode, shift = F.substring_index("col", "/", 1), F.substring_index(F.substring_index("col", "/", -1), ":", 1).cast("int")
    return h.groupBy(mode.alias("mode"), shift.alias("shift")).agg(F.round(F.sum("conditional"), 5).alias("bits"))


_WINDOWS = (4, 16)


def _v4_sql(w: int) -> str:
    b = f"""SELECT a.pos, min((abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z), a.pos - b.pos)) AS m FROM pts_li a JOIN pts_li b ON b.pos < a.pos AND b.pos >= a.pos - {w} GROUP BY a.pos"""
    r = f"SELECT CAST(struct_extract(m, 2) AS BIGINT) AS back, " + ", ".join(f"a.{c} - b.{c} AS {c}" for c in GEO) + f" FROM ({b}) n JOIN pts_li a ON a.pos = n.pos JOIN pts_li b ON b.pos = a.pos - CAST(struct_extract(m, 2) AS BIGINT)"
    return f"r{w} AS ({r}), l{w} AS ({long_sql({'back': 'back', **{c: c for c in GEO}}, f'r{w}')}), h{w} AS ({h_sql(f'l{w}')})"


@query(", ".join(_v4_sql(w) for w in _WINDOWS) + " " + _u([f"SELECT {w} AS rows_back, col, n, h FROM h{w}" for w in _WINDOWS]), ("pts_li",))
def geometry_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of naming the nearest of the last rows and of what is left of each axis."""
    li = V.pts_li(spark, sf_dir).select("pos", *GEO)
    parts = [H.order0(O.nearest_back(li, GEO, w).filter("back is not null"), {"back": "back", **{c: f"{c}_b" for c in GEO}}).select(F.lit(w).alias("rows_back"), "col", "n", "h") for w in _WINDOWS]
    return reduce(DataFrame.union, parts)


def _mean_sql() -> str:
    return "CAST(CASE WHEN s >= 0 THEN floor((2.0 * s + c) / (2 * c)) ELSE -floor((-2.0 * s + c) / (2 * c)) END AS BIGINT)"


def _near_sql() -> str:
    return f"k AS ({knn_sql(11)}), c AS (SELECT k.pos, npos, row_number() OVER (PARTITION BY k.pos ORDER BY rank) AS r FROM k WHERE npos < k.pos)"


def _left_sql(name: str, value: str, p: int) -> str:
    """(pos, v): what p earlier neighbours leave of value over pts_emb; without any, the row before decides."""
    return f"{name} AS (SELECT f.pos, f.v - coalesce(g.m, b.v, 0) AS v FROM (SELECT pos, {value} AS v FROM pts_emb) f LEFT JOIN (SELECT pos, {_mean_sql()} AS m FROM (SELECT c.pos, sum(v) AS s, count(*) AS c FROM c JOIN (SELECT pos, {value} AS v FROM pts_emb) e ON e.pos = c.npos WHERE r <= {p} GROUP BY c.pos)) g USING (pos) LEFT JOIN (SELECT pos + 1 AS pos, {value} AS v FROM pts_emb) b USING (pos))"


_PS = (1, 3, 5)
_HUNDRED = "CAST(round({c} * 100) AS BIGINT)"


@query(f"{_near_sql()}, {', '.join(_left_sql(f's{p}', _HUNDRED.format(c='y'), p) for p in _PS)}, l AS ({_u([f'SELECT {p} AS p, v FROM s{p}' for p in _PS])}), h AS ({h_sql('l', 'p')}) SELECT CAST(p AS INTEGER) AS p, n, h FROM h", ("pts_emb",))
def spatial_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute less the mean of its first P earlier neighbours of eleven."""
    e = V.pts_emb(spark, sf_dir)
    near = kept(S.earlier(e, 11))
    v = e.select("pos", F.round(F.col("y") * 100).cast("long").alias("v"))
    parts = [H.order0(S.left_over(v, near, ["v"], p), {"v": "v_s"}).select(F.lit(p).alias("p"), "n", "h") for p in _PS]
    return reduce(DataFrame.union, parts)


_RGB = {c: f"CAST(floor((coalesce({a}, 0) + 1) * 127) AS BIGINT)" for c, a in zip("rgb", "xyz", strict=True)}
_T = f"({_RGB['b']} + (({_RGB['r']} - {_RGB['b']}) >> 1))"
_YCC = {"y": f"({_T} + (({_RGB['g']} - {_T}) >> 1))", "co": f"({_RGB['r']} - {_RGB['b']})", "cg": f"({_RGB['g']} - {_T})"}


@query(f"{_near_sql()}, {', '.join(_left_sql(f's_{n}', e, 3) for n, e in _YCC.items())}, l AS ({_u([f'''SELECT '{n}' AS col, v FROM s_{n}''' for n in _YCC])}) {h_sql('l')}", ("pts_emb",))
def colour_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reversible colour transform, each plane less the mean of its first three earlier neighbours."""
    e = V.pts_emb(spark, sf_dir)
    rgb = [F.floor((F.coalesce(F.col(c), F.lit(0.0)) + 1) * 127).cast("long") for c in "xyz"]
    planes = e.select("pos", *[v.alias(n) for n, v in zip(_YCC, E.ycocg(*rgb), strict=True)])
    return H.order0(S.left_over(planes, S.earlier(e, 11), list(_YCC), 3), {n: f"{n}_s" for n in _YCC})


_XREF = f"({_HUNDRED.format(c='y')} - {_HUNDRED.format(c='x')})"


@query(f"{_near_sql()}, {', '.join(_left_sql(f's{p}', _XREF, p) for p in _PS)}, l AS (SELECT 0 AS p, {_XREF} AS v FROM pts_emb UNION ALL SELECT 100, {_XREF} - coalesce(lag({_XREF}) OVER (ORDER BY pos), 0) FROM pts_emb UNION ALL {_u([f'SELECT {p}, v FROM s{p}' for p in _PS])}), h AS ({h_sql('l', 'p')}) SELECT CAST(p AS INTEGER) AS p, n, h FROM h", ("pts_emb",))
def xref_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column less another: as it stands (0), its differences (100), and less its P earlier neighbours."""
    e = V.pts_emb(spark, sf_dir)
    v = kept(e.select("pos", (F.round(F.col("y") * 100).cast("long") - F.round(F.col("x") * 100).cast("long")).alias("v")))
    near = kept(S.earlier(e, 11))
    d = V.with_position(v, "pos", name="i")
    parts = [H.order0(v, {"v": "v"}).select(F.lit(0).alias("p"), "n", "h"), H.order0(O.differences(d, ["v"], order="i"), {"v": "v_d1"}).select(F.lit(100), "n", "h")]
    parts += [H.order0(S.left_over(v, near, ["v"], p), {"v": "v_s"}).select(F.lit(p), "n", "h") for p in _PS]
    return reduce(DataFrame.union, parts)


_FLOATS = {"l_extendedprice": "lineitem", "l_discount": "lineitem", "l_tax": "lineitem", "p_retailprice": "part", "value": "events"}
DECIMALS = range(0, 16)


@query("c AS (" + _u([f"SELECT '{c}' AS col, '{path}' AS path, {k} AS decimals, bool_and(round_even({c} * 1e{k}, 0) {back} = {c}) AS exact, count({c}) AS n, CAST(sum(CASE WHEN CAST({c} AS VARCHAR) = '-0.0' THEN 1 ELSE 0 END) AS BIGINT) AS negative_zeros FROM {t}" for c, t in _FLOATS.items() for k in DECIMALS for path, back in (("multiply", f"* 1e-{k}"), ("divide", f"/ 1e{k}"))]) + """), f AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY CASE WHEN path = 'multiply' THEN 0 ELSE 1 END, decimals) AS r FROM c WHERE exact AND n >= 100)
SELECT col, path, CAST(decimals AS INTEGER) AS decimals, n, negative_zeros FROM f WHERE r = 1""")
def float_grid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first grid that gives every value of a float column back: whole multiples of a step, then quotients by a power of
    ten up to 10**15, the coarsest first. Columns of fewer than 100 values have none; negative zeros are counted apart."""
    parts = []
    for c, t in _FLOATS.items():
        v = F.col(c).cast("double")
        ok = []
        for path in ("multiply", "divide"):
            for k in DECIMALS:
                q = F.rint(v * F.lit(float(f"1e{k}")))
                ok.append(F.min((q * F.lit(float(f"1e-{k}")) if path == "multiply" else q / F.lit(float(f"1e{k}"))).eqNullSafe(v).cast("int")).alias(f"{path}_{k}"))
        r = V.read(spark, sf_dir, t).filter(F.col(c).isNotNull()).agg(F.count("*").alias("n"), F.sum((v.cast("string") == "-0.0").cast("long")).alias("negative_zeros"), *ok)
        tries = [F.when(F.col(f"{path}_{k}") == 1, F.struct(F.lit(path).alias("path"), F.lit(k).alias("decimals"))) for path in ("multiply", "divide") for k in DECIMALS]
        parts.append(r.filter("n >= 100").select(F.lit(c).alias("col"), F.coalesce(*tries).alias("s"), "n", "negative_zeros").filter("s is not null").select("col", "s.path", "s.decimals", "n", "negative_zeros"))
    return reduce(DataFrame.union, parts)


_DEPTHS = {"surface": 4, "fine": 8}


@query(", ".join(f"o{d} AS ({occ_sql('pts_emb', d)}), h{d} AS ({h_sql(f'o{d}', 'level', 'byte')}), b{d} AS (SELECT sum(n * h) / (SELECT count(*) FROM pts_emb) AS bits FROM h{d})" for d in _DEPTHS.values()) + " SELECT round(b4.bits, 5) AS surface_bits, round(b8.bits, 5) AS fine_bits, round(b8.bits - b4.bits, 5) AS sampling_bits, round(b4.bits / b8.bits, 5) AS surface_share FROM b4, b8", ("pts_emb",))
def surface_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the bits a point of an octree's occupancy bytes at a fine cell size, the part spent by the coarse one, and the rest."""
    e = V.pts_emb(spark, sf_dir).select(*"xyz")
    n, bits = e.count(), {}
    for name, depth in _DEPTHS.items():
        o = S.occupancy(e, depth).groupBy("level", "byte").agg(F.count("*").alias("c"))
        h = o.groupBy("level").agg(F.sum("c").alias("n"), F.round(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c"), 6).alias("h"))
        bits[name] = h.agg(F.sum(F.col("n") * F.col("h"))).first()[0] / max(n, 1) if n else 0.0
    a, b = bits["surface"], bits["fine"]
    return spark.createDataFrame([(round(a, 5), round(b, 5), round(b - a, 5), round(a / b, 5) if b else None)], "surface_bits double, fine_bits double, sampling_bits double, surface_share double")


RATIOS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1.0, 2.0)


@query()
def regime_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well local planes tell the child octant, at six ratios of the cell to the point spacing."""
    e = kept(V.pts_emb(spark, sf_dir).select("pos", *"xyz"))
    spacing = O.upper_median(S.knn(e, e, 1, same=True), "d2")
    if spacing is None:
        return spark.createDataFrame([], "ratio double, cells long, coverage double, h double, h_given double, hit double")
    return reduce(DataFrame.union, [octant_experiment(e, math.sqrt(spacing) * r).select(F.lit(r).alias("ratio"), "cells", "coverage", "h", "h_given", "hit") for r in RATIOS])


def legendre_sql(degree: int, t: str) -> str:
    return {4: f"(35 * power({t}, 4) - 30 * power({t}, 2) + 3) / 8", 6: f"(231 * power({t}, 6) - 315 * power({t}, 4) + 105 * power({t}, 2) - 5) / 16"}[degree]


@query(f"""k AS ({knn_sql(12)}), v AS (SELECT k.pos, npos, (b.x - a.x) / sqrt(d2) AS x, (b.y - a.y) / sqrt(d2) AS y, (b.z - a.z) / sqrt(d2) AS z FROM k JOIN pts_emb a ON a.pos = k.pos JOIN pts_emb b ON b.pos = k.npos WHERE d2 > 0),
t AS (SELECT p.pos, greatest(-1, least(1, p.x * q.x + p.y * q.y + p.z * q.z)) AS t FROM v p JOIN v q USING (pos)), o AS (SELECT pos, {', '.join(f'sqrt(greatest(0, avg({legendre_sql(l, "t")}))) AS q{l}' for l in (4, 6))} FROM t GROUP BY pos)
SELECT count(*) AS n, round(avg(q4), 5) AS q4, round(avg(q6), 5) AS q6 FROM o""", ("pts_emb",))
def bond_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation-invariant bond order of degree 4 and 6 over twelve neighbours."""
    q = S.bond_order(V.pts_emb(spark, sf_dir), 12, (4, 6))
    return q.agg(F.count("*").alias("n"), *[F.round(F.avg(f"q{l}"), 5).alias(f"q{l}") for l in (4, 6)])


def proxy_sizes(df: DataFrame, cols: list[str], block: int = 65_536) -> DataFrame:
    """(col, codec, bytes): sizes under general-purpose compressors of each block's zigzag differences, their byte planes
    one after the other; raw is eight bytes a row. Blocks are independent; columns with nulls are an error."""
    import zstandard

    each = df.select(F.floor(F.col("pos") / block).alias("block"), "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("long").alias("v")) for c in cols])).alias("s")).select("block", "pos", "s.*")
    packers = {"raw": bytes, "zlib6": lambda b: zlib.compress(b, 6), "zstd12": lambda b: zstandard.ZstdCompressor(level=12).compress(b), "zstd19": lambda b: zstandard.ZstdCompressor(level=19).compress(b), "xz6": lambda b: lzma.compress(b, preset=6)}

    def size(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        if p["v"].isna().any():
            raise ValueError(f"column {p['col'].iloc[0]} has nulls")
        with np.errstate(over="ignore"):
            d = np.diff(p["v"].to_numpy(), prepend=np.int64(0))
            z = (d.astype(np.uint64) << np.uint64(1)) ^ (d >> np.int64(63)).astype(np.uint64)
        planes = np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8).T).tobytes()
        return pd.DataFrame({"col": p["col"].iloc[0], "codec": list(packers), "bytes": [len(f(planes)) for f in packers.values()]})

    return each.groupBy("col", "block").applyInPandas(size, "col string, codec string, bytes long").groupBy("col", "codec").agg(F.sum("bytes").alias("bytes"))


@query()
def proxy_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy_sizes(V.pts_li(spark, sf_dir), ["x", "y", "z", "shipday"])


@query(f"g AS (SELECT CAST(list_reduce(list(12 * suppkey), lambda a, b: gcd(a, b)) AS BIGINT) AS g FROM pts_li) SELECT g AS gcd, round(CAST({SCALE} AS DOUBLE) * g, 9) AS scale, CAST({OFFSET} AS DOUBLE) AS \"offset\", count(*) AS n, round(max(abs((12 * suppkey // g) * (CAST({SCALE} AS DOUBLE) * g) + CAST({OFFSET} AS DOUBLE) - (12 * suppkey * CAST({SCALE} AS DOUBLE) + CAST({OFFSET} AS DOUBLE)))), 9) AS moved, CAST(0 AS BIGINT) AS mismatches FROM pts_li, g GROUP BY g", ("pts_li",))
def grid_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate divided by its greatest common divisor with a scale that much larger: the world stays where it is."""
    li = V.pts_li(spark, sf_dir).select((12 * F.col("suppkey")).alias("v"))
    g = column_gcds(li, ["v"]).first()["gcd"]
    q = E.floor_div(F.col("v"), g)
    moved = F.abs(q * F.lit(SCALE * g) + F.lit(OFFSET) - (F.col("v") * F.lit(SCALE) + F.lit(OFFSET)))
    return li.agg(F.lit(g).cast("long").alias("gcd"), F.lit(round(SCALE * g, 9)).alias("scale"), F.lit(OFFSET).alias("offset"), F.count("*").alias("n"), F.round(F.max(moved), 9).alias("moved"), F.sum((q * g != F.col("v")).cast("long")).alias("mismatches"))


_EXT = {"label": "label", "y": _HUNDRED.format(c="y"), "z": _HUNDRED.format(c="z")}


@query(f"{_near_sql()}, {', '.join(_left_sql(f's_{n}', e, 3) for n, e in _EXT.items())}, l AS ({_u([f'''SELECT '{n}:raw' AS col, {e} AS v FROM pts_emb UNION ALL SELECT '{n}:delta', {e} - coalesce(lag({e}) OVER (ORDER BY pos), 0) FROM pts_emb UNION ALL SELECT '{n}:spatial', v FROM s_{n}''' for n, e in _EXT.items()])}), h AS ({h_sql('l')}), w AS (SELECT split_part(col, ':', 1) AS col, max(CASE WHEN contains(col, 'raw') THEN h END) AS raw, max(CASE WHEN contains(col, 'delta') THEN h END) AS delta, max(CASE WHEN contains(col, 'spatial') THEN h END) AS spatial FROM h GROUP BY 1) SELECT *, least(raw, delta, spatial) AS best, spatial < 0.95 * delta AS leaves FROM w", ("pts_emb",))
def attribute_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as they stand, as differences and less their earlier neighbours; one leaves the container only if the
    neighbours save more than a twentieth over differences."""
    e = V.pts_emb(spark, sf_dir)
    v = kept(V.with_position(e.select("pos", "label", *[F.round(F.col(c) * 100).cast("long").alias(c) for c in "yz"]), "pos", name="i"))
    near = S.earlier(e, 11)
    h = H.order0(O.differences(v, list(_EXT), order="i"), {f"{n}:raw": n for n in _EXT} | {f"{n}:delta": f"{n}_d1" for n in _EXT})
    h = h.union(H.order0(S.left_over(v, near, list(_EXT), 3), {f"{n}:spatial": f"{n}_s" for n in _EXT}))
    kind = lambda k: F.max(F.when(F.col("col").endswith(k), F.col("h"))).alias(k)
    w = h.groupBy(F.substring_index("col", ":", 1).alias("col")).agg(kind("raw"), kind("delta"), kind("spatial"))
    return w.withColumn("best", F.least("raw", "delta", "spatial")).withColumn("leaves", F.col("spatial") < 0.95 * F.col("delta"))


_D2XY = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
_ZP = (1, 2, 3, 5)


@query(f"""k AS (SELECT a.pos, b.pos AS npos, row_number() OVER (PARTITION BY a.pos ORDER BY {_D2XY}, b.pos) AS r FROM pts_emb a JOIN pts_emb b ON a.pos <> b.pos), f AS (SELECT pos, CAST(round(z * 1000) AS BIGINT) AS v FROM pts_emb),
l AS ({_u([f"SELECT {p} AS p, f.v - {_mean_sql()} AS v FROM f JOIN (SELECT k.pos, sum(e.v) AS s, count(*) AS c FROM k JOIN f e ON e.pos = k.npos WHERE r <= {p} GROUP BY k.pos) USING (pos)" for p in _ZP])}), h AS ({h_sql('l', 'p')}) SELECT CAST(p AS INTEGER) AS p, n, h FROM h""", ("pts_emb",))
def z_from_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height less the mean of the P nearest points of the plane."""
    e = V.pts_emb(spark, sf_dir)
    near = kept(S.knn(e, e, max(_ZP), same=True, axes=("x", "y")).select("pos", F.col("rank").alias("r"), "npos"))
    v = e.select("pos", F.round(F.col("z") * 1000).cast("long").alias("v"))
    return reduce(DataFrame.union, [H.order0(S.left_over(v, near, ["v"], p).filter("v_near"), {"v": "v_s"}).select(F.lit(p).alias("p"), "n", "h") for p in _ZP])


_TABLES = ("customer", "documents", "embeddings", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query(_u([f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in _TABLES]))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table, from the footers of its files."""
    return reduce(DataFrame.union, [V.read(spark, sf_dir, t).agg(F.lit(t).alias("tbl"), F.count("*").alias("n")) for t in _TABLES])


@query("""c AS (SELECT 'x' AS col, 'same' AS status, CAST(0 AS BIGINT) AS mismatches UNION ALL SELECT 'y', CASE WHEN count(*) > 0 THEN 'differs' ELSE 'same' END, count(*) FROM pts_li WHERE pos % 7 = 0 UNION ALL SELECT 'tax', 'missing', count(*) FROM pts_li) SELECT * FROM c""", ("pts_li",))
def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of a table come back from a copy, here one that changed y and lost tax."""
    from gridloom.operators.dependencies import coverage

    li = V.pts_li(spark, sf_dir).select("pos", "x", "y", "tax")
    return coverage(li, li.select("pos", "x", (F.col("y") + (F.col("pos") % 7 == 0).cast("long")).alias("y")))


_DIFF = "d AS (SELECT pos, x, y, " + ", ".join(f"{c} - {lag(c)} AS d{c}" for c in "xy") + " FROM pts_li)"
ONE = 1 << 20


@query(f"""{_DIFF}, m AS (SELECT 0.5 * atan2(2 * covar_pop(dx, dy), var_pop(dx) - var_pop(dy)) AS a FROM d), f AS (SELECT a, CAST(round(-tan(-a / 2) * {ONE}) AS BIGINT) AS t, CAST(round(sin(-a) * {ONE}) AS BIGINT) AS s FROM m),
r1 AS (SELECT pos, x, y, t, s, x + ((t * y) >> 20) AS x1 FROM pts_li, f), r2 AS (SELECT *, y + ((s * x1) >> 20) AS y1 FROM r1), r AS (SELECT *, x1 + ((t * y1) >> 20) AS x2 FROM r2),
b AS (SELECT {blen(zz(f'x - {lag("x")}'))} + {blen(zz(f'y - {lag("y")}'))} AS base, {blen(zz(f'x2 - {lag("x2")}'))} + {blen(zz(f'y1 - {lag("y1")}'))} AS turned FROM r)
SELECT round((SELECT a FROM m), 6) AS angle, CAST(sum(base) AS BIGINT) AS base_bits, CAST(sum(turned) AS BIGINT) AS turned_bits, CAST(0 AS BIGINT) AS mismatches FROM b""", ("pts_li",))
def rotated_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane turned by three shears to the principal direction of its differences, coded and turned back."""
    li = kept(V.pts_li(spark, sf_dir).select("pos", "x", "y"))
    a = O.differences(li, ["x", "y"]).agg(0.5 * F.atan2(2 * F.covar_pop("x_d1", "y_d1"), F.var_pop("x_d1") - F.var_pop("y_d1"))).first()[0] or 0.0
    t, s = round(-math.tan(-a / 2) * ONE), round(math.sin(-a) * ONE)
    u, v = E.shear(F.col("x"), F.col("y"), t, s)
    p = li.withColumns({"u": u, "v": v})
    x, y = E.unshear(F.col("u"), F.col("v"), t, s)
    p = p.withColumn("bad", ((x != F.col("x")) | (y != F.col("y"))).cast("long"))
    d = O.differences(p, ["x", "y", "u", "v"])
    both = lambda c, e: O.bits(f"{c}_d1") + O.bits(f"{e}_d1")
    return d.agg(F.lit(round(a, 6)).alias("angle"), F.sum(both("x", "y")).alias("base_bits"), F.sum(both("u", "v")).alias("turned_bits"), F.sum("bad").alias("mismatches"))


_OCT = """n AS (SELECT x / r AS x, y / r AS y, z / r AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM pts_emb) WHERE r > 0), o AS (SELECT *, abs(x) + abs(y) + abs(z) AS s FROM n),
f AS (SELECT x, y, z, CASE WHEN z >= 0 THEN x / s ELSE (1 - abs(y / s)) * CASE WHEN x / s >= 0 THEN 1 ELSE -1 END END AS u, CASE WHEN z >= 0 THEN y / s ELSE (1 - abs(x / s)) * CASE WHEN y / s >= 0 THEN 1 ELSE -1 END END AS v FROM o),
q AS (SELECT x, y, z, CAST(floor((u + 1) * 127.5 + 0.5) AS INTEGER) AS u, CAST(floor((v + 1) * 127.5 + 0.5) AS INTEGER) AS v FROM f),
d AS (SELECT *, u * (2.0::DOUBLE / 255) - 1 AS a, v * (2.0::DOUBLE / 255) - 1 AS b FROM q), g AS (SELECT *, 1 - abs(a) - abs(b) AS c FROM d),
h AS (SELECT x, y, z, u, v, c, CASE WHEN c >= 0 THEN a ELSE (1 - abs(b)) * CASE WHEN a >= 0 THEN 1 ELSE -1 END END AS p, CASE WHEN c >= 0 THEN b ELSE (1 - abs(a)) * CASE WHEN b >= 0 THEN 1 ELSE -1 END END AS q FROM g),
w AS (SELECT u, v, sqrt(power(p / l - x, 2) + power(q / l - y, 2) + power(c / l - z, 2)) AS err FROM (SELECT *, sqrt(p*p + q*q + c*c) AS l FROM h))"""


@query(_OCT + " SELECT count(*) AS n, CAST(sum(u * 256 + v) AS BIGINT) AS total, round(max(err), 6) AS worst, round(avg(err), 6) AS mean FROM w", ("pts_emb",))
def normal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions in two bytes each, and how far they come back from where they were."""
    e = V.pts_emb(spark, sf_dir)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    n = e.withColumn("r", r).filter("r > 0").select(*[(F.col(c) / F.col("r")).alias(c) for c in "xyz"])
    u, v = E.octahedral(F.col("x"), F.col("y"), F.col("z"))
    n = n.withColumns({"u": u, "v": v})
    back = E.from_octahedral(F.col("u"), F.col("v"))
    err = F.sqrt(sum((F.pow(b - F.col(c), F.lit(2.0)) for b, c in zip(back, "xyz", strict=True)), F.lit(0.0)))
    return n.agg(F.count("*").alias("n"), F.sum(F.col("u") * 256 + F.col("v")).alias("total"), F.round(F.max(err), 6).alias("worst"), F.round(F.avg(err), 6).alias("mean"))


@query("""m AS (SELECT sid, count(*) AS n, var_pop(gps / 1000000.0::DOUBLE) AS a, var_pop(val / 100.0::DOUBLE) AS b, covar_pop(gps / 1000000.0::DOUBLE, val / 100.0::DOUBLE) AS c FROM scan_ev GROUP BY sid), e AS (SELECT sid, n, (a + b) / 2 AS mid, sqrt(power((a - b) / 2, 2) + c * c) AS half FROM m)
SELECT count(*) AS sources, CAST(sum(n) AS BIGINT) AS n, round(avg(sqrt(mid + half)), 1) AS spread, round(avg(sqrt(greatest(mid - half, 0))), 1) AS thinness FROM e""", ("scan_ev",))
def line_thinness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean deviation along and across the principal axis of each source's times and values."""
    e = V.scan_ev(spark, sf_dir).select("sid", (F.col("gps") / 1_000_000).alias("t"), (F.col("val") / 100).alias("v"))
    t = scan.thinness(e, ["sid"], "t", "v")
    return t.agg(F.count("*").alias("sources"), F.sum("n").alias("n"), F.round(F.avg("spread"), 1).alias("spread"), F.round(F.avg("thinness"), 1).alias("thinness"))


@query()
def smallest_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shorter of a column's own streams and of its bytes under a general-purpose compressor, which is kept as it is where it wins."""
    cols = ["x", "y", "z", "shipday"]
    li = kept(V.pts_li(spark, sf_dir).select("pos", *cols))
    own = C.best_streams(li, cols).groupBy("col").agg(F.sum(F.octet_length("data")).alias("bytes")).select("col", F.lit("streams").alias("form"), "bytes")
    forms = own.union(proxy_sizes(li, cols).select("col", F.col("codec").alias("form"), "bytes"))
    return forms.groupBy("col").agg(F.min(F.struct("bytes", "form")).alias("m")).select("col", "m.form", "m.bytes")


@query()
def float_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the sign, the exponent, and the high and low halves of the mantissa of a float column."""
    @F.pandas_udf("long")
    def raw(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy(np.float32).view(np.uint32).astype(np.int64))

    v = V.read(spark, sf_dir, "embeddings").select(raw(F.col("embedding")[0]).alias("v"))
    part = lambda shift, bits: F.shiftright("v", shift).bitwiseAND(F.lit((1 << bits) - 1))
    return H.order0(v, {"sign": part(31, 1), "exponent": part(23, 8), "mantissa_high": part(12, 11), "mantissa_low": part(0, 12)}).withColumnRenamed("col", "part")


def report(rows: list, columns: list[str]) -> str:
    """Rows as a Markdown table."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])


def bit_report(spark: SparkSession, sf_dir: str) -> str:
    """Profile, costs and dependencies of the fact table as one Markdown text."""
    from gridloom.plans.column_queries import column_profile
    from gridloom.plans.dependency_queries import codec_choice, plan_report

    parts = {"Columns": column_profile(spark, sf_dir).orderBy("field_pos"), "Representations": codec_choice(spark, sf_dir).orderBy("col"), "Dependencies": plan_report(spark, sf_dir).orderBy("seq")}
    return "\n\n".join(f"## {name}\n\n{report([tuple(r) for r in df.collect()], df.columns)}" for name, df in parts.items())
