"""Queries on single columns, pairs of columns and storage order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.operators import entropy as H
from gridloom.operators import ordered as O
from gridloom.plans.registry import query
from gridloom.sources import views as V

COLS = ["x", "y", "z", "tax", "partkey", "suppkey", "linenumber", "shipday"]
GEO = ["x", "y", "z"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def lag(c: str, k: int = 1, zero: bool = True) -> str:
    v = f"lag({c}, {k}) OVER (ORDER BY pos)"
    return f"coalesce({v}, 0)" if zero else v


def zz(e: str) -> str:
    return f"(CASE WHEN ({e}) >= 0 THEN 2 * ({e}) ELSE -2 * ({e}) - 1 END)"


def blen(e: str) -> str:
    return f"(CASE WHEN ({e}) = 0 THEN 0 ELSE length(bin(CAST(({e}) AS BIGINT))) END)"


def med3(a: str, b: str, c: str) -> str:
    return f"({a} + {b} + {c} - greatest({a}, {b}, {c}) - least({a}, {b}, {c}))"


def h_sql(source: str, col: str = "col", v: str = "v", name: str = "h") -> str:
    """Entropy of v by col over a relation (col, v)."""
    return f"SELECT {col}, CAST(sum(c) AS BIGINT) AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS {name} FROM (SELECT {col}, {v}, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY {col}"


def long_sql(exprs: dict[str, str], source: str) -> str:
    return _union([f"SELECT '{n}' AS col, {e} AS v FROM {source}" for n, e in exprs.items()])


PROFILE_SQL = f"""d AS (SELECT *, {", ".join(f"{c} - {lag(c)} AS d_{c}" for c in COLS)} FROM pts_li),
a AS ({_union([f"SELECT '{c}' AS col, {k} AS field_pos, count(*) AS n, min({c}) AS lo, max({c}) AS hi, count(DISTINCT {c}) AS n_distinct FROM d" for k, c in enumerate(COLS)])}),
l AS ({long_sql({c: c for c in COLS}, "d")}), m AS ({long_sql({c: f"d_{c}" for c in COLS}, "d")}),
h0 AS ({h_sql("l", name="h0")}), h1 AS ({h_sql("m", name="h1")}),
j AS (SELECT a.*, h0.h0, h1.h1, CASE WHEN hi - lo = 0 THEN 0 WHEN hi - lo < 256 THEN 1 WHEN hi - lo < 65536 THEN 2 WHEN hi - lo < 4294967296 THEN 4 ELSE 8 END AS width_bytes FROM a JOIN h0 USING (col) JOIN h1 USING (col))
SELECT col, field_pos, n, lo, hi, n_distinct, h0, h1, width_bytes,
CASE WHEN lo = hi THEN 'constant' WHEN h0 <= h1 AND h0 <= 8 * width_bytes THEN 'order0' WHEN h1 <= 8 * width_bytes THEN 'delta' ELSE 'raw' END AS cheapest FROM j"""


@query(PROFILE_SQL, ("pts_li",))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.differences(V.pts_li(spark, sf_dir), COLS)
    named = {f"{kind}:{c}": c if kind == "0" else f"{c}_d1" for c in COLS for kind in "01"}
    h = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    stats = H.counts(d, named).groupBy("k").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n_distinct"), F.round(h, 6).alias("h"))
    stats = stats.withColumn("col", H.named("k", list(named)))
    name, kind = F.substring_index("col", ":", -1), F.substring_index("col", ":", 1)
    pick = lambda k, c: F.max(F.when(kind == k, F.col(c)))
    out = stats.groupBy(name.alias("col")).agg(pick("0", "n").alias("n"), pick("0", "lo").alias("lo"), pick("0", "hi").alias("hi"), pick("0", "n_distinct").alias("n_distinct"), pick("0", "h").alias("h0"), pick("1", "h").alias("h1"))
    out = out.withColumn("width_bytes", E.width_bytes(F.col("hi") - F.col("lo")))
    cheapest = F.when(F.col("lo") == F.col("hi"), "constant").when((F.col("h0") <= F.col("h1")) & (F.col("h0") <= 8 * F.col("width_bytes")), "order0").when(F.col("h1") <= 8 * F.col("width_bytes"), "delta").otherwise("raw")
    place = F.array_position(F.array(*map(F.lit, COLS)), F.col("col")).cast("int") - 1
    return out.select("col", place.alias("field_pos"), "n", "lo", "hi", "n_distinct", "h0", "h1", "width_bytes", cheapest.alias("cheapest"))


@query(f"l AS ({long_sql({c: c for c in COLS}, 'pts_li')}) {h_sql('l')}", ("pts_li",))
def entropy_order0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.order0(V.pts_li(spark, sf_dir), {c: c for c in COLS})


PAIRS = {"x|y": ("x", "y"), "y|x": ("y", "x"), "tax|z": ("tax", "z"), "partkey|suppkey": ("partkey", "suppkey"), "z|linenumber": ("z", "linenumber")}


def cond_sql(source: str, pairs: dict[str, tuple[str, str]]) -> str:
    cells = _union([f"SELECT '{n}' AS col, {a} AS a, {c} AS c FROM {source}" for n, (a, c) in pairs.items()])
    h = "log2(sum(k)) - sum(k * log2(k)) / sum(k)"
    return f"""l AS ({cells}), cells AS (SELECT col, a, c, count(*) AS k FROM l GROUP BY ALL),
j AS (SELECT col, {h} AS joint FROM cells GROUP BY col), g AS (SELECT col, {h} AS given FROM (SELECT col, c, sum(k) AS k FROM cells GROUP BY ALL) GROUP BY col)
SELECT col, round(joint, 6) AS joint, round(given, 6) AS given, round(joint - given, 6) AS conditional FROM j JOIN g USING (col)"""


@query(cond_sql("pts_li", PAIRS).replace("SELECT col, round(joint, 6) AS joint, round(given, 6) AS given, round(joint - given, 6) AS conditional", "SELECT col, round(joint, 6) AS joint"), ("pts_li",))
def entropy_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.conditional(V.pts_li(spark, sf_dir), PAIRS).select("col", "joint")


@query(cond_sql("pts_li", PAIRS), ("pts_li",))
def entropy_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.conditional(V.pts_li(spark, sf_dir), PAIRS)


DIFFS = {"res-partkey": ("res", "partkey"), "dup-partkey": ("dup", "partkey"), "x-partkey": ("x", "partkey"), "tax-z": ("tax", "z")}


@query(f"l AS ({long_sql({n: f'{a} - {b}' for n, (a, b) in DIFFS.items()}, 'planted')}) {h_sql('l')}", ("pts_li", "planted"))
def entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.order0(V.planted(spark, sf_dir), {n: F.col(a) - F.col(b) for n, (a, b) in DIFFS.items()})


@query(f"s AS (SELECT * FROM planted WHERE pos % 7 = 0), l AS ({long_sql({n: f'{a} - {b}' for n, (a, b) in DIFFS.items()}, 's')}) {h_sql('l')}", ("pts_li", "planted"))
def entropy_difference_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: every seventh row."""
    return H.order0(V.planted(spark, sf_dir).filter(F.col("pos") % 7 == 0), {n: F.col(a) - F.col(b) for n, (a, b) in DIFFS.items()})


_D = f"d AS (SELECT pos, {', '.join(GEO)}, {', '.join(f'{c} - {lag(c)} AS d_{c}' for c in GEO)} FROM pts_li)"


@query(f"{_D}, l AS ({long_sql({c: blen(zz(f'd_{c}')) for c in GEO}, 'd')}) SELECT col, CAST(v AS INTEGER) AS bits, count(*) AS n FROM l GROUP BY ALL", ("pts_li",))
def zigzag_bitlen_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.differences(V.pts_li(spark, sf_dir), GEO)
    return H.unpivot(d, {c: E.bitlen(E.zigzag(F.col(f"{c}_d1"))) for c in GEO}).groupBy("col", F.col("v").alias("bits")).agg(F.count("*").alias("n"))


_DELTA = {f"{c}:{k}": e for c in GEO for k, e in enumerate((c, f"{c} - a1_{c}", f"{c} - 2 * a1_{c} + a2_{c}", f"{c} - 3 * a1_{c} + 3 * a2_{c} - a3_{c}"))}


@query(f"d AS (SELECT *, {', '.join(f'{lag(c, k)} AS a{k}_{c}' for c in GEO for k in (1, 2, 3))} FROM pts_li), l AS ({long_sql(_DELTA, 'd')}) {h_sql('l')}", ("pts_li",))
def delta_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.differences(V.pts_li(spark, sf_dir).select("pos", *GEO), GEO, 3)
    return H.order0(d, {f"{c}:{k}": c if k == 0 else f"{c}_d{k}" for c in GEO for k in range(4)})


def modes_sql(c: str) -> str:
    """CTE body with r0..r7 for column c of pts_li."""
    d = [f"d{k}" for k in range(5)]
    d0 = "(CASE WHEN pos >= 1 THEN d0 ELSE 0 END)"
    m3 = f"(CASE WHEN pos >= 3 THEN {med3('d0', 'd1', 'd2')} ELSE {d0} END)"
    m5 = f"list_sort([{', '.join(d)}])[3]"
    step = [m3, f"(CASE WHEN pos >= 5 THEN CAST(floor((d0 + d1 + d2 + d3) / 4.0) AS BIGINT) ELSE {d0} END)", f"CAST(floor({d0} / 2.0) AS BIGINT)", f"(CASE WHEN pos >= 6 THEN {m5} ELSE {m3} END)", f"CAST(floor({d0} / 4.0) AS BIGINT)", f"CAST(floor({d0} * 3 / 4.0) AS BIGINT)", "0", f"(CASE WHEN pos >= 6 THEN CAST(floor({m5} / 2.0) AS BIGINT) ELSE CAST(floor({d0} / 2.0) AS BIGINT) END)"]
    lags = ", ".join(f"lag({c}, {k}) OVER (ORDER BY pos) AS l{k}" for k in range(1, 7))
    diffs = ", ".join(f"l{k + 1} - coalesce(l{k + 2}, 0) AS d{k}" for k in range(5))
    return f"SELECT pos, {', '.join(f'{c} - ((CASE WHEN pos >= 1 THEN l1 ELSE 0 END) + {s}) AS r{m}' for m, s in enumerate(step))} FROM (SELECT *, {diffs} FROM (SELECT pos, {c}, {lags} FROM pts_li))"


def _median_sql(m: int) -> str:
    parts = ", ".join(f"m_{c} AS ({modes_sql(c)})" for c in GEO)
    l = _union([f"SELECT '{c}' AS col, r{m} AS v FROM m_{c}" for c in GEO])
    b = f"SELECT col, CAST(sum({blen(zz('v'))}) AS BIGINT) AS bits FROM l GROUP BY col"
    return f"{parts}, l AS ({l}), h AS ({h_sql('l')}), b AS ({b}) SELECT col, n, h, bits FROM h JOIN b USING (col)"


def _median(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    li = V.pts_li(spark, sf_dir)
    r = O.all_residuals(li.select("pos", *GEO), GEO, [m])
    cells = H.counts(r, {c: f"{c}_r{m}" for c in GEO})
    h = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    out = cells.groupBy("k").agg(F.sum("c").alias("n"), F.round(h, 6).alias("h"), F.sum(O.bits("v") * F.col("c")).alias("bits"))
    return out.select(H.named("k", GEO).alias("col"), "n", "h", "bits")


@query(_median_sql(0), ("pts_li",))
def median3_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _median(spark, sf_dir, 0)


@query(_median_sql(3), ("pts_li",))
def median5_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _median(spark, sf_dir, 3)


_MODES = ", ".join(f"m_{c} AS ({modes_sql(c)})" for c in GEO)


@query(_MODES + " " + _union([f"SELECT '{c}' AS col, '{name}' AS mode, CAST(sum({blen(zz(f'r{m}'))}) AS BIGINT) AS bits FROM m_{c}" for c in GEO for m, name in enumerate(E.MODES)]), ("pts_li",))
def pred_modes_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mode_costs(V.pts_li(spark, sf_dir), GEO)


_BEST = "least(" + ", ".join(f"b{m}" for m in range(8)) + ")"


@query(f"m AS ({modes_sql('x')}), s AS (SELECT CAST(floor(pos / 1024) AS BIGINT) AS seg, {', '.join(f'CAST(sum({blen(zz(f"r{m}"))}) AS BIGINT) AS b{m}' for m in range(8))} FROM m GROUP BY 1) SELECT seg, CASE {' '.join(f'WHEN b{m} = {_BEST} THEN {m}' for m in range(8))} END AS mode, {_BEST} AS bits FROM s", ("pts_li",))
def segment_predictor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.segment_choice(V.pts_li(spark, sf_dir), "x")


_LAGGED = f"d AS (SELECT *, {', '.join(f'{lag(c)} AS p_{c}' for c in COLS)} FROM pts_li)"
_PREV = {c: (zz(c), f"p_{c} & 255") for c in ("y", "z", "tax", "linenumber")}


@query(f"{_LAGGED}, {cond_sql('d', _PREV)}", ("pts_li",))
def prev_value_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = O.with_lags(V.pts_li(spark, sf_dir), {f"p_{c}": (c, 1) for c in _PREV})
    return H.conditional(li, {c: (E.zigzag(F.col(c)), F.coalesce(f"p_{c}", F.lit(0)).bitwiseAND(F.lit(255))) for c in _PREV})


_DX, _DY = f"least({blen(zz('d_x'))}, 23)", f"least({blen(zz('d_y'))}, 23)"
_CROSS = {"x": (zz("d_x"), "0"), "y|x": (zz("d_y"), _DX), "z|xy": (zz("d_z"), f"least({_DX}, 7) * 8 + least({_DY}, 7)")}


@query(f"{_D}, {cond_sql('d', _CROSS)}", ("pts_li",))
def cross_axis_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.differences(V.pts_li(spark, sf_dir), GEO)
    z = {c: E.zigzag(F.col(f"{c}_d1")) for c in GEO}
    kx, ky = E.bucket(z["x"]), E.bucket(z["y"])
    return H.conditional(d, {"x": (z["x"], F.lit(0)), "y|x": (z["y"], kx), "z|xy": (z["z"], F.least(kx, F.lit(7)) * 8 + F.least(ky, F.lit(7)))})


_SIGNS = {f"{c}:{k}": (blen(zz(f"d_{c}")), " + ".join(f"CASE WHEN coalesce(lag(d_{c}, {j + 1}) OVER (ORDER BY pos), 0) > 0 THEN {1 << j} ELSE 0 END" for j in range(k))) for c in GEO for k in (1, 2, 4)}


@query(f"{_D}, {cond_sql('d', _SIGNS)}", ("pts_li",))
def sign_history_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.differences(V.pts_li(spark, sf_dir), GEO).select("pos", *[f"{c}_d1" for c in GEO])
    d = O.with_lags(d, {f"s_{c}{j}": (f"{c}_d1", j) for c in GEO for j in range(1, 5)})
    pairs = {}
    for c in GEO:
        for k in (1, 2, 4):
            history = sum((F.when(F.col(f"s_{c}{j + 1}") > 0, 1 << j).otherwise(0) for j in range(1, k)), F.when(F.col(f"s_{c}1") > 0, 1).otherwise(0))
            pairs[f"{c}:{k}"] = (E.bitlen(E.zigzag(F.col(f"{c}_d1"))), history)
    return H.conditional(d, pairs)


@query("""c AS (SELECT z AS v, count(*) AS n FROM pts_li GROUP BY z), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS k FROM c)
SELECT CAST(CASE WHEN k <= 3 THEN k ELSE 0 END AS INTEGER) AS class, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values FROM r GROUP BY 1""", ("pts_li",))
def value_class_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 64 distinct values: the three most frequent (ties by value) are classes 1 to 3, the rest 0."""
    counts = V.pts_li(spark, sf_dir).groupBy("z").agg(F.count("*").alias("n"))
    top = [r[0] for r in counts.orderBy(F.desc("n"), "z").limit(3).collect()]
    k = reduce(lambda a, i: F.when(F.col("z") == top[i], i + 1).otherwise(a), range(len(top)), F.lit(0))
    return counts.groupBy(k.cast("int").alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("n_values"))


@query("""o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM pts_li),
q AS (SELECT max(CASE WHEN i = n // 4 THEN x END) AS q1, max(CASE WHEN i = n // 2 THEN x END) AS q2, max(CASE WHEN i = n * 3 // 4 THEN x END) AS q3 FROM o)
SELECT CAST((CASE WHEN x > q1 THEN 1 ELSE 0 END) + (CASE WHEN x > q2 THEN 1 ELSE 0 END) + (CASE WHEN x > q3 THEN 1 ELSE 0 END) AS INTEGER) AS class, count(*) AS n, min(x) AS lo, max(x) AS hi FROM pts_li, q GROUP BY 1""", ("pts_li",))
def value_class_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir)
    cuts = [O.order_statistic(li, "x", q) for q in (0.25, 0.5, 0.75)]
    k = sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts if c is not None), F.lit(0))
    return li.groupBy(k.cast("int").alias("class")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


MOST_LEVELS = 4096


def _palette(df: DataFrame, c: str) -> DataFrame:
    """(v, code): the sorted distinct values and their places; a column of more than MOST_LEVELS has none."""
    levels = df.select(F.col(c).alias("v")).distinct().limit(MOST_LEVELS + 1)
    levels = levels.withColumn("code", F.row_number().over(Window.orderBy("v")) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))
    return levels.filter(F.col("k") <= MOST_LEVELS).drop("k")


@query("""p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT shipday AS v FROM pts_li) WHERE (SELECT count(DISTINCT shipday) FROM pts_li) <= 4096)
SELECT CAST(code AS INTEGER) AS code, count(*) AS n, min(v) AS v FROM pts_li JOIN p ON v = shipday GROUP BY code""", ("pts_li",))
def palette_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir)
    p = _palette(li, "shipday")
    return li.join(F.broadcast(p), F.col("v") == F.col("shipday")).groupBy("code").agg(F.count("*").alias("n"), F.min("v").alias("v"))


_WIDE = ("y", "z", "shipday", "x")


@query(_union([f"SELECT '{c}' AS col, l AS levels, CASE WHEN l <= {MOST_LEVELS} THEN n ELSE 0 END AS coded, CAST(0 AS BIGINT) AS mismatches, n FROM (SELECT count(DISTINCT {c}) AS l, count(*) AS n FROM pts_li)" for c in _WIDE]), ("pts_li",))
def palette_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns coded by their palettes and restored; every row of a column with too many levels stays as it is."""
    li, out = V.pts_li(spark, sf_dir), None
    for c in _WIDE:
        p = _palette(li, c)
        coded = li.join(F.broadcast(p), F.col("v").eqNullSafe(F.col(c)), "left").select(F.col(c).alias("old"), "code")
        back = coded.join(F.broadcast(p), "code", "left").withColumn("new", F.when(F.col("code").isNull(), F.col("old")).otherwise(F.col("v")))
        wrong = F.sum((~F.col("old").eqNullSafe(F.col("new"))).cast("long"))
        r = back.agg(F.lit(c).alias("col"), F.countDistinct("old").alias("levels"), F.count("code").alias("coded"), F.coalesce(wrong, F.lit(0)).alias("mismatches"), F.count("*").alias("n"))
        out = r if out is None else out.union(r)
    return out


_SWEEP = {f"{c}:{k}": f"{_v} - coalesce(lag({_v}) OVER (ORDER BY pos), 0)" for c in GEO for k in range(6) for _v in [c if k == 0 else f"(({c} + {1 << (k - 1)}) >> {k})"]}


def verdict_sql(v: str, steps: tuple, last: str = "strong structure") -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL {' '.join(f"WHEN {v} > {limit} THEN '{name}'" for limit, name in steps)} ELSE '{last}' END"


@query(f"l AS ({long_sql(_SWEEP, 'pts_li')}), h AS ({h_sql('l')}), m AS (SELECT split_part(col, ':', 1) AS col, CAST(split_part(col, ':', 2) AS INTEGER) AS dropped, h, round(lag(h) OVER (PARTITION BY split_part(col, ':', 1) ORDER BY CAST(split_part(col, ':', 2) AS INTEGER)) - h, 6) AS marginal FROM h) SELECT *, {verdict_sql('marginal', E.BIT_VERDICTS)} AS verdict FROM m", ("pts_li",))
def lsb_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir).select("pos", *[E.drop_bits(F.col(c), k).alias(f"{c}_{k}") for c in GEO for k in range(6)])
    names = [f"{c}_{k}" for c in GEO for k in range(6)]
    h = H.order0(O.differences(li, names), {n: f"{n}_d1" for n in names})
    h = h.select(F.substring_index("col", "_", 1).alias("col"), F.substring_index("col", "_", -1).cast("int").alias("dropped"), "h")
    m = h.withColumn("marginal", F.round(F.lag("h").over(Window.partitionBy("col").orderBy("dropped")) - F.col("h"), 6))
    return m.withColumn("verdict", E.verdict(F.col("marginal"), E.BIT_VERDICTS))


@query("SELECT CAST(round(x / 0.05) AS BIGINT) AS qx, CAST(round_even(y / 0.05, 0) AS BIGINT) AS qy, count(*) AS n, round(max(abs(x - round(x / 0.05) * 0.05)), 9) AS max_err FROM pts_emb GROUP BY ALL", ("pts_emb",))
def grid_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = E.quantize(F.col("x"), 0.05)
    return V.pts_emb(spark, sf_dir).groupBy(q.alias("qx"), E.quantize_even(F.col("y"), 0.05).alias("qy")).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("x") - q * 0.05)), 9).alias("max_err"))


@query("""p AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, atan2(y, x) AS az FROM pts_emb), e AS (SELECT *, CASE WHEN r > 0 THEN asin(greatest(-1, least(1, z / r))) ELSE 0 END AS el FROM p),
q AS (SELECT x, y, z, round(r / 0.002) * 0.002 AS r2, round(az / 0.001) * 0.001 AS a2, round(el / 0.001) * 0.001 AS e2 FROM e),
b AS (SELECT sqrt(power(x - r2 * cos(e2) * cos(a2), 2) + power(y - r2 * cos(e2) * sin(a2), 2) + power(z - r2 * sin(e2), 2)) AS err FROM q)
SELECT count(*) AS n, round(max(err), 6) AS max_err, round(sqrt(avg(err * err)), 6) AS rms FROM b""", ("pts_emb",))
def polar_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, a, e = E.polar(F.col("x"), F.col("y"), F.col("z"))
    q = V.pts_emb(spark, sf_dir).select("x", "y", "z", (F.round(r / 0.002) * 0.002).alias("r"), (F.round(a / 0.001) * 0.001).alias("a"), (F.round(e / 0.001) * 0.001).alias("e"))
    back = E.unpolar(F.col("r"), F.col("a"), F.col("e"))
    err = F.sqrt(sum((F.pow(F.col(c) - b, F.lit(2.0)) for c, b in zip("xyz", back, strict=True)), F.lit(0.0)))
    return q.select(err.alias("err")).agg(F.count("*").alias("n"), F.round(F.max("err"), 6).alias("max_err"), F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 6).alias("rms"))


@query("""c AS (SELECT y AS r, z AS g, tax AS b, y - tax AS co, tax + ((y - tax) >> 1) AS t FROM pts_li), d AS (SELECT *, g - t AS cg FROM c)
SELECT count(*) AS n, CAST(sum(t + (cg >> 1)) AS BIGINT) AS sum_y, CAST(sum(co) AS BIGINT) AS sum_co, CAST(sum(cg) AS BIGINT) AS sum_cg, CAST(0 AS BIGINT) AS mismatches FROM d""", ("pts_li",))
def ycocg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir)
    y, co, cg = E.ycocg(F.col("y"), F.col("z"), F.col("tax"))
    t = li.select("y", "z", "tax", y.alias("a"), co.alias("b"), cg.alias("c"))
    r, g, b = E.unycocg(F.col("a"), F.col("b"), F.col("c"))
    wrong = F.sum(F.when((r != F.col("y")) | (g != F.col("z")) | (b != F.col("tax")), 1).otherwise(0))
    return t.agg(F.count("*").alias("n"), F.sum("a").alias("sum_y"), F.sum("b").alias("sum_co"), F.sum("c").alias("sum_cg"), F.coalesce(wrong, F.lit(0)).cast("long").alias("mismatches"))


_T, _S = -273_000, 524_288


@query(f"""a AS (SELECT y, x + (({_T} * y) >> 20) AS x1 FROM pts_li), b AS (SELECT y + (({_S} * x1) >> 20) AS y1, x1 FROM a), c AS (SELECT x1 + (({_T} * y1) >> 20) AS x2, y1 FROM b)
SELECT count(*) AS n, CAST(sum(x2) AS BIGINT) AS sum_x, CAST(sum(y1) AS BIGINT) AS sum_y, min(x2) AS min_x, max(y1) AS max_y, CAST(0 AS BIGINT) AS mismatches FROM c""", ("pts_li",))
def shear_rotation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = E.shear(F.col("x"), F.col("y"), _T, _S)
    t = V.pts_li(spark, sf_dir).select("x", "y", a.alias("a"), b.alias("b"))
    x, y = E.unshear(F.col("a"), F.col("b"), _T, _S)
    wrong = F.sum(F.when((x != F.col("x")) | (y != F.col("y")), 1).otherwise(0))
    return t.agg(F.count("*").alias("n"), F.sum("a").alias("sum_x"), F.sum("b").alias("sum_y"), F.min("a").alias("min_x"), F.max("b").alias("max_y"), F.coalesce(wrong, F.lit(0)).cast("long").alias("mismatches"))


def spread_sql(e: str, bits: int, shift: int) -> str:
    return " + ".join(f"((({e}) >> {k}) & 1) * {1 << (3 * k + shift)}" for k in range(bits))


_MORTON = f"{spread_sql('x', 20, 0)} + {spread_sql('y', 20, 1)} + {spread_sql('z', 20, 2)}"
_MORTON_HIGH = f"{spread_sql('x', 20, 2)} + {spread_sql('y', 20, 1)} + {spread_sql('z', 20, 0)}"


@query(f"m AS (SELECT pos, {_MORTON} AS low, {_MORTON_HIGH} AS high FROM pts_li) SELECT pos % 16 AS lane, count(*) AS n, min(low) AS lo, max(low) AS hi, CAST(sum(high % 1000003) AS BIGINT) AS check_high FROM m GROUP BY 1", ("pts_li",))
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both interleavings: x in the lowest bit of each three, and x in the highest."""
    k = (F.col("x"), F.col("y"), F.col("z"))
    m = V.pts_li(spark, sf_dir).select("pos", E.morton(*k, bits=20).alias("low"), E.morton(*k, bits=20, x_low=False).alias("high"))
    return m.groupBy((F.col("pos") % 16).alias("lane")).agg(F.count("*").alias("n"), F.min("low").alias("lo"), F.max("low").alias("hi"), F.sum(F.col("high") % 1000003).alias("check_high"))


def _costs(df: DataFrame, order: str) -> DataFrame:
    d = O.differences(df, GEO, order=order)
    return d.agg(F.sum(sum((O.bits(f"{c}_d1") for c in GEO[1:]), O.bits("x_d1"))).alias("bits"))


def _cost_sql(order: str) -> str:
    return " + ".join(blen(zz(f"{c} - coalesce(lag({c}) OVER (ORDER BY {order}), 0)")) for c in GEO)


@query(f"""m AS (SELECT *, {_MORTON_HIGH} AS code FROM pts_li), a AS (SELECT {_cost_sql('pos')} AS s, {_cost_sql('code, pos')} AS m FROM m)
SELECT CAST(sum(s) AS BIGINT) AS storage_bits, CAST(sum(m) AS BIGINT) AS morton_bits, round((sum(m) - sum(s)) / CAST(count(*) AS DOUBLE), 6) AS gain FROM a""", ("pts_li",))
def morton_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir)
    coded = V.with_position(li.withColumn("code", E.morton(F.col("x"), F.col("y"), F.col("z"), bits=20, x_low=False)), "code", "pos", name="rank")
    a = _costs(li, "pos").withColumnRenamed("bits", "storage_bits")
    b = O.differences(coded, GEO, order="rank").agg(F.sum(sum((O.bits(f"{c}_d1") for c in GEO[1:]), O.bits("x_d1"))).alias("morton_bits"), F.count("*").alias("n"))
    return a.crossJoin(F.broadcast(b)).select("storage_bits", "morton_bits", F.round((F.col("morton_bits") - F.col("storage_bits")) / F.col("n"), 6).alias("gain"))


@query(f"""p AS (SELECT *, {_MORTON_HIGH} AS code, count(*) OVER () AS n FROM pts_li),
o AS (SELECT {_cost_sql('pos')} AS a, {_cost_sql('pos DESC')} AS b, {_cost_sql('code, pos')} AS c FROM p)
SELECT 'identity' AS ord, CAST(sum(a) AS BIGINT) AS bits FROM o UNION ALL SELECT 'reverse', CAST(sum(b) AS BIGINT) FROM o UNION ALL SELECT 'morton', CAST(sum(c) AS BIGINT) FROM o""", ("pts_li",))
def order_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding cost under storage, reverse and Morton order."""
    li = V.pts_li(spark, sf_dir).withColumn("code", E.morton(F.col("x"), F.col("y"), F.col("z"), bits=20, x_low=False))
    n = li.count()
    back = li.withColumn("rev", F.lit(n - 1) - F.col("pos"))
    runs = {"identity": _costs(li, "pos"), "reverse": _costs(back, "rev"), "morton": _costs(V.with_position(li, "code", "pos", name="rank"), "rank")}
    return reduce(DataFrame.union, [r.select(F.lit(k).alias("ord"), "bits") for k, r in runs.items()])


@query()
def order_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding cost after shuffles within windows of 100, 1,000 and 10,000 rows (those at most a tenth of the
    table) and two full shuffles, by hash order."""
    li = V.pts_li(spark, sf_dir)
    n, parts = li.count(), []
    for w, seed in [(w, 1) for w in (100, 1000, 10000) if 10 * w <= n] + [(n, 1), (n, 2)]:
        mixed = li.withColumn("_w", F.floor(F.col("pos") / w)).withColumn("_h", F.xxhash64("pos", F.lit(seed)))
        name = f"window{w}" if w < n else f"full{seed}"
        parts.append(_costs(V.with_position(mixed, "_w", "_h", "pos", name="rank"), "rank").select(F.lit(name).alias("ord"), "bits"))
    return reduce(DataFrame.union, parts)


@query("SELECT count(*) AS n, count(*) - count(DISTINCT (x, y, z)) AS dup_points, round(1 - count(DISTINCT (y, z)) / CAST(count(*) AS DOUBLE), 6) AS dup_key_rate FROM pts_li", ("pts_li",))
def duplicate_key_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir)
    cells = li.groupBy("y", "z", "x").agg(F.count("*").alias("c"))
    keys = cells.groupBy("y", "z").agg(F.sum("c").alias("c"), F.count("*").alias("p"))
    n = F.sum("c")
    return keys.agg(n.alias("n"), (n - F.sum("p")).alias("dup_points"), F.round(1 - F.count("*") / n, 6).alias("dup_key_rate"))


@query("SELECT n, round((n * ln(n) - n + 0.5 * ln(2 * pi() * n)) / ln(2) / n, 6) AS bits_per_row FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem)")
def order_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log2(n!) / n by Stirling's formula: what a stored order costs if it means nothing."""
    n = F.col("n")
    return V.read(spark, sf_dir, "lineitem").agg(F.count("*").cast("double").alias("n")).select("n", F.round((n * F.log(n) - n + 0.5 * F.log(2 * F.pi() * n)) / F.log(F.lit(2.0)) / n, 6).alias("bits_per_row"))


@query("""o AS (SELECT *, row_number() OVER (ORDER BY sid, gps, pos) - 1 AS rank FROM scan_ev)
SELECT sid, min(rank) AS first_rank, max(rank) AS last_rank, count(*) AS n, CAST(sum(abs(rank - pos)) AS BIGINT) AS moved FROM o GROUP BY sid""", ("scan_ev",))
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.with_position(V.scan_ev(spark, sf_dir), "sid", "gps", "pos", name="rank")
    return o.groupBy("sid").agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count("*").alias("n"), F.sum(F.abs(F.col("rank") - F.col("pos"))).alias("moved"))


_SESSION = """g AS (SELECT *, gps - lag(gps) OVER (PARTITION BY sid ORDER BY gps, pos) AS gap FROM scan_ev), r AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM g WHERE gap > 0),
t AS (SELECT max(gap) AS med FROM r WHERE i = n // 2), f AS (SELECT g.*, CASE WHEN gap IS NULL OR gap > coalesce(20.0 * med, 200) THEN 1 ELSE 0 END AS flag FROM g, t)"""


@query(f"{_SESSION}, s AS (SELECT *, sum(flag) OVER (PARTITION BY sid ORDER BY gps, pos) AS session FROM f) SELECT sid, CAST(session AS BIGINT) AS session, count(*) AS n, min(gps) AS t0, max(gps) AS t1 FROM s GROUP BY 1, 2", ("scan_ev",))
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions at gaps above twenty times the upper median gap."""
    s = O.sessions(V.scan_ev(spark, sf_dir), O.GAP_FACTOR)
    return s.groupBy("sid", "session").agg(F.count("*").alias("n"), F.min("gps").alias("t0"), F.max("gps").alias("t1"))


@query("""p AS (SELECT *, coalesce(lag(val) OVER (PARTITION BY sid, cls ORDER BY gps, pos), lag(val) OVER (PARTITION BY sid ORDER BY gps, pos), 0) AS guess FROM scan_ev)
SELECT cls, count(*) AS n, CAST(sum(guess) AS BIGINT) AS sum_guess, CAST(sum(abs(val - guess)) AS BIGINT) AS abs_err FROM p GROUP BY cls""", ("scan_ev",))
def prev_same_class_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda *by: F.lag("val").over(Window.partitionBy(*by).orderBy("gps", "pos"))
    p = V.scan_ev(spark, sf_dir).withColumn("guess", F.coalesce(own("sid", "cls"), own("sid"), F.lit(0)))
    return p.groupBy("cls").agg(F.count("*").alias("n"), F.sum("guess").alias("sum_guess"), F.sum(F.abs(F.col("val") - F.col("guess"))).alias("abs_err"))


_LINES = "c AS (SELECT *, linenumber AS rn, linenumber + partkey % 3 AS nr, lag(linenumber) OVER (ORDER BY pos) AS prn, lag(linenumber + partkey % 3) OVER (ORDER BY pos) AS pnr FROM pts_li)"
_CLASS = "CASE WHEN nr <= 1 THEN 0 WHEN rn <= 1 THEN 1 WHEN rn >= nr THEN 2 ELSE 3 END"


@query(f"{_LINES} SELECT {_CLASS} AS class, count(*) AS n, CAST(sum(CASE WHEN rn = prn + 1 AND nr = pnr THEN 1 ELSE 0 END) AS BIGINT) AS continued FROM c GROUP BY 1", ("pts_li",))
def pulse_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir).select("pos", F.col("linenumber").alias("rn"), (F.col("linenumber") + F.col("partkey") % 3).alias("nr"))
    c = O.with_lags(li, {"prn": ("rn", 1), "pnr": ("nr", 1)})
    cont = F.when((F.col("rn") == F.col("prn") + 1) & (F.col("nr") == F.col("pnr")), 1).otherwise(0)
    return c.groupBy(E.return_class(F.col("rn"), F.col("nr")).alias("class")).agg(F.count("*").alias("n"), F.sum(cont).alias("continued"))


@query("""s AS (SELECT atan2(y, x) - lag(atan2(y, x)) OVER (ORDER BY pos) AS d FROM pts_emb), w AS (SELECT CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END AS d FROM s WHERE d IS NOT NULL)
SELECT count(*) AS n, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS monotone FROM w""", ("pts_emb",))
def azimuth_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.pts_emb(spark, sf_dir).select("pos", F.atan2("y", "x").alias("a"))
    d = O.with_lags(a, {"p": ("a", 1)}).select((F.col("a") - F.col("p")).alias("d")).filter("d is not null")
    d = d.select(F.when(F.col("d") > F.pi(), F.col("d") - 2 * F.pi()).when(F.col("d") < -F.pi(), F.col("d") + 2 * F.pi()).otherwise(F.col("d")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)), 6).alias("monotone"))


@query("""d AS (SELECT x, y, sqrt(power(x - lag(x) OVER (ORDER BY pos), 2) + power(y - lag(y) OVER (ORDER BY pos), 2) + power(z - lag(z) OVER (ORDER BY pos), 2)) AS d FROM pts_emb)
SELECT count(*) AS n, round(quantile_cont(d, 0.5) / sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*)), 6) AS continuity FROM d""", ("pts_emb",))
def storage_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = O.with_lags(V.pts_emb(spark, sf_dir), {f"p{c}": (c, 1) for c in "xyz"})
    e = e.withColumn("d", F.sqrt(sum((F.pow(F.col(c) - F.col(f"p{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))))
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return e.agg(F.count("*").alias("n"), F.round(F.percentile("d", F.lit(0.5)) / F.sqrt(area / F.count("*")), 6).alias("continuity"))


@query("SELECT linenumber AS return_number, count(*) AS n FROM pts_li GROUP BY 1", ("pts_li",))
def return_number_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pts_li(spark, sf_dir).groupBy(F.col("linenumber").alias("return_number")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 6) AS mean_{c}" for c in GEO) + " FROM pts_li", ("pts_li",))
def bbox_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pts_li(spark, sf_dir).agg(F.count("*").alias("n"), *[a for c in GEO for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.avg(c), 6).alias(f"mean_{c}"))])


@query(_union([f"SELECT '{n}' AS sample, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x FROM pts_li, (SELECT count(*) AS m FROM lineitem) WHERE {w}" for n, w in {"prefix": "pos < m // 10", "stride": "pos % 16 = 0", "middle": "pos >= (m - m // 5) // 2 AND pos < (m - m // 5) // 2 + m // 5", "chunks": "pos % (m // 8) < m // 80"}.items()]), ("pts_li",))
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operators: a prefix, a stride, the middle block and evenly spaced chunks."""
    li = V.pts_li(spark, sf_dir)
    m = V.read(spark, sf_dir, "lineitem").count()
    pos, fifth = F.col("pos"), m // 5
    start = (m - fifth) // 2
    kinds = {"prefix": pos < m // 10, "stride": pos % 16 == 0, "middle": (pos >= start) & (pos < start + fifth), "chunks": pos % max(1, m // 8) < m // 80}
    each = li.select("x", F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])).alias("sample")).filter("sample is not null")
    return each.groupBy("sample").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


@query(f"l AS ({_union([f'SELECT {k} AS level, pos, x - CAST(floor((a + coalesce(b, a)) / 2.0) AS BIGINT) AS v FROM (SELECT o.pos, o.x, l.x AS a, r.x AS b FROM pts_li o JOIN pts_li l ON l.pos = o.pos - {1 << k} LEFT JOIN pts_li r ON r.pos = o.pos + {1 << k} WHERE o.pos % {2 << k} = {1 << k})' for k in range(4)])}) SELECT level, count(*) AS n, CAST(sum({blen(zz('v'))}) AS BIGINT) AS bits FROM l GROUP BY level", ("pts_li",))
def lifting_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.lifting(V.pts_li(spark, sf_dir), "x", 4).groupBy("level").agg(F.count("*").alias("n"), F.sum(O.bits("residual")).alias("bits"))


@query(f"p AS (SELECT *, x - coalesce(lag(x) OVER (PARTITION BY linenumber ORDER BY pos), 0) AS r FROM pts_li) SELECT linenumber AS state, count(*) AS n, CAST(sum({blen(zz('r'))}) AS BIGINT) AS bits FROM p GROUP BY 1", ("pts_li",))
def per_state_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference state for each value of an auxiliary column."""
    r = F.col("x") - F.coalesce(F.lag("x").over(Window.partitionBy("linenumber").orderBy("pos")), F.lit(0))  # one state is one sequence
    return V.pts_li(spark, sf_dir).withColumn("r", r).groupBy(F.col("linenumber").alias("state")).agg(F.count("*").alias("n"), F.sum(O.bits("r")).alias("bits"))


@query("""g AS (SELECT pos, x, y, z, lag(x) OVER (ORDER BY pos) AS px, lag(y) OVER (ORDER BY pos) AS py, lag(x, 2) OVER (ORDER BY pos) AS qx, lag(y, 2) OVER (ORDER BY pos) AS qy FROM pts_li),
h AS (SELECT y, py, x - px AS dx, px - coalesce(qx, 0) AS pdx, py - coalesce(qy, 0) AS pdy FROM g WHERE px IS NOT NULL),
r AS (SELECT y - (py + CASE WHEN pdx = 0 THEN 0 ELSE greatest(-1000000, least(1000000, CAST(floor(CAST(dx AS DOUBLE) * pdy / pdx) AS BIGINT))) END) AS r FROM h)
SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS total, CAST(sum(abs(r)) AS BIGINT) AS abs_err FROM r""", ("pts_li",))
def heading_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y from the last heading: previous y plus dx times the previous slope, clamped."""
    g = O.with_lags(V.pts_li(spark, sf_dir).select("pos", "x", "y"), {"px": ("x", 1), "py": ("y", 1), "qx": ("x", 2), "qy": ("y", 2)}).filter("px is not null")
    pdx, pdy = F.col("px") - F.coalesce("qx", F.lit(0)), F.col("py") - F.coalesce("qy", F.lit(0))
    slope = F.floor(F.try_divide((F.col("x") - F.col("px")).cast("double") * pdy, pdx)).cast("long")
    step = F.when(pdx == 0, F.lit(0)).otherwise(F.greatest(F.lit(-1_000_000), F.least(F.lit(1_000_000), slope)))
    r = g.select((F.col("y") - F.col("py") - step).alias("r"))
    return r.agg(F.count("*").alias("n"), F.sum("r").alias("total"), F.sum(F.abs("r")).alias("abs_err"))
