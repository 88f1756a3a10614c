"""Further queries: slices, merges, geometry variants, decisions over cost tables, verification."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.operators import codecs as C
from gridloom.operators import dependencies as D
from gridloom.operators import entropy as H
from gridloom.operators import ordered as O
from gridloom.operators import spatial as S
from gridloom.plans.column_queries import COLS, GEO, blen, cond_sql, h_sql, lag, long_sql, zz
from gridloom.plans.dependency_queries import PLANTED, column_gcds
from gridloom.plans.registry import query
from gridloom.plans.spatial_queries import knn_sql
from gridloom.sources import views as V
from gridloom.sources.store import kept


@query("""o AS (SELECT *, row_number() OVER (ORDER BY sid, gps, pos) - 1 AS r, count(*) OVER () AS m FROM scan_ev), s AS (SELECT * FROM o WHERE r >= (m - m // 4) // 2 AND r < (m - m // 4) // 2 + m // 4),
d AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS new_pos FROM s) SELECT sid, count(*) AS n, min(new_pos) AS first_pos, CAST(sum(new_pos) AS BIGINT) AS sum_pos FROM d GROUP BY sid""", ("scan_ev",))
def contiguous_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle quarter in acquisition order (source, time), put back in storage order."""
    o = V.with_position(V.scan_ev(spark, sf_dir), "sid", "gps", "pos", name="r")
    n = o.count()
    start = (n - n // 4) // 2
    s = V.with_position(o.filter((F.col("r") >= start) & (F.col("r") < start + n // 4)), "pos", name="new_pos")
    return s.groupBy("sid").agg(F.count("*").alias("n"), F.min("new_pos").alias("first_pos"), F.sum("new_pos").alias("sum_pos"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM lineitem")
def canonical_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of one cloud in different orders, aligned by their rank in Morton order and compared."""
    return merged(V.pts_li(spark, sf_dir).select("pos", *GEO))


def merged(a: DataFrame) -> DataFrame:
    """(n, mismatches) of a cloud (pos, x, y, z) and its copy in another order. Points of one code are ordered by their
    coordinates: a code has 20 bits of each, so further points can share it."""
    code = E.morton(F.col("x"), F.col("y"), F.col("z"), bits=20)
    a = kept(a.withColumn("code", code))
    b = a.withColumn("pos", F.xxhash64("pos"))
    a, b = (V.with_position(t, "code", *GEO, "pos", name="rank") for t in (a, b))
    both = a.join(b.select("rank", *[F.col(c).alias(f"o{c}") for c in GEO]), "rank", "full_outer")
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"o{c}")) for c in GEO])
    return both.agg(F.count("*").alias("n"), F.coalesce(F.sum((~same).cast("long")), F.lit(0)).alias("mismatches"))


@query(f"""k AS ({knn_sql(7)}), c AS (SELECT k.pos, npos, row_number() OVER (PARTITION BY k.pos ORDER BY rank) AS r FROM k WHERE npos < k.pos),
f AS (SELECT pos, CAST(round(x * 100) AS BIGINT) AS v FROM pts_emb), p AS (SELECT c.pos, sum(f.v) AS s, count(*) AS c FROM c JOIN f ON f.pos = c.npos WHERE r <= 3 GROUP BY c.pos),
l AS (SELECT 'plain' AS col, v FROM f UNION ALL SELECT 'spatial', f.v - CAST(CASE WHEN s >= 0 THEN floor((2.0 * s + c) / (2 * c)) ELSE -floor((-2.0 * s + c) / (2 * c)) END AS BIGINT) FROM f JOIN p USING (pos)) {h_sql('l')}""", ("pts_emb",))
def spatial_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a column and of what neighbours that come earlier leave of it."""
    e = V.pts_emb(spark, sf_dir)
    v = e.select("pos", F.round(F.col("x") * 100).cast("long").alias("v"))
    near = S.knn(e, e, 7, same=True).filter("npos < pos")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("rank"))).filter("r <= 3")
    g = near.join(v.select(F.col("pos").alias("npos"), F.col("v").alias("nv")), "npos").groupBy("pos").agg(E.mean_round(F.sum("nv"), F.count("*")).alias("g"))
    both = v.join(g, "pos", "left")
    return H.order0(both, {"plain": "v", "spatial": F.col("v") - F.col("g")})


def real_step(df: DataFrame, col: str, rounds: int = 6) -> float:
    """The step of a column whose distinct values lie near multiples of it: from the median gap by repeated division
    of the gaps by their rounded multiples, then a least-squares polish over all rows."""
    u = V.with_position(df.select(F.col(col).alias("v")).distinct(), "v")
    gaps = kept(O.with_lags(u, {"p": ("v", 1)}).select((F.col("v") - F.col("p")).alias("g")).filter("g > 1e-9"))
    step = gaps.agg(F.min("g")).first()[0]
    for _ in range(rounds):
        k = F.greatest(F.lit(1.0), F.round(F.col("g") / step))
        near = gaps.filter(F.abs(F.col("g") - k * step) < 0.25 * step)
        s, n = near.agg(F.sum("g"), F.sum(k)).first()
        if not n:
            break
        step = s / n
    for _ in range(3):
        k = F.round(F.col(col) / step)
        a, b = df.agg(F.sum(F.col(col) * k), F.sum(k * k)).first()
        step = a / b if b else step
    return step


@query("SELECT 'l_extendedprice' AS col, CAST(0.01 AS DOUBLE) AS step UNION ALL SELECT 'l_discount', CAST(0.01 AS DOUBLE)")
def real_gcd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.read(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(c, round(real_step(li, c), 9)) for c in ("l_extendedprice", "l_discount")], "col string, step double")


@query("""s AS (SELECT atan2(y, x) - lag(atan2(y, x)) OVER (ORDER BY pos) AS d FROM pts_emb), w AS (SELECT CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END AS d FROM s WHERE d IS NOT NULL),
m AS (SELECT avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS up, quantile_cont(d, 0.5) AS med FROM w) SELECT round(up, 6) AS monotone, round(med, 6) AS median_step, up >= 0.95 AND med > 0 AS spinning FROM m""", ("pts_emb",))
def spinning_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.pts_emb(spark, sf_dir).select("pos", F.atan2("y", "x").alias("a"))
    d = O.with_lags(a, {"p": ("a", 1)}).select((F.col("a") - F.col("p")).alias("d")).filter("d is not null")
    d = d.select(F.when(F.col("d") > F.pi(), F.col("d") - 2 * F.pi()).when(F.col("d") < -F.pi(), F.col("d") + 2 * F.pi()).otherwise(F.col("d")).alias("d"))
    m = d.agg(F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("up"), F.percentile("d", F.lit(0.5)).alias("med"))
    return m.select(F.round("up", 6).alias("monotone"), F.round("med", 6).alias("median_step"), ((F.col("up") >= 0.95) & (F.col("med") > 0)).alias("spinning"))


@query("SELECT 's12' AS col, CAST(list_reduce(list(12 * suppkey), lambda a, b: gcd(a, b)) AS BIGINT) AS gcd, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM pts_li", ("pts_li",))
def column_grid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column divided by its greatest common divisor and restored."""
    li = V.pts_li(spark, sf_dir).select((12 * F.col("suppkey")).alias("s12"))
    g = column_gcds(li, ["s12"]).first()["gcd"]
    small = li.withColumn("q", E.floor_div(F.col("s12"), g))
    return small.agg(F.lit("s12").alias("col"), F.lit(g).cast("long").alias("gcd"), F.count("*").alias("n"), F.sum((F.col("q") * g != F.col("s12")).cast("long")).alias("mismatches"))


_ATTR = ["z", "tax", "linenumber", "shipday"]


def _attr_sql() -> str:
    l = long_sql({f"{c}:raw": c for c in _ATTR} | {f"{c}:delta": f"{c} - {lag(c)}" for c in _ATTR}, "pts_li")
    return f"l AS ({l}), h AS ({h_sql('l')}), s AS (SELECT split_part(col, ':', 1) AS col, split_part(col, ':', 2) AS kind, h FROM h)"


def _attr_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.differences(V.pts_li(spark, sf_dir), _ATTR)
    h = H.order0(d, {f"{c}:raw": c for c in _ATTR} | {f"{c}:delta": f"{c}_d1" for c in _ATTR})
    return h.select(F.substring_index("col", ":", 1).alias("col"), F.substring_index("col", ":", -1).alias("kind"), "h")


@query(_attr_sql() + " SELECT col, min(h) AS h, min_by(kind, h) AS best FROM s GROUP BY col", ("pts_li",))
def attribute_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheaper of raw values and differences for each attribute."""
    return _attr_costs(spark, sf_dir).groupBy("col").agg(F.min("h").alias("h"), F.min_by("kind", "h").alias("best"))


@query(_attr_sql() + ", b AS (SELECT col, min(h) AS h FROM s GROUP BY col) SELECT col, round((SELECT sum(h) FROM b) - h, 6) AS without, round(h, 6) AS marginal FROM b", ("pts_li",))
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total cost without each attribute."""
    b = _attr_costs(spark, sf_dir).groupBy("col").agg(F.min("h").alias("h"))
    return b.crossJoin(F.broadcast(b.agg(F.sum("h").alias("t")))).select("col", F.round(F.col("t") - F.col("h"), 6).alias("without"), F.round("h", 6).alias("marginal"))


_DROPS = {f"{k}": " UNION ALL ".join(f"SELECT '{c}' AS col, {v} - coalesce(lag({v}) OVER (ORDER BY pos), 0) AS v FROM pts_li" for c in GEO for v in [c if k == 0 else f"(({c} + {1 << (k - 1)}) >> {k})"]) for k in range(4)}


@query(", ".join(f"l{k} AS ({s}), h{k} AS ({h_sql(f'l{k}')})" for k, s in _DROPS.items()) + ", t AS (" + " UNION ALL ".join(f"SELECT {k} AS dropped, sum(h) AS bits FROM h{k}" for k in _DROPS) + ") SELECT CAST(dropped AS INTEGER) AS dropped, round(bits, 6) AS bits, round(100 * (1 - bits / (SELECT bits FROM t WHERE dropped = 0)), 6) AS saved_percent, 0.01 * power(2, dropped) / 2 AS max_err FROM t", ("pts_li",))
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision against size: bits a row, share saved and the error bound for each number of dropped bits."""
    names = {f"{c}_{k}": E.drop_bits(F.col(c), k) for c in GEO for k in range(4)}
    d = O.differences(V.pts_li(spark, sf_dir).select("pos", *[e.alias(n) for n, e in names.items()]), list(names))
    h = H.order0(d, {n: f"{n}_d1" for n in names}).select(F.substring_index("col", "_", -1).cast("int").alias("dropped"), "h")
    t = h.groupBy("dropped").agg(F.sum("h").alias("bits"))
    whole = t.filter("dropped = 0").select(F.col("bits").alias("b0"))
    return t.crossJoin(F.broadcast(whole)).select("dropped", F.round("bits", 6).alias("bits"), F.round(100 * (1 - F.col("bits") / F.col("b0")), 6).alias("saved_percent"), (0.01 * F.pow(F.lit(2.0), "dropped") / 2).alias("max_err"))


@query()
def plan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate descent over the plan: a step is put back while that makes the total cheaper; three rounds at most."""
    p = kept(V.planted(spark, sf_dir).select("pos", *PLANTED))
    plan = D.analyze(p, PLANTED)

    def total(steps: list[D.Step]) -> float:
        kept = D.apply(p, steps)
        cols = [c for c in kept.columns if c != "pos"]
        return sum(r.bits for r in C.choice(C.costs(kept, cols, ["order0", "delta"])).collect())

    best, rows = total(plan), [("start", len(plan), 0.0)]
    rows[0] = ("start", len(plan), best)
    for _ in range(3):
        tries = [(total([s for s in plan if s is not x]), x) for x in plan if x.kind == "residual"]
        better = [t for t in tries if t[0] < best - 1e-9]
        if not better:
            break
        best, gone = min(better, key=lambda t: t[0])
        plan = [s for s in plan if s is not gone]
        rows.append((f"put back {gone.target}", len(plan), best))
    return spark.createDataFrame(rows, "step string, operations int, bits double")


def _geometry_sql() -> str:
    d = {c: f"({c} - {lag(c)})" for c in GEO}
    base = f"g AS (SELECT pos, {', '.join(f'{e} AS d{c}' for c, e in d.items())}, linenumber FROM pts_li), f AS (SELECT *, {', '.join(f'coalesce(lag(d{c}) OVER (ORDER BY pos), 0) AS p{c}' for c in GEO)} FROM g)"
    pairs = {}
    for c in GEO:
        pairs[f"v0:{c}"] = (zz(f"d{c}"), f"least({blen(zz(f'p{c}'))}, 23)")
        pairs[f"aux:{c}"] = (zz(f"d{c}"), "linenumber")
        pairs[f"shift:{c}"] = (zz(f"d{c}"), f"least({blen(zz(f'p{c}'))}, 23) >> 1")
    return f"{base.replace('g AS (', 'g0 AS (', 1).replace('FROM g)', 'FROM g0)')}, {cond_sql('f', pairs)}"


@query(_geometry_sql(), ("pts_li",))
def geometry_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate differences under the contexts of the geometry codecs: size of the last one, an auxiliary column,
    and a coarser size."""
    d = O.differences(V.pts_li(spark, sf_dir), GEO).select("pos", "linenumber", *[F.col(f"{c}_d1").alias(f"d{c}") for c in GEO])
    d = O.with_lags(d, {f"p{c}": (f"d{c}", 1) for c in GEO})
    pairs = {}
    for c in GEO:
        size = E.bucket(E.zigzag(F.coalesce(f"p{c}", F.lit(0))))
        z = E.zigzag(F.col(f"d{c}"))
        pairs |= {f"v0:{c}": (z, size), f"aux:{c}": (z, F.col("linenumber")), f"shift:{c}": (z, F.shiftright(size, 1))}
    return H.conditional(d, pairs)


_MATCH = {c: (f"{blen(zz(f'd_{c}'))}", " * 32 + ".join(f"least({blen(zz(f'coalesce(lag(d_{c}, {j}) OVER (ORDER BY pos), 0)'))}, 23)" for j in (1,)) + " + " + " + ".join(f"{32**(j - 1)} * least({blen(zz(f'coalesce(lag(d_{c}, {j}) OVER (ORDER BY pos), 0)'))}, 23)" for j in (2, 3))) for c in GEO}


@query(f"d AS (SELECT pos, {', '.join(f'{c} - {lag(c)} AS d_{c}' for c in GEO)} FROM pts_li), {cond_sql('d', _MATCH)}", ("pts_li",))
def match_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a difference given the sizes of the last three."""
    d = O.differences(V.pts_li(spark, sf_dir), GEO).select("pos", *[f"{c}_d1" for c in GEO])
    d = O.with_lags(d, {f"m_{c}{j}": (f"{c}_d1", j) for c in GEO for j in (1, 2, 3)})
    size = lambda c: E.bucket(E.zigzag(F.coalesce(c, F.lit(0))))
    return H.conditional(d, {c: (E.bitlen(E.zigzag(F.col(f"{c}_d1"))), size(f"m_{c}1") + 32 * size(f"m_{c}2") + 1024 * size(f"m_{c}3")) for c in GEO})


@query("""q AS (SELECT max(CASE WHEN i = n // 4 THEN v END) AS q1, max(CASE WHEN i = n // 2 THEN v END) AS q2, max(CASE WHEN i = n * 3 // 4 THEN v END) AS q3 FROM (SELECT partkey AS v, row_number() OVER (ORDER BY partkey) - 1 AS i, count(*) OVER () AS n FROM pts_li)),
k AS (SELECT z, (CASE WHEN partkey > q1 THEN 1 ELSE 0 END) + (CASE WHEN partkey > q2 THEN 1 ELSE 0 END) + (CASE WHEN partkey > q3 THEN 1 ELSE 0 END) AS cls FROM pts_li, q), """ + cond_sql("k", {"z|class": ("z", "cls")}), ("pts_li",))
def class_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column given the quartile class of another."""
    li = V.pts_li(spark, sf_dir)
    cuts = [O.order_statistic(li, "partkey", q) for q in (0.25, 0.5, 0.75)]
    k = sum((F.when(F.col("partkey") > c, 1).otherwise(0) for c in cuts if c is not None), F.lit(0))
    return H.conditional(li, {"z|class": ("z", k)})


@query("q AS (SELECT pos, x, CAST(round(x / 0.02) AS BIGINT) * 0.02 AS cx, y, CAST(round(y / 0.02) AS BIGINT) * 0.02 AS cy, z, CAST(round(z / 0.02) AS BIGINT) * 0.02 AS cz, label FROM pts_emb), e AS (SELECT pos, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) AS err FROM q) SELECT count(*) AS n, CAST(0 AS BIGINT) AS attribute_mismatches, round(max(err), 9) AS max_err, max(err) <= 0.0174 AS within FROM e", ("pts_emb",))
def close_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lossy copy against its source: attributes must be equal, coordinates within the bound."""
    a = V.pts_emb(spark, sf_dir)
    b = a.select("pos", *[(E.quantize(F.col(c), 0.02) * 0.02).alias(f"b{c}") for c in "xyz"], F.col("label").alias("l2"))
    both = a.join(b, "pos")
    err = F.sqrt(sum(((F.col(c) - F.col(f"b{c}")) * (F.col(c) - F.col(f"b{c}")) for c in "yz"), (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx"))))
    return both.agg(F.count("*").alias("n"), F.sum((F.col("label") != F.col("l2")).cast("long")).alias("attribute_mismatches"), F.round(F.max(err), 9).alias("max_err"), (F.max(err) <= 0.0174).alias("within"))


@query("r AS (SELECT linenumber AS rn, count(*) AS n FROM pts_li GROUP BY 1) SELECT rn AS return_number, n, n + CASE WHEN rn % 2 = 0 THEN 1 ELSE 0 END AS declared, rn % 2 = 0 AS override FROM r", ("pts_li",))
def header_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared counts by return number against a recount; only those that differ would be stored."""
    r = V.pts_li(spark, sf_dir).groupBy(F.col("linenumber").alias("return_number")).agg(F.count("*").alias("n"))
    d = r.withColumn("declared", F.col("n") + F.when(F.col("return_number") % 2 == 0, 1).otherwise(0))
    return d.withColumn("override", F.col("n") != F.col("declared"))


@query("""p AS (SELECT sqrt(x*x + y*y + z*z) AS r FROM pts_emb), u AS (SELECT DISTINCT round(r, 4) AS v FROM p), g AS (SELECT round((v - lag(v) OVER (ORDER BY v)) * 10000) AS gap FROM u)
SELECT count(*) AS gaps, CAST(min(gap) AS BIGINT) AS least, round(avg(gap), 6) AS mean FROM g WHERE gap IS NOT NULL""", ("pts_emb",))
def polar_quantum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between distinct ranges, in ten-thousandths."""
    r, _, _ = E.polar(F.col("x"), F.col("y"), F.col("z"))
    u = V.with_position(V.pts_emb(spark, sf_dir).select(F.round(r, 4).alias("v")).distinct(), "v")
    g = O.with_lags(u, {"p": ("v", 1)}).select(F.round((F.col("v") - F.col("p")) * 10000).alias("gap")).filter("gap is not null")
    return g.agg(F.count("*").alias("gaps"), F.min("gap").cast("long").alias("least"), F.round(F.avg("gap"), 6).alias("mean"))


@query("l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM pts_li" for c in COLS) + ") SELECT col, CAST((max(v) - min(v)) AS BIGINT) AS span, CAST(sum(CASE WHEN v < 128 AND v >= 0 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS varint_bytes FROM l GROUP BY col", ("pts_li",))
def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a column in 7-bit groups."""
    v = F.col("v")
    size = F.when((v < 128) & (v >= 0), 1)
    for k in (2, 3, 4):
        size = size.when(v < 1 << (7 * k), k)
    each = H.unpivot(V.pts_li(spark, sf_dir), {c: c for c in COLS})
    return each.groupBy("col").agg((F.max("v") - F.min("v")).alias("span"), F.sum(size.otherwise(5)).alias("varint_bytes"))


@query(f"s AS (SELECT pos, CAST(floor(65536 * tan((pos % 1000) * {math.pi / 4000!r}) + 0.5) AS BIGINT) AS t FROM pts_li) SELECT pos % 10 AS lane, CAST(sum(t) AS BIGINT) AS total FROM s GROUP BY 1", ("pts_li",))
def integer_tangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tangent in 16-bit fixed point."""
    t = F.floor(65536 * F.tan((F.col("pos") % 1000) * (math.pi / 4000)) + 0.5).cast("long")
    return V.pts_li(spark, sf_dir).groupBy((F.col("pos") % 10).alias("lane")).agg(F.sum(t).alias("total"))
