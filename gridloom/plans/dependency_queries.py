"""Queries on dependencies, value grids, representation costs and verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.operators import codecs as C
from gridloom.operators import dependencies as D
from gridloom.operators import entropy as H
from gridloom.plans.column_queries import COLS, blen, h_sql, lag, long_sql, med3, zz
from gridloom.plans.registry import query
from gridloom.sources import views as V
from gridloom.sources.store import kept

PLANTED = ["partkey", "suppkey", "linenumber", "k7", "dup", "aff", "res"]
PVIEWS = ("pts_li", "planted")
PAIRS = [(PLANTED[j], PLANTED[i]) for j in range(len(PLANTED)) for i in range(j)]


def _u(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("c AS (" + _u([f"SELECT '{c}' AS col, min({c}) AS lo, max({c}) AS hi FROM planted" for c in PLANTED]) + ") SELECT col, lo AS value FROM c WHERE lo = hi", PVIEWS)
def detect_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.constants(V.planted(spark, sf_dir), PLANTED)
    return spark.createDataFrame(list(found.items()), "col string, value long")


@query("c AS (" + _u([f"SELECT '{a}' AS target, '{b}' AS source, bool_and({a} = {b}) AS same FROM planted" for a, b in PAIRS]) + ") SELECT target, source FROM c WHERE same", PVIEWS)
def detect_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(D.duplicates(V.planted(spark, sf_dir), PLANTED), "target string, source string")


_AFF = [(a, b) for a, b in PAIRS if "k7" not in (a, b)]
_DENS = "".join(f" WHEN abs(s * {d} - round(s * {d})) < 0.001 * greatest(1, abs(round(s * {d}))) AND round(s * {d}) <> 0 THEN {d}" for d in D.DENOMINATORS)


@query("s AS (" + _u([f"SELECT '{a}' AS target, '{b}' AS source, regr_slope({a}, {b}) AS s FROM planted" for a, b in _AFF]) + f"""), d AS (SELECT *, CASE{_DENS} END AS den FROM s), t AS (SELECT target, source, CAST(den AS BIGINT) AS den, CAST(round(s * den) AS BIGINT) AS num FROM d WHERE den IS NOT NULL),
p AS ({_u([f"SELECT target, source, num, den, min({a} * den - {b} * num) AS lo, max({a} * den - {b} * num) AS hi FROM planted, t WHERE target = '{a}' AND source = '{b}' GROUP BY ALL" for a, b in _AFF])})
SELECT target, source, num, den, CAST(lo AS BIGINT) AS b FROM p WHERE lo = hi""", PVIEWS)
def detect_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = D.affines(V.planted(spark, sf_dir), [c for c in PLANTED if c != "k7"])
    return spark.createDataFrame([(s.target, s.source, s.num, s.den, s.b) for s in steps], "target string, source string, num long, den long, b long")


_RES = ["partkey", "suppkey", "linenumber", "res"]


@query(f"""l AS ({long_sql({c: c for c in _RES} | {f'{_RES[j]}-{_RES[i]}': f'{_RES[j]} - {_RES[i]}' for j in range(len(_RES)) for i in range(j)}, 'planted')}), h AS ({h_sql('l')}),
d AS (SELECT split_part(col, '-', 1) AS target, split_part(col, '-', 2) AS source, h FROM h WHERE contains(col, '-')), b AS (SELECT d.target, min((d.h, d.source)) AS m, any_value(h.h) AS h FROM d JOIN h ON h.col = d.target GROUP BY d.target)
SELECT target, struct_extract(m, 2) AS source, h, struct_extract(m, 1) AS h_diff FROM b WHERE h - struct_extract(m, 1) >= 1""", PVIEWS)
def detect_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(D.residuals(V.planted(spark, sf_dir), _RES), "target string, source string, h double, h_diff double")


@query(_u([f"SELECT '{c}' AS col, CAST(0 AS BIGINT) AS mismatches, CAST(NULL AS BIGINT) AS first_pos FROM (SELECT 1)" for c in PLANTED]))
def plan_apply_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discovered plan applied, inverted and compared row by row."""
    p = kept(V.planted(spark, sf_dir).select("pos", *PLANTED))
    plan = D.analyze(p, PLANTED)
    return D.differences_between(p, D.invert(D.apply(p, plan), plan), PLANTED)


@query()
def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kept(V.planted(spark, sf_dir).select("pos", *PLANTED))
    return D.plan_rows(p, D.analyze(p, PLANTED))


_MONEY = {"l_extendedprice": "lineitem", "l_discount": "lineitem", "l_tax": "lineitem", "p_retailprice": "part"}


@query("c AS (" + _u([f"SELECT '{c}' AS col, {k} AS decimals, bool_and(round({c} * {10**k}) / {10**k} = {c}) AS exact, count(*) AS n FROM {t}" for c, t in _MONEY.items() for k in range(0, 5)]) + ") SELECT col, CAST(min(decimals) AS INTEGER) AS decimals, any_value(n) AS n FROM c WHERE exact GROUP BY col")
def float_grid_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarsest decimal grid on which every value of a column lies, proved over all rows: k / 10**d
    must give the very value back."""
    out = []
    for c, t in _MONEY.items():
        df = V.read(spark, sf_dir, t)
        ok = [F.min((F.round(F.col(c) * 10**k) / float(10**k) == F.col(c)).cast("int")).alias(f"d{k}") for k in range(5)]
        r = df.agg(F.count("*").alias("n"), *ok)
        first = reduce(lambda a, k: F.when(F.col(f"d{k}") == 1, k).otherwise(a), range(4, -1, -1), F.lit(None))
        out.append(r.select(F.lit(c).alias("col"), first.cast("int").alias("decimals"), "n").filter("decimals is not null"))
    return reduce(DataFrame.union, out)


@query(_u([f"SELECT CAST({s} AS DOUBLE) AS step, round(sqrt(power(sum(cos(2 * pi() * l_extendedprice / {s})), 2) + power(sum(sin(2 * pi() * l_extendedprice / {s})), 2)) / count(*), 6) AS gridness FROM lineitem" for s in (0.01, 0.05, 0.03, 1.0)]))
def gridness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean resultant of the phases of a column at each step: 1 on the grid, near 0 off it."""
    p = V.read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v"))
    each = p.select("v", F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.03, 1.0)))).alias("step")).select("step", (2 * F.pi() * F.col("v") / F.col("step")).alias("t"))
    r = F.sqrt(F.pow(F.sum(F.cos("t")), F.lit(2.0)) + F.pow(F.sum(F.sin("t")), F.lit(2.0))) / F.count("*")
    return each.groupBy("step").agg(F.round(r, 6).alias("gridness"))


def column_gcds(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, gcd) of absolute values: one number from each batch, then one from each column."""

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"col": cols, "g": [int(np.gcd.reduce(np.abs(p[c].dropna().to_numpy()))) if len(p) else 0 for c in cols]})

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"col": p["col"].iloc[:1], "gcd": [math.gcd(*p["g"].tolist())]})

    return df.select(*cols).mapInPandas(part, "col string, g long").distinct().groupBy("col").applyInPandas(whole, "col string, gcd long")


@query(_u([f"SELECT '{n}' AS col, CAST(list_reduce(list(abs({e})), lambda a, b: gcd(a, b)) AS BIGINT) AS gcd FROM pts_li" for n, e in {"x": "x", "y5": "5 * y", "s12": "12 * suppkey"}.items()]), ("pts_li",))
def column_gcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.pts_li(spark, sf_dir).select("x", (5 * F.col("y")).alias("y5"), (12 * F.col("suppkey")).alias("s12"))
    return column_gcds(li, ["x", "y5", "s12"])


def _xref_sql() -> str:
    cols = ["y", "z", "tax", "partkey", "suppkey", "linenumber"]
    l = long_sql({f"{a}-{b}": f"{a} - {b}" for a in cols for b in cols if a != b}, "pts_li")
    return f"l AS ({l}), h AS ({h_sql('l')}), r AS (SELECT split_part(col, '-', 1) AS target, split_part(col, '-', 2) AS ref, h, row_number() OVER (PARTITION BY split_part(col, '-', 1) ORDER BY h, split_part(col, '-', 2)) AS rank FROM h) SELECT target, ref, h, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4"


@query(_xref_sql(), ("pts_li",))
def xref_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best reference columns of each column, by entropy of the difference."""
    cols = ["y", "z", "tax", "partkey", "suppkey", "linenumber"]
    h = H.order0(V.pts_li(spark, sf_dir), {f"{a}-{b}": F.col(a) - F.col(b) for a in cols for b in cols if a != b})
    h = h.select(F.substring_index("col", "-", 1).alias("target"), F.substring_index("col", "-", -1).alias("ref"), "h")
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("h", "ref"))).filter("rank <= 4").select("target", "ref", "h", "rank")


CHOSEN = ["x", "y", "z", "partkey", "linenumber"]


def _codec_sql() -> str:
    parts, sel = [], []
    for c in CHOSEN:
        l = lambda k, c=c: f"l{k}"
        d = [f"({c} - l1)", "(l1 - l2)", "(l2 - l3)", "(l3 - l4)"]
        med = f"(CASE WHEN pos >= 3 THEN {med3(d[1], d[2], d[3])} WHEN pos >= 1 THEN {d[1]} ELSE 0 END)"
        parts.append(f"v_{c} AS (SELECT pos, {c}, {', '.join(f'{lag(c, k)} AS l{k}' for k in range(1, 5))} FROM pts_li)")
        kinds = {"order0": (zz(c), "0"), "delta": (zz(d[0]), "0"), "ctx": (zz(d[0]), f"least({blen(zz(d[1]))}, 23)"), "ctx2": (zz(f"({d[0]} - {d[1]})"), f"least({blen(zz(f'({d[1]} - {d[2]})'))}, 23)"), "med3": (zz(f"({c} - l1 - {med})"), "0"), "prev": (zz(c), "l1 & 255")}
        sel += [f"SELECT '{c}' AS col, '{n}' AS codec, {a} AS a, {x} AS c FROM v_{c}" for n, (a, x) in kinds.items()]
    width = _u([f"SELECT '{c}' AS col, max({c}) - min({c}) AS span FROM pts_li" for c in CHOSEN])
    return f"""{', '.join(parts)}, e AS ({_u(sel)}), k AS (SELECT col, codec, a, c, count(*) AS k FROM e GROUP BY ALL), p AS (SELECT col, codec, c, sum(k) AS k, sum(k * log2(k)) AS t FROM k GROUP BY ALL), w AS ({width}),
costs AS (SELECT col, codec, round((sum(k * log2(k)) - sum(t)) / sum(k), 6) AS bits FROM p GROUP BY ALL UNION ALL SELECT col, 'width', CAST(CASE WHEN span = 0 THEN 0 WHEN span < 256 THEN 8 WHEN span < 65536 THEN 16 WHEN span < 4294967296 THEN 32 ELSE 64 END AS DOUBLE) FROM w UNION ALL SELECT col, 'raw64', 64.0 FROM w)"""


@query(_codec_sql() + " SELECT col, codec, bits FROM costs", ("pts_li",))
def codec_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.costs(V.pts_li(spark, sf_dir), CHOSEN)


@query(_codec_sql() + ", m AS (SELECT col, min((bits, codec)) AS m FROM costs GROUP BY col) SELECT col, struct_extract(m, 2) AS codec, struct_extract(m, 1) AS bits FROM m", ("pts_li",))
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.choice(C.costs(V.pts_li(spark, sf_dir), CHOSEN))


@query(_u([f"SELECT '{c}' AS col, '{k}' AS codec, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM lineitem" for c in ("x", "z") for k in C.STREAMS]))
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns coded to bytes block by block under every codec, decoded and compared."""
    li = kept(V.pts_li(spark, sf_dir).select("pos", "x", "z"))
    old = li.select("pos", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("o")) for c in ("x", "z")])).alias("s")).select("pos", "s.*")
    parts = []
    for codec in C.STREAMS:
        both = old.join(C.restored(C.streams(li, ["x", "z"], 8192, codec)), ["col", "pos"], "full_outer")
        parts.append(both.groupBy("col").agg(F.lit(codec).alias("codec"), F.count("o").alias("n"), F.sum((~F.col("o").eqNullSafe(F.col("v"))).cast("long")).alias("mismatches")))
    return reduce(DataFrame.union, parts)


@query()
def stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the coded streams by column, under the codec that costs it least."""
    s = C.best_streams(kept(V.pts_li(spark, sf_dir).select("pos", "x", "y", "z", "linenumber")), ["x", "y", "z", "linenumber"], 65_536)
    return s.groupBy("col", "codec").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n"), F.sum(F.octet_length("data")).alias("bytes"))


@query("""a AS (SELECT y, z, count(*) AS c FROM pts_li GROUP BY ALL), b AS (SELECT y, z, count(*) AS c FROM pts_li WHERE pos % 2 = 0 GROUP BY ALL)
SELECT CAST(coalesce(sum(greatest(a.c - coalesce(b.c, 0), 0)), 0) AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM a LEFT JOIN b USING (y, z)""", ("pts_li",))
def multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one multiset has beyond the other (here: the table against its even rows)."""
    li = V.pts_li(spark, sf_dir)
    side = lambda df, w: df.select("y", "z", F.lit(w).alias("w"))
    d = side(li, 1).union(side(li.filter("pos % 2 = 0"), -1)).groupBy("y", "z").agg(F.sum("w").alias("w"))
    return d.agg(F.coalesce(F.sum(F.greatest("w", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("w"), F.lit(0))), F.lit(0)).alias("only_right"))


@query("SELECT 'x' AS col, CAST(sum(CASE WHEN pos % 1000 = 999 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, min(CASE WHEN pos % 1000 = 999 THEN pos END) AS first_pos FROM pts_li UNION ALL SELECT 'y', CAST(0 AS BIGINT), CAST(NULL AS BIGINT)", ("pts_li",))
def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact comparison, against a copy in which every thousandth value was changed."""
    li = V.pts_li(spark, sf_dir)
    other = li.withColumn("x", F.col("x") + F.when(F.col("pos") % 1000 == 999, 1).otherwise(0))
    return D.differences_between(li, other, ["x", "y"])


@query(f"h AS (SELECT col, h FROM ({h_sql('l')})) SELECT * FROM h".replace("h AS", f"l AS ({long_sql({c: c for c in COLS}, 'pts_li')} UNION ALL {long_sql({f'd:{c}': f'{c} - {lag(c)}' for c in COLS}, 'pts_li')}), h AS", 1), ("pts_li",))
def field_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of every field as it stands and of its differences."""
    from gridloom.operators.ordered import differences

    d = differences(V.pts_li(spark, sf_dir), COLS)
    return H.order0(d, {c: c for c in COLS} | {f"d:{c}": f"{c}_d1" for c in COLS}).select("col", "h")


@query("""w AS (SELECT CAST(l_partkey AS HUGEINT) * 4611686018427387 + l_suppkey - 9000000000000000000 AS v, l_suppkey AS g FROM lineitem), m AS (SELECT g, ((v + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS v FROM w)
SELECT g % 13 AS g, CAST(min(v) AS BIGINT) AS lo, CAST(max(v) AS BIGINT) AS hi FROM m GROUP BY 1""")
def wide_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and differences modulo 2**64."""
    li = V.read(spark, sf_dir, "lineitem")
    v = E.wrap(F.col("l_partkey").cast("decimal(20,0)") * F.lit(4611686018427387).cast("decimal(17,0)") + F.col("l_suppkey").cast("decimal(20,0)") - F.lit(9_000_000_000_000_000_000).cast("decimal(20,0)"))
    return li.groupBy((F.col("l_suppkey") % 13).alias("g")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("SELECT l_suppkey % 97 AS g, CAST(sum(xor(l_partkey, l_suppkey)) AS BIGINT) AS x, CAST(sum(floor((l_partkey - 1000) / 7.0)) AS BIGINT) AS fd, CAST(sum(round((l_partkey - 1000) / 7.0)) AS BIGINT) AS rd FROM lineitem GROUP BY 1")
def integer_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive or, floor and rounded division."""
    a = F.col("l_partkey") - 1000
    return V.read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 97).alias("g")).agg(F.sum(F.col("l_partkey").bitwiseXOR(F.col("l_suppkey"))).alias("x"), F.sum(E.floor_div(a, 7)).alias("fd"), F.sum(E.round_div(a, 7)).alias("rd"))
