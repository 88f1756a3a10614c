"""Queries on lossy geometry, surfaces and scan lines; iterative, so without SQL but for their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.operators import entropy as H
from gridloom.operators import ordered as O
from gridloom.operators import scan as C
from gridloom.operators import surface as G
from gridloom.operators.spatial import normals
from gridloom.plans.column_queries import blen, h_sql, zz
from gridloom.plans.registry import query
from gridloom.sources import views as V

EPS = 0.01


@query()
def lossy_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lossy candidate within the error budget, and the one chosen."""
    found = G.geometry_candidates(V.pts_emb(spark, sf_dir), EPS)
    best = G.choose_geometry(found, EPS)
    rows = [(c["kind"], float(c["step"]), float(c["max_err"]), float(c["bits"]), c is best) for c in found]
    return spark.createDataFrame(rows, "kind string, step double, max_err double, bits double, chosen boolean")


@query()
def surface_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the signed distance field of a sphere and the crossings' distance from it."""
    s = G.signed_distance(V.pts_emb(spark, sf_dir).select("pos", *_on_sphere()), 0.1)
    z = G.zero_crossings(s, 0.1)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return z.agg(F.count("*").alias("points"), F.round(F.avg(r), 3).alias("mean_radius"))


def _on_sphere() -> list:
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return [(F.col(c) / r).alias(c) for c in "xyz"]


@query()
def feature_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local feature size of the points put on a unit sphere (its radius)."""
    p = V.pts_emb(spark, sf_dir).select("pos", *_on_sphere())
    with_normals = p.select("*", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    lfs = G.local_feature_size(with_normals, p)
    return lfs.agg(F.count("*").alias("n"), F.round(F.percentile("lfs", F.lit(0.5)), 2).alias("median"))


@query()
def surface_leaves_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = G.adaptive_leaves(V.pts_emb(spark, sf_dir), 0.02, depth=5)
    return leaves.groupBy("level").agg(F.count("*").alias("leaves"), F.sum("n").alias("points"))


@query()
def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.pts_emb(spark, sf_dir)
    s = G.smoothed(p.select("pos", *"xyz"), 0.15)
    d = s.alias("s").join(p.select("pos", *[F.col(c).alias(f"o{c}") for c in "xyz"]), "pos")
    move = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz"), F.lit(0.0)))
    return d.agg(F.count("*").alias("n"), F.round(F.avg(move), 6).alias("mean_move"))


@query()
def normal_estimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normals(V.pts_emb(spark, sf_dir), 12)
    return n.agg(F.count("*").alias("n"), F.round(F.avg("nz"), 6).alias("mean_nz"), F.round(F.min("nz"), 6).alias("min_nz"))


@query()
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's fitted line against plain differences."""
    s = O.sessions(V.scan_ev(spark, sf_dir), O.GAP_FACTOR).withColumn("t", (F.col("gps") / 1_000_000).cast("double"))
    s = s.withColumn("k", F.length("cls").cast("long"))
    f = C.sweep_fits(s.select("pos", "sid", "session", "t", "val", "k"), ["sid", "session"], "t", "val", "k")
    return f.agg(F.count("*").alias("sweeps"), F.sum("n").alias("n"), F.sum(F.col("two_lines").cast("long")).alias("split"), F.sum(F.col("fitted").cast("long")).alias("fitted"), F.sum("delta_bits").alias("delta_bits"), F.sum(F.least("delta_bits", "line_bits")).alias("bits"))


@query()
def difference_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cache_profile(V.pts_li(spark, sf_dir), "z")


@query()
def surface_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.surface_predictions(V.pts_li(spark, sf_dir))


@query("""p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT z AS v FROM pts_li)), c AS (SELECT pos, code, y FROM pts_li JOIN p ON v = z), d AS (SELECT code, coalesce(lag(code) OVER (ORDER BY pos), 0) * 16 + (y & 15) AS ctx FROM c),
k AS (SELECT code, ctx, count(*) AS k FROM d GROUP BY ALL), g AS (SELECT ctx, sum(k) AS k, sum(k * log2(k)) AS t FROM k GROUP BY ctx)
SELECT (SELECT count(*) FROM p) AS alphabet, round((sum(k * log2(k)) - sum(t)) / sum(k), 6) AS bits FROM g""", ("pts_li",))
def alphabet_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column's symbol number given the one before and four bits of another column."""
    li = V.pts_li(spark, sf_dir).select("pos", "y", "z")
    levels = sorted(r[0] for r in li.select("z").distinct().limit(513).collect())
    if len(levels) > 512:
        return spark.createDataFrame([], "alphabet long, bits double")
    code = F.array_position(F.array(*map(F.lit, levels)), F.col("z")) - 1
    d = O.with_lags(li.withColumn("code", code.cast("long")), {"p": ("code", 1)})
    ctx = F.coalesce("p", F.lit(0)) * 16 + F.col("y").bitwiseAND(F.lit(15))
    return H.conditional(d, {"z": ("code", ctx)}).select(F.lit(len(levels)).cast("long").alias("alphabet"), F.col("conditional").alias("bits"))


@query(f"""c AS (SELECT coalesce(lag(linenumber) OVER (ORDER BY pos), 0) AS p, linenumber AS rn, x - coalesce(lag(x) OVER (ORDER BY pos), 0) AS d FROM pts_li)
SELECT CASE WHEN rn = p + 1 THEN 1 ELSE 0 END AS cont, count(*) AS n, CAST(sum({blen(zz('d'))}) AS BIGINT) AS bits FROM c GROUP BY 1""", ("pts_li",))
def continuation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference cost with and without the continuation of a pulse."""
    d = O.differences(O.with_lags(V.pts_li(spark, sf_dir), {"p": ("linenumber", 1)}), ["x"])
    cont = F.when(F.col("linenumber") == F.coalesce("p", F.lit(0)) + 1, 1).otherwise(0)
    return d.groupBy(cont.alias("cont")).agg(F.count("*").alias("n"), F.sum(O.bits("x_d1")).alias("bits"))


@query(f"""c AS (SELECT y AS r, z AS g, tax AS b, y - tax AS co, tax + ((y - tax) >> 1) AS t FROM pts_li), d AS (SELECT t + ((g - t) >> 1) AS luma, co, g - t AS cg, r, g, b FROM c),
l AS (SELECT 'y' AS col, luma AS v FROM d UNION ALL SELECT 'co', co FROM d UNION ALL SELECT 'cg', cg FROM d UNION ALL SELECT 'r', r FROM d UNION ALL SELECT 'g', g FROM d UNION ALL SELECT 'b', b FROM d) {h_sql('l')}""", ("pts_li",))
def colour_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of three colour columns as they stand and after the reversible colour transform."""
    luma, co, cg = E.ycocg(F.col("y"), F.col("z"), F.col("tax"))
    return H.order0(V.pts_li(spark, sf_dir), {"y": luma, "co": co, "cg": cg, "r": "y", "g": "z", "b": "tax"})


@query("""o AS (SELECT pos, CAST(round(x / 0.001) AS BIGINT) AS k, x FROM pts_emb) SELECT count(*) AS n, round(max(abs(CAST(CAST(k * 0.001 AS FLOAT) AS DOUBLE) - x)), 9) AS max_err FROM o""", ("pts_emb",))
def output_type_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a grid after its values are rounded to the output's float type."""
    back = (E.quantize(F.col("x"), 0.001) * 0.001).cast("float").cast("double")
    return V.pts_emb(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.max(F.abs(back - F.col("x"))), 9).alias("max_err"))
