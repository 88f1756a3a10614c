import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.functions.coder import crc64, decode, encode
from gridloom.operators import dependencies as D
from gridloom.operators import ordered as O
from gridloom.operators import scan as C
from gridloom.operators import spatial as S
from gridloom.operators import surface as G
from gridloom.sources import views as V
from gridloom.sources.pointfiles import sphere

BIG = [0, 1, -1, 2, -7, 63, -64, 2**40, -(2**40), 2**62, -(2**62)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=60))
def test_coder_inverts(values):
    v = np.array(values, np.int64)
    assert (decode(encode(v), len(v)) == v).all()


def test_coder_is_near_entropy_and_stable():
    v = np.random.default_rng(0).integers(-5, 6, 20_000)
    data = encode(v)
    assert data == encode(v) and len(data) * 8 / len(v) < 1.05 * math.log2(11)
    assert crc64(b"123456789") == 0x995DC9BBDF1939FA


def test_integer_expressions(spark):
    df = spark.createDataFrame([(v,) for v in BIG], "v long")
    z = E.zigzag(F.col("v"))
    got = df.select("v", z.alias("z"), E.unzigzag(z).alias("back"), E.bitlen(F.abs("v")).alias("bits"), E.floor_div(F.col("v"), 3).alias("fd"), E.round_div(F.col("v"), 4).alias("rd")).collect()
    for r in got:
        assert r.z == (2 * r.v if r.v >= 0 else -2 * r.v - 1) if abs(r.v) < 2**62 else True
        assert r.back == r.v and r.bits == abs(r.v).bit_length() and r.fd == r.v // 3
        assert r.rd == int(math.copysign((abs(r.v) * 2 + 4) // 8, r.v))
    pairs = spark.createDataFrame([(2**63 - 1, -1), (-(2**63), 1), (5, 7)], "a long, b long")
    wrapped = [tuple(r) for r in pairs.select(E.wsub(F.col("a"), F.col("b")), E.wadd(F.col("a"), F.col("b"))).collect()]
    assert wrapped == [(-(2**63), 2**63 - 2), (2**63 - 1, -(2**63) + 1), (-2, 12)]


def test_flags_round_trip(spark):
    df = spark.createDataFrame([(b,) for b in (0, 0xFFFF, 0x1234, 0x8F21)], "b long")
    u = E.unpack_flags(F.col("b"))
    back = E.pack_flags(*u.values())
    assert df.filter(back != F.col("b")).count() == 0


def test_lags_across_blocks(spark):
    df = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") * F.col("id") % 37).alias("v"))
    got = O.with_lags(df, {f"l{k}": ("v", k) for k in (1, 2, 6)}, block=10).orderBy("pos").collect()
    v = [k * k % 37 for k in range(100)]
    assert [(r.l1, r.l2, r.l6) for r in got] == [tuple(v[k - j] if k >= j else None for j in (1, 2, 6)) for k in range(100)]


def test_positions_in_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), k) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = V.with_position(df, "a", "b", block=200).orderBy("pos").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows) and [r.pos for r in got] == list(range(3000))


def test_order_statistics(spark):
    rng = random.Random(2)
    v = [rng.choice([1, 2, 3, 1000, rng.randrange(100)]) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        assert O.order_statistic(df, "v", q) == sorted(v)[min(500, int(501 * q))]
    assert O.order_statistic(df.limit(0), "v", 0.5) is None


def test_plan_inverts_and_refuses_cycles(spark, sf_dir):
    p = V.planted(spark, sf_dir)
    cols = ["partkey", "suppkey", "k7", "dup", "aff", "res"]
    plan = D.analyze(p, cols)
    assert {(s.kind, s.target) for s in plan} >= {("constant", "k7"), ("duplicate", "dup"), ("affine", "aff"), ("residual", "res")}
    assert not any(s.target in ("k7", "res") for s in D.analyze(p, cols, frozenset({"k7", "res"})))
    broken = D.invert(D.apply(p, plan).withColumn("res", F.col("res") + 1), plan)
    assert D.differences_between(p.select("pos", *cols), broken, cols).filter("mismatches > 0").count() == 1
    with pytest.raises(ValueError, match="cycle"):
        D.invert(p, [D.Step("duplicate", "a", "b"), D.Step("duplicate", "b", "a")])


def test_neighbours_of_clustered_points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.01, (80, 3)), rng.normal(5, 1, (80, 3)), [[100.0, 0, 0]], np.zeros((3, 3))])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "pos long, x double, y double, z double")
    got = {}
    for r in S.knn(df, df, 5, same=True).collect():
        got.setdefault(r.pos, []).append((r["rank"], r.npos))
    for k in range(len(x)):
        d = ((x[k] - x) * (x[k] - x)).cumsum(1)[:, -1]
        d[k] = np.inf
        want = sorted(range(len(x)), key=lambda j: (d[j], j))[:5]
        assert [j for _, j in sorted(got[k])] == want
    assert S.knn(df.limit(0), df.limit(0), 3).count() == 0


def test_lossy_candidates_use_and_keep_the_budget(spark):
    s = sphere(spark, 1.0, 400, 0.1)
    found = G.geometry_candidates(s, 0.05, rounds=6)
    assert {c["kind"] for c in found} >= {"grid", "polar-origin"} and all(0.03 < c["max_err"] <= 0.05 for c in found)
    assert G.choose_geometry(found, 0.05) in found
    with pytest.raises(ValueError, match="finite"):
        G.geometry_candidates(s.withColumn("x", F.lit(float("nan"))), 0.05)


def test_feature_size_of_a_sphere(spark):
    for radius in (0.3, 2.0):
        s = sphere(spark, radius, 3000).withColumns({f"n{c}": F.col(c) / radius for c in "xyz"})
        lfs = G.local_feature_size(s.filter("pos % 20 = 0"), s)
        assert abs(lfs.select(F.percentile("lfs", F.lit(0.5))).first()[0] - radius) < 0.04 * radius


def test_distance_field_of_a_sphere(spark):
    s = sphere(spark, 1.0, 4000)
    z = G.zero_crossings(G.signed_distance(s, 0.2), 0.2)
    r = z.select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r"))
    assert abs(r.select(F.percentile("r", F.lit(0.5))).first()[0] - 1) < 0.05


def test_scan_line_fit_and_split():
    t = np.arange(200.0)
    z = np.sin(t / 9) * 5
    v = 100 + (500 - z) * np.tan(0.1 + 0.002 * (t - t.mean()))
    p = C.fit_line(t, v, z)
    fit = p[0] + (p[1] - z) * np.tan(p[2] + p[3] * (t - t.mean()))
    assert np.abs(v - fit).max() < 1
    two = C.split_lines(t, np.where(np.arange(200) % 2, 3 * t + 500, -t))
    assert len(set(two[::2])) == 1 and len(set(two[1::2])) == 1 and two[0] != two[1]
    assert C.difference_cache(np.array([5, 10, 15, 14, 19])).tolist() == [-1, 0, 0, -1, 1]


def test_uniform_octants_have_three_bits(spark):
    from gridloom.operators.entropy import order0

    u = spark.range(20_000).select(*[F.floor(F.rand(k) * 1024).cast("long").alias(c) for k, c in enumerate("xyz")])
    one = F.lit(1).cast("long")
    h = order0(u, {"o": F.col("x").bitwiseAND(one) + 2 * F.col("y").bitwiseAND(one) + 4 * F.col("z").bitwiseAND(one)}).first()
    assert abs(h.h - 3.0) < 0.005
