"""Values of operators that SQL does not express, against numpy and closed forms; and cases that must be refused."""

import collections
import lzma
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import exprs as E
from gridloom.operators import codecs as C
from gridloom.operators import dependencies as D
from gridloom.operators import ordered as O
from gridloom.operators import spatial as S
from gridloom.operators import surface as G
from gridloom.plans import codec_queries, column_queries, extended_queries, spatial_queries
from gridloom.sources import container
from gridloom.sources import pointfiles as P
from gridloom.sources import views as V


def cloud(spark, x):
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(x)), **{c: x[:, k].astype(float) for k, c in enumerate("xyz")}}))


def lattice(n, base=((0, 0, 0),)):
    g = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3).astype(float)
    return np.concatenate([g + np.array(b) for b in base])


def inner(df, x, margin=1.5):
    ids = np.flatnonzero(((x > x.min(0) + margin) & (x < x.max(0) - margin)).all(1))
    return df.filter(F.col("pos").isin([int(i) for i in ids]))


def test_bond_order_of_lattices(spark):
    cubic = lattice(5)
    q = inner(S.bond_order(cloud(spark, cubic), 6, (4, 6)), cubic, 0.9).agg(F.avg("q4"), F.avg("q6"), F.stddev("q4")).first()
    assert abs(q[0] - 0.7638) < 1e-3 and abs(q[1] - 0.3536) < 1e-3 and q[2] < 1e-9
    fcc = lattice(4, ((0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)))
    q = inner(S.bond_order(cloud(spark, fcc), 12, (4, 6)), fcc, 0.9).agg(F.avg("q4"), F.avg("q6")).first()
    assert abs(q[0] - 0.1909) < 1e-3 and abs(q[1] - 0.5745) < 1e-3


def test_hexatic_order_of_a_turned_triangular_lattice(spark):
    g = np.array([(i + 0.5 * j, j * math.sqrt(3) / 2, 0.0) for i in range(9) for j in range(9)])
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))
    mid = [i * 9 + j for i in range(2, 7) for j in range(2, 7)]
    psi = S.hexatic(cloud(spark, g @ turn)).filter(F.col("pos").isin(mid)).agg(F.min("psi6"), F.max("psi4")).first()
    assert psi[0] > 1 - 1e-6 and psi[1] < 1e-6


def test_distance_from_local_planes(spark):
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    flat = np.concatenate([rng.uniform(0, 1, (300, 2)), np.zeros((300, 1))], 1)
    above = np.concatenate([rng.uniform(0.2, 0.8, (20, 2)), np.full((20, 1), 0.3)], 1)
    d = S.plane_distances(cloud(spark, flat @ turn), cloud(spark, above @ turn)).collect()
    assert len(d) == 20 and all(abs(r.d - 0.3) < 1e-6 for r in d)


def test_octant_experiment_against_plain_python(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=(3000, 3))
    x = u / np.linalg.norm(u, axis=1)[:, None]
    size = 0.2
    half = {tuple(h) for h in np.floor(x / (size / 2)).astype(int)}
    octant = {}
    for h in half:
        c, o = tuple(v >> 1 for v in h), sum((v & 1) << i for i, v in enumerate(h))
        octant[c] = min(o, octant.get(c, 8))
    pairs = []
    for c, o in octant.items():
        near = np.array([d for d in np.ndindex(3, 3, 3) if tuple(np.array(d) - 1 + c) in octant and d != (1, 1, 1)]) - 1
        if len(near) >= 6:
            w, v = np.linalg.eigh(np.cov(near.T, bias=True))
            if w[1] - w[0] > 1e-9:  # the normal is one direction
                pairs.append((o, v[:, 0]))
    got = spatial_queries.octant_experiment(cloud(spark, x), size).first()
    n = collections.Counter(o for o, _ in pairs)
    h = -sum(k / len(pairs) * math.log2(k / len(pairs)) for k in n.values())
    assert got.cells == len(octant) and abs(got.coverage - len(pairs) / len(octant)) < 0.01 and abs(got.h - h) < 0.02
    assert 0 <= got.hit <= 1 and got.h_given <= got.h + 1e-9


def test_feature_size_of_a_thinned_surface(spark):
    s = P.sphere(spark, 2.0, 6000).withColumns({f"n{c}": F.col(c) / 2.0 for c in "xyz"})
    for most in (20_000, 800):
        lfs = G.local_feature_size(s.filter("pos % 40 = 0"), s, most)
        assert abs(lfs.select(F.percentile("lfs", F.lit(0.5))).first()[0] - 2.0) < 0.08
    assert G.thinned(s, 800).count() <= 800


def test_proxy_sizes(spark):
    rng = random.Random(4)
    v = [rng.choice([-(2**63), 2**63 - 1, 5, rng.randrange(1000)]) for _ in range(500)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "pos long, a long")
    got = {r.codec: r.bytes for r in codec_queries.proxy_sizes(df.repartition(3), ["a"], 200).collect()}
    want = collections.Counter()
    for at in range(0, 500, 200):
        block = v[at : at + 200]
        d = [((a - b + 2**63) % 2**64) - 2**63 for a, b in zip(block, [0, *block], strict=False)]
        z = np.array([2 * x if x >= 0 else -2 * x - 1 for x in d], np.uint64)
        planes = np.stack([(z >> np.uint64(8 * k)).astype(np.uint8) for k in range(8)]).tobytes()
        want["raw"] += len(planes)
        want["zlib6"] += len(zlib.compress(planes, 6))
        want["xz6"] += len(lzma.compress(planes, preset=6))
    assert all(got[k] == n for k, n in want.items()) and got["zstd19"] <= got["raw"]


def test_full_range_differences_wrap(spark):
    v = [2**63 - 1, -(2**63), 0, -(2**63), 2**63 - 1, 7, -7]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "pos long, a long")
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    got = O.differences(df, ["a"], 2).orderBy("pos").collect()
    d1 = [wrap(a - b) for a, b in zip(v, [0, *v], strict=False)]
    assert [r.a_d1 for r in got] == d1
    assert [r.a_d2 for r in got][1:] == [wrap(a - b) for a, b in zip(d1[1:], d1, strict=False)]
    costs = {r.codec: r.bits for r in C.costs(df, ["a"]).collect()}
    assert costs["raw64"] == 64.0 and 0 < costs["delta"] <= math.log2(7) + 1e-6
    back = C.restored(C.streams(df, ["a"])).orderBy("pos").collect()
    assert [r.v for r in back] == v


def test_bit_lengths_at_powers_of_two(spark):
    v = sorted({max(0, (1 << k) + d) for k in range(63) for d in (-1, 0, 1)}) + [-1]
    got = spark.createDataFrame([(x,) for x in v], "v long").select("v", E.bitlen(F.col("v")).alias("b")).collect()
    assert all(r.b == (r.v.bit_length() if r.v >= 0 else 64) for r in got)


@pytest.mark.parametrize("rows", [[(0, 7, 1), (1, None, 2), (2, 7, 3)], [(0, 1, 1), (1, None, 2), (2, 3, 3)], [(0, 1, 3), (1, 2, None), (2, 3, 9)]])
def test_columns_with_nulls_are_refused(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "pos long, b long, a long")
    for f in (D.constants, D.duplicates, D.affines, D.analyze):
        with pytest.raises(ValueError, match="nulls"):
            f(df, ["a", "b"])
    with pytest.raises(ValueError, match="nulls"):
        container.write_container(df, str(tmp_path / "c"))
    with pytest.raises(Exception, match="nulls"):
        C.streams(df, ["a", "b"]).collect()


def test_protected_columns_stay(spark):
    df = spark.range(200).select(F.col("id").alias("pos"), F.lit(3).cast("long").alias("bit_fields"), F.lit(4).cast("long").alias("k"))
    assert [s.target for s in D.analyze(df, ["bit_fields", "k"])] == ["k"]
    assert {s.target for s in D.analyze(df, ["bit_fields", "k"], frozenset())} == {"bit_fields", "k"}


def test_wide_palettes_are_refused_and_lose_nothing(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(column_queries, "MOST_LEVELS", 11)
    got = {r.col: r for r in column_queries.palette_roundtrip(spark, sf_dir).collect()}
    n = V.read(spark, sf_dir, "lineitem").count()
    assert all(r.n == n and r.mismatches == 0 for r in got.values())
    assert got["z"].coded == n and got["y"].coded == got["x"].coded == 0


@pytest.mark.parametrize("block", [40, 9])
def test_positions_with_many_cuts_hot_keys_and_nulls(spark, monkeypatch, block):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 1, 1, 1, rng.randrange(50)]), k) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = V.with_position(df, "a", "b", block=block).orderBy("pos").collect()  # 40: a tree of cuts; 9: a table
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and [r.pos for r in got] == list(range(3000))
    own = V.with_position(df.filter("a is not null").select("b"), "b", block=block).orderBy("pos").collect()
    assert [r.b for r in own] == sorted(b for a, b in rows if a is not None)


def test_nearest_of_the_last_rows(spark):
    rng = random.Random(7)
    p = [(rng.randrange(20), rng.randrange(20)) for _ in range(300)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(p)], "pos long, x long, y long")
    for r in O.nearest_back(df, ["x", "y"], 9, block=50).collect():
        near = min(((abs(p[r.pos][0] - p[j][0]) + abs(p[r.pos][1] - p[j][1]), r.pos - j) for j in range(max(0, r.pos - 9), r.pos)), default=None)
        assert r.back == (near[1] if near else None)
        assert near is None or (r.x_b, r.y_b) == tuple(a - b for a, b in zip(p[r.pos], p[r.pos - near[1]], strict=True))


def test_real_step_and_merge_find_what_is_there(spark):
    from gridloom.plans.extended_queries import real_step

    rng = random.Random(8)
    df = spark.createDataFrame([(rng.randrange(400) * 0.37,) for _ in range(600)], "v double")
    assert abs(real_step(df, "v") - 0.37) < 1e-6


def test_blocks_and_coordinates_of_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    for k in range(2):
        p = pd.DataFrame({c: rng.normal(size=30).astype(np.float32) for c in ("X", "Y", "Z", "intensity")})
        (tmp_path / f"{k}.bin").write_bytes(P.kitti_bytes(p))
    got = P.read_block(spark, str(tmp_path), 25, 10, "bin")
    assert sorted(r.pos for r in got.collect()) == list(range(25, 35))
    assert P.read_points(spark, str(tmp_path), "bin", 7).count() == 7
    xyz, width = P.coordinates(spark, str(tmp_path), "bin")
    assert width == 4 and xyz.columns == ["pos", "x", "y", "z"] and xyz.count() == 60
    (tmp_path / "a.csv").write_text("1.0004,2,3,9\n-0.5,0.25,7\n4,5,6\n")
    rows = P.read_block(spark, str(tmp_path / "a.csv"), 1, 2).orderBy("pos").collect()
    assert [(r.X, r.Y, r.Z) for r in rows] == [(-500, 250, 7000), (4000, 5000, 6000)]
    raw = pd.DataFrame({"X": [100, 200], "Y": [3, 4], "Z": [5, 6]})
    (tmp_path / "a.las").write_bytes(P.las_bytes(raw, 1, (0.01, 0.1, 1.0), (5.0, 0.0, -1.0)))
    xyz, width = P.coordinates(spark, str(tmp_path / "a.las"))
    assert width == 0 and [tuple(r)[1:] for r in xyz.orderBy("pos").collect()] == [(6.0, 3 * 0.1, 4.0), (7.0, 4 * 0.1, 5.0)]


def test_lines_that_a_log_reader_leaves_out(spark, tmp_path):
    good = " ".join(["a", "identity", "10", *["1"] * 16, "v1"])
    (tmp_path / "log.txt").write_text(f"{good}\nshort line\n\n{good.replace(' 10 ', ' ten ')}\n")
    assert P.read_log(spark, str(tmp_path)).count() == 1
    assert P.bad_lines(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("codec", list(C.STREAMS))
def test_every_codec_gives_its_bytes_back(spark, codec):
    rng = random.Random(10)
    v = [rng.choice([-(2**63), 2**63 - 1, 0, 255, rng.randrange(-1000, 1000)]) if rng.random() < 0.3 else 3 * k for k in range(700)]
    df = spark.createDataFrame(list(enumerate(v)), "pos long, a long").repartition(3)
    coded = C.streams(df, ["a"], 256, codec)
    assert [r.v for r in C.restored(coded).orderBy("pos").collect()] == v
    with pytest.raises(Exception, match="damaged"):
        C.restored(coded.withColumn("data", F.concat("data", F.lit("x").cast("binary")))).collect()


def test_chosen_streams_come_near_the_entropy(spark):
    rng = np.random.default_rng(11)
    walk = np.cumsum(rng.integers(-3, 4, 6000))
    df = spark.createDataFrame(pd.DataFrame({"pos": np.arange(6000), "w": walk, "u": rng.integers(0, 8, 6000)}))
    best = {r.col: r for r in C.choice(C.costs(df, ["w", "u"])).collect()}
    for r in C.best_streams(df, ["w", "u"]).collect():
        assert r.codec == best[r.col].codec and len(r.data) * 8 / r.n < best[r.col].bits + 1.2  # signs and the lowest bits aren't modelled


def test_container_of_every_codec(spark, tmp_path):
    rng = np.random.default_rng(12)
    p = pd.DataFrame({"pos": np.arange(900), "walk": np.cumsum(rng.integers(-2, 3, 900)), "line": 5 * np.arange(900), "few": rng.integers(0, 4, 900), "wide": rng.integers(-(2**62), 2**62, 900)})
    df = spark.createDataFrame(p)
    container.write_container(df, str(tmp_path / "c"), 256)
    back = container.read_container(spark, str(tmp_path / "c"))
    assert D.coverage(df, back).filter("status <> 'same'").count() == 0


def test_extra_bytes_and_records_of_las_files(spark, tmp_path):
    p = pd.DataFrame({"X": [1, 2, 3], "Y": [4, 5, 6], "Z": [7, 8, 9], "amp": [0.5, -1.0, 2.5], "echo": [3, 200, 65_000]})
    extra = [("amp", "f8"), ("echo", "u2")]
    raw = P.las_bytes(p, 6, extra=[(n, next(c for c in P.EXTRA_CODES if c.endswith(k))) for n, k in extra], vlrs=[("me", 7, "words", b"abc")], evlrs=[("far", 9, "long", b"z" * 70_000)])
    (tmp_path / "a.las").write_bytes(raw)
    got = P.read_points(spark, str(tmp_path / "a.las")).orderBy("pos").collect()
    assert [(r.X, r.amp, r.echo) for r in got] == list(zip(p["X"], p["amp"], p["echo"], strict=True))
    rows = {(r.user_id, r.record_id): bytes(r.data) for r in P.vlr_table(spark, str(tmp_path)).collect()}
    assert rows[("me", 7)] == b"abc" and rows[("far", 9)] == b"z" * 70_000 and len(rows[("LASF_Spec", 4)]) == 384
    with pytest.raises(ValueError, match="described"):
        P.extra_descriptor([("x" * 40, "f8")])


@pytest.mark.parametrize("values", [[], [0], [127, 128, 2**64 - 1, 300, 0, 2**63]])
def test_varints(values):
    from gridloom.functions.coder import from_varints, varints

    data = varints(np.array(values, np.uint64))
    assert from_varints(data).tolist() == values
    with pytest.raises(ValueError):
        from_varints(data + b"\x80")


def test_plans_as_bytes():
    plan = [D.Step("affine", "a", "b", 0, 3, 2, -5), D.Step("constant", "c", None, 2**62)]
    assert D.plan_from(D.plan_bytes(plan)) == D.plan_from(D.plan_bytes(plan, False)) == plan


def test_steps_are_tightened_to_the_output_type(spark):
    df = spark.createDataFrame([(1000.0 + k * 0.0137, -500.0 + k * 0.0071) for k in range(500)], "x double, y double")
    step, worst, turns = G.tightened(df, ["x", "y"], 0.001)
    assert worst <= 0.001 and step > 0.0005 and turns <= 6
    with pytest.raises(ValueError, match="output type"):
        G.tightened(df, ["x", "y"], 1e-9)


def test_reports(spark, sf_dir):
    text = codec_queries.bit_report(spark, sf_dir)
    assert text.count("## ") == 3 and "| shipday |" in text
    assert codec_queries.report([(1, None, "a|b")], ["x", "y", "z"]) == "| x | y | z |\n|-|-|-|\n| 1 |  | a\\|b |"


def test_copies_of_a_cloud_with_shared_codes_agree(spark, tmp_path):
    # prices 2**20 hundredths apart have one code of 20 bits
    n = np.arange(400)
    li = pd.DataFrame({"l_orderkey": n, "l_linenumber": np.ones(400, int), "l_partkey": n, "l_suppkey": n, "l_extendedprice": (n * 7 % 8) * 10485.76 + n // 100 * 0.01})
    li = li.assign(l_quantity=1.0, l_discount=0.0, l_tax=0.0, l_shipdate=pd.Timestamp("1995-01-01"))
    spark.createDataFrame(li).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert tuple(extended_queries.canonical_merge(spark, str(tmp_path)).first()) == (400, 0)
    spark.createDataFrame(li).limit(0).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    assert tuple(extended_queries.canonical_merge(spark, str(tmp_path)).first()) == (0, 0)


def test_normalised_morton_order_computes_the_cloud_once(spark, sf_dir, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    real = V.pts_li
    monkeypatch.setattr(V, "pts_li", lambda spark, sf_dir: (df := real(spark, sf_dir)).mapInArrow(counted, df.schema))
    got = codec_queries.morton_normalised(spark, sf_dir).collect()
    assert got[0].n <= seen.value <= 2 * got[0].n  # a checkpoint may compute its rows twice
