import numpy as np
import pandas as pd
import pytest

from gridloom.sources import container
from gridloom.sources import pointfiles as P


def points(n=50, seed=1):
    r = np.random.default_rng(seed)
    return pd.DataFrame({c: r.normal(size=n).astype(np.float32) for c in ("X", "Y", "Z", "intensity")})


def test_kitti_round_trip_keeps_bits(spark, tmp_path):
    for k in range(3):
        p = points(seed=k)
        p.loc[0, "X"] = -0.0
        (tmp_path / f"{k}.bin").write_bytes(P.kitti_bytes(p))
    df = P.read_points(spark, str(tmp_path), "bin")
    assert df.count() == 150 and [r.pos for r in df.select("pos").orderBy("pos").collect()] == list(range(150))
    assert P.save_files(P.encoded_files(df, P.kitti_bytes), str(tmp_path / "out")) == 3
    for k in range(3):
        assert (tmp_path / "out" / f"{k}.bin").read_bytes() == (tmp_path / f"{k}.bin").read_bytes()
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="16 bytes"):
        P.read_points(spark, str(tmp_path / "bad.bin"), "bin").count()


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, kind):
    p = points()[["X", "Y", "Z"]].rename(columns=str.lower).assign(k=np.arange(50, dtype=np.int64))
    (tmp_path / "a.ply").write_bytes(P.ply_bytes(p, kind))
    got = P.read_points(spark, str(tmp_path / "a.ply")).orderBy("pos").toPandas()
    assert (got[["x", "y", "z"]].to_numpy() == p[["x", "y", "z"]].to_numpy()).all() and (got["k"] == p["k"]).all()


def test_ply_refuses_what_it_cannot_read():
    with pytest.raises(ValueError, match="vertex element"):
        P.ply_header(b"ply\nformat ascii 1.0\nelement face 1\nend_header\n")
    with pytest.raises(ValueError, match="list"):
        P.ply_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int a\nend_header\n")


@pytest.mark.parametrize("fmt", range(11))
def test_las_round_trip(spark, tmp_path, fmt):
    r = np.random.default_rng(fmt)
    n, data = 40, {}
    for name, code in P.las_record(fmt):
        if name not in ("flags", "returns"):
            info = np.dtype(code)
            data[name] = r.normal(size=n) if info.kind == "f" else r.integers(0, 31, n)
    rn = r.integers(1, 4, n)
    data["bit_fields"] = rn | 3 << 4 | r.integers(0, 2, n) << 8 | r.integers(0, 8 if fmt < 6 else 16, n) << 10
    (tmp_path / "a.las").write_bytes(P.las_bytes(pd.DataFrame(data), fmt))
    if fmt in (1, 3, 6, 10):
        got = P.read_points(spark, str(tmp_path / "a.las")).orderBy("pos").toPandas()
        for c, v in data.items():
            assert (got[c].to_numpy() == v).all(), c
        assert P.vlr_table(spark, str(tmp_path)).count() == 0
    head = P.las_header((tmp_path / "a.las").read_bytes())
    assert head["count"] == n and head["format"] == fmt
    less = P.parse_las(P.las_bytes(pd.DataFrame(data), fmt, keep=frozenset({"X"})))
    assert (less["X"] == data["X"]).all() and not less["intensity"].any()


def test_las_undescribed_bytes_and_versions():
    raw = bytearray(P.las_bytes(pd.DataFrame({"X": [1], "Y": [2], "Z": [3]}), 0))
    raw[105:107] = (22).to_bytes(2, "little")
    got = P.parse_las(bytes(raw) + b"\x07\x09")
    assert got["undescribed#0"].tolist() == [7] and got["undescribed#1"].tolist() == [9]
    raw[25] = 5
    with pytest.raises(ValueError, match="1.5"):
        P.las_header(bytes(raw))


def test_container_round_trip_and_damage(spark, sf_dir, tmp_path):
    from gridloom.operators.dependencies import differences_between
    from gridloom.sources.views import planted

    p = planted(spark, sf_dir)
    path = str(tmp_path / "c")
    container.write_container(p, path, 1000)
    cols = [c for c in p.columns if c != "pos"]
    back = container.read_container(spark, path)
    assert differences_between(p, back, cols).filter("mismatches > 0").count() == 0
    assert container.same_header(container.read_header(spark, path), {"version": 1}) != []
    from pyspark.sql import functions as F

    bad = spark.read.parquet(f"{path}/streams").withColumn("crc", F.col("crc") + 1)
    from gridloom.operators.codecs import restored

    with pytest.raises(Exception, match="damaged"):
        restored(bad).count()


def test_log(spark, tmp_path):
    line = lambda c: " ".join(["a", c, "10", "0.1", "2", *["1.5"] * 14, "v1"])
    (tmp_path / "log").write_text("\n".join(["header", line("identity"), line("identity"), line("reverse"), ""]))
    rows = P.read_log(spark, str(tmp_path / "log"))
    assert rows.count() == 3
    assert {(r.cond, r["count"]) for r in P.check_log(rows, ["identity", "reverse", "morton"]).collect()} == {("identity", 2), ("morton", 0)}


def test_sphere(spark):
    s = P.sphere(spark, 2.0, 500)
    assert s.selectExpr("max(abs(sqrt(x*x+y*y+z*z) - 2))").first()[0] < 1e-9
