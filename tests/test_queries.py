"""Every query of the engine's own operators against its SQL, and results that don't depend on partitions."""

import math

import duckdb
import pytest

from gridloom.catalog import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, db, name):
    df = queries()[name](spark, sf_dir)
    got = df.select(sorted(df.columns)).collect()
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    r = db.sql(sql)
    assert sorted(r.columns) == sorted(df.columns)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert plain(got) == plain([tuple(x[i] for i in at) for x in r.fetchall()])


@pytest.mark.parametrize("name", ["column_profile", "lsb_sweep", "gap_sessions", "morton_gain", "codec_cost_table", "knn", "delta_orders", "geometry_v3", "scan_order"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, name):
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = queries()[name](spark, sf_dir)
        seen.append(plain(df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]
