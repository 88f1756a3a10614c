"""Ordered column tables over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of storage order; ordered operators sort blocks, and any number of tasks share them.
BLOCK = 1 << 14
#: Rows from which a table is numbered by ranges, and the rows that a range is meant to hold at most.
RANGE_ROWS = 1 << 16
#: Yet never more ranges than these; beyond, ranges get longer.
MOST_RANGES = 1 << 14
#: Keys drawn for each range.
PER_RANGE = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_position(df: DataFrame, *keys: str, name: str = "pos", block: int = RANGE_ROWS) -> DataFrame:
    """df with its dense rank from 0 in the order of keys (a unique key).

    Beyond one block of rows, splitters from a hash sample of the whole keys deal rows into ranges, a few for each
    core at least, whose exact sizes give each range's first rank. Splitters are fixed by the data, so they hold
    however often the plan runs; what the driver gets is bounded by MOST_RANGES."""
    n = df.count()
    if n <= block:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
    spark = df.sparkSession
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = min(max(4 * cores, -(-n // block)), MOST_RANGES)
    every = max(1, n // (parts * PER_RANGE))
    nulls_first = lambda row: [(v is not None, v) for v in row]
    drawn = sorted((tuple(r) for r in df.select(*keys).filter(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).collect()), key=nulls_first)
    cuts = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)} if drawn else set(), key=nulls_first)
    dealt = df.withColumn("_r", _place(df, keys, cuts))
    sizes = sorted(tuple(r) for r in dealt.groupBy("_r").count().collect())
    starts, total = [0] * (len(cuts) + 1), 0
    for r, c in sizes:
        starts[r] = total
        total += c
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_r") + 1)
    rank = F.row_number().over(Window.partitionBy("_r").orderBy(*keys)).cast("long") - 1
    return dealt.withColumn(name, rank + offset).drop("_r")


def _place(df: DataFrame, keys: tuple[str, ...], cuts: list[tuple]) -> Column:
    """The number of cuts that are at or below a row's keys: by halving. The first key decides wherever it can."""
    schema = df.select(*keys).schema
    whole = len({c[0] for c in cuts}) < len(cuts) or any(v is None for c in cuts for v in c)
    lit = lambda v, f: F.lit(v).cast(f.dataType).alias(f.name)
    if whole:
        values, own = [F.struct(*[lit(v, f) for v, f in zip(c, schema, strict=True)]) for c in cuts], F.struct(*keys)
    else:
        values, own = [lit(c[0], schema[0]) for c in cuts], F.col(keys[0])
    below = lambda v: F.coalesce(own < v, F.lit(True))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(values[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(cuts) < 256:
        return tree(0, len(cuts))
    table = F.array(*values)
    step = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.when(below(F.element_at(table, _middle(acc) + 1)), F.struct(acc["lo"].alias("lo"), _middle(acc).alias("hi"))).otherwise(F.struct((_middle(acc) + 1).alias("lo"), acc["hi"].alias("hi"))))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, step, lambda acc: acc["lo"])


def _middle(acc: Column) -> Column:
    return F.shiftright(acc["lo"] + acc["hi"], 1)


def pts_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as integer columns in storage order."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    li = with_position(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select("pos", cents("l_extendedprice").alias("x"), F.col("l_quantity").cast("long").alias("y"), cents("l_discount").alias("z"), cents("l_tax").alias("tax"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").cast("long").alias("linenumber"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("shipday"))


def pts_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of the embeddings as points."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")], F.col("label").cast("long").alias("label"))


def scan_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a scan: source, time in microseconds, class, value in hundredths."""
    e = read(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("sid"), micros.alias("gps"), F.col("event_type").alias("cls"), F.round(F.col("value") * 100).cast("long").alias("val"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pts_li with a constant, a duplicate, an affine and a residual column."""
    return pts_li(spark, sf_dir).withColumns({"k7": F.lit(7).cast("long"), "dup": F.col("partkey"), "aff": 3 * F.col("suppkey") + 5, "res": F.col("partkey") + F.col("pos") % 4})
