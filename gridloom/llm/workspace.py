"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.textkit import release

#: What a Python worker gets at once while a table is written: rows (sketches are wide) and bytes (texts are long).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: Seconds from one settle() to the next at least, and as a multiple of what the last one took.
SETTLE_SECONDS, SETTLE_SHARE = 10, 20

#: Lists of such tables' files don't go to the cache that all sessions share: it would keep them after the tables are deleted.
UNLISTED = {"spark.sql.hive.manageFilesourcePartitions": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; on a cluster, where
    executors would each write to their own disk, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        if hadoop.isDefined():
            return hadoop.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def _held(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: When settle() last ended, and how long it took.
_settled = [0.0, 0.0]


def settle(spark: SparkSession, now: bool = False) -> None:
    """Give back what finished jobs left in the driver: Spark drops shuffles and broadcasts only when the JVM collects the plans
    that name them, which Python's own cycles hold in turn, and a JVM that has room lets both grow. But for `now`, not more often
    than every SETTLE_SECONDS, nor for more than a part in SETTLE_SHARE of the time."""
    began = time.monotonic()
    if not now and began - _settled[0] < max(SETTLE_SECONDS, SETTLE_SHARE * _settled[1]):
        return
    gc.collect()
    release()
    spark._jvm.java.lang.System.gc()
    _settled[:] = time.monotonic(), time.monotonic() - began


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, so a lost
    executor costs no more than the tasks that read it. discard() removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    with _held(spark, BATCH):
        df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    settle(spark)
    with _held(spark, UNLISTED):
        out = spark.read.schema(df.schema).parquet(path)
    out.stored_path_ = path
    return out


#: Tables of this process that still stand.
_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that stored() gave and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "stored_path_", None)
        if path:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at the end, but for those that keep() names."""
    known = set(_written)
    yield
    for path in [p for p in _written if p not in known and p not in _kept]:
        _delete(spark, path)


_kept: set[str] = set()


def keep(df: DataFrame) -> DataFrame:
    """df, a table of stored(), outlives the scope in which it was made."""
    _kept.add(df.stored_path_)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that no column of df has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
