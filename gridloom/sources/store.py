"""Tables that several actions read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set for checkpoints too. Only a local session that names none gets one of its own."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="gridloom-"))
    return jsc.getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: computed once, safe from lost executors, and removed by Spark's cleaner (if that is on) when
    nothing refers to it any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
