"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only: no other machine would see it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="labelsift-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def let_go(spark, broadcasts: list) -> None:
    """Ends broadcasts, and has Spark clear the shuffle files and checkpoints that nothing refers to any more."""
    for b in broadcasts:
        b.destroy()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
