"""Lineage cuts in the folder the cluster shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; set a folder of our own only where the session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridwright-checkpoint-"))


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files, which outlive any executor.

    With ``release`` both garbage collectors run afterwards: Spark deletes shuffle and checkpoint files
    only when the driver's objects for them are collected, and a long chain of steps would keep them all.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if release:
        del df
        gc.collect()
        out.sparkSession.sparkContext._jvm.System.gc()
    return out
