"""Frames that are kept in the folder that the driver and all executors share, so that a lost executor loses nothing of them."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> None:
    """The folder is spark.checkpoint.dir; only where that is unset and all runs on one machine one of our own is made."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
    context.setCheckpointDir(found)


def kept(df: DataFrame) -> DataFrame:
    """df as it is now, run once: rows, their order in partitions and whatever was numbered in them stay the same for all who
    read it. Spark's cleaner removes it once it isn't referenced.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)
