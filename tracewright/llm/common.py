"""What the operators of this subpackage share: tables, shared storage, small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rules of the operators have it: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs on one machine (tests) a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
        return shared_dir(spark)
    return found


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder, cutting its lineage; return it reread, and its path.

    The table survives lost executors, unlike cached blocks. Give the path to discard() once no
    frame that reads it is needed any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        hadoop, fs = _fs(spark, path)
        fs.delete(hadoop, True)


class Scratch:
    """Tables of one run of an operator in the shared folder.

    Unlike checkpoint() a reread table brings no constraints and statistics of the plan that made it,
    which double with every join of an iteration until the planner drowns in them. As a context the
    tables go when the block ends, also by an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        df, path = stored(df, label)
        self.paths.append(path)
        return df

    def clear(self) -> None:
        discard(self.spark, *self.paths)
        self.paths = []


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which Spark's cleaner removes when unreferenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words_of(text: Column) -> Column:
    """The number of words; null counts as none. Counting separators avoids building the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Arrow batches cut so that a binary or string column holds about most_bytes a piece.

    A row over that size comes alone. Memory of a Python worker so depends on the longest row only.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.fill_null(pa.compute.binary_length(array), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start), start
                start, held = i, 0
            held += n
        yield batch.slice(start), start
