"""Numbers and running sums over a whole frame in an order, without bringing its rows to one task.

Rows are range-partitioned by the order; sums of partitions, one row each, give every partition its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import kept


def _started(df: DataFrame, part: Column, value: Column) -> DataFrame:
    """df with __p, the number of its part, __before, the sum of the value over all parts before it, and __all, that of all parts."""
    parted = df.withColumn("__p", part)
    sums = parted.groupBy("__p").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    # one row for each partition
    before = F.coalesce(F.sum("__sum").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parted.join(F.broadcast(sums.select("__p", before.alias("__before"), F.sum("__sum").over(W.partitionBy()).alias("__all"))), "__p")


def numbered_in_place(df: DataFrame, place: str) -> DataFrame:
    """df with i, from 0: the rank of its monotonically increasing id, whose high bits number the partition."""
    out = _started(df, F.shiftright(F.col(place), 33), F.lit(1))
    return out.withColumn("i", F.col("__before") + F.row_number().over(W.partitionBy("__p").orderBy(place)) - 1).drop("__p", "__before", "__all")


def _sorted(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in order, with its place. Both the sums and the rows are read, and rows that tie may come in another order when the sort
    runs again, so the numbered rows are written once.
    """
    return kept(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with i, from 0, in the given order."""
    return numbered_in_place(_sorted(df, *order), "__place").drop("__place")


def running(df: DataFrame, value: str, *order: str | Column) -> DataFrame:
    """df with upto, the sum of the value over all rows up to and with each, and total, that of all rows."""
    out = _started(_sorted(df, *order), F.shiftright("__place", 33), F.col(value))
    inner = F.sum(value).over(W.partitionBy("__p").orderBy("__place").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("upto", F.col("__before") + inner).withColumnRenamed("__all", "total").drop("__p", "__before", "__place")
