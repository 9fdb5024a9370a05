"""Order inside a case, with cases of any size spread over many tasks.

A window by case puts a whole case into one task. Here a case of more than a stated number of rows is cut into slices of
its order at splitters drawn from the rows themselves; the slice of a row depends on its values alone, so tasks that are
run again agree. Windows run by case and slice, and what a slice needs from the others (the first rows after it, or how
many rows stand before it) is a small table with a row for each slice. Cases below that size are one slice.

Rows of equal order aren't divided; what stands first among them is as undefined as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a case that one task sorts without trouble.
ROWS = 20_000_000

#: Logs that the planner takes to be smaller than this are left to one window by case: all of it would fit a few tasks.
SMALL_BYTES = 64 << 30

#: Sampled rows for each slice.
DRAWN = 32

#: Steps of the binary search among the splitters of a case; it has at most their sum of slices.
_STEPS = [1 << k for k in range(19, -1, -1)]


def is_large(log: DataFrame) -> bool:
    """By the planner's estimate; either way results are the same."""
    return int(str(log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES


def _splitters(log: DataFrame, case: str, order: tuple[str, ...], rows: int) -> DataFrame:
    """__case, __cuts: the sorted splitters of each case of more than `rows` rows; all in all a splitter for about `rows` rows."""
    large = log.groupBy(F.col(case).alias("__case")).agg(F.count("*").alias("__n")).where(F.col("__n") > rows).select("__case")
    drawn = log.where(F.pmod(F.xxhash64(*order), F.lit(max(1, rows // DRAWN))) == 0).select(F.col(case).alias("__of"), F.struct(*order).alias("__key"))
    keys = drawn.join(F.broadcast(large), F.col("__of").eqNullSafe(F.col("__case"))).groupBy("__case").agg(F.sort_array(F.collect_list("__key")).alias("__keys"))
    return keys.select("__case", F.filter("__keys", lambda k, i: i % DRAWN == DRAWN - 1).alias("__cuts"))


def _above(cuts: Column, key: Column) -> Column:
    """How many of the sorted cuts are at or below the key."""
    step = lambda at, width: F.when((at + width <= F.size(cuts)) & (F.get(cuts, at + width - 1) <= key), at + width).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)


def sliced(log: DataFrame, case: str, order: tuple[str, ...] = ("timestamp", "id"), rows: int = ROWS) -> DataFrame:
    """The log with __slice, null in cases that aren't cut. The splitters are broadcast: a row for every large case."""
    cuts = _splitters(log.select(case, *order), case, order, rows)
    out = log.join(F.broadcast(cuts), F.col(case).eqNullSafe(F.col("__case")), "left")
    return out.withColumn("__slice", F.when(F.col("__cuts").isNotNull(), _above(F.col("__cuts"), F.struct(*order)))).drop("__case", "__cuts")


def _of_slices(cut: DataFrame, case: str, **aggs: Column) -> DataFrame:
    """A row for each slice of the cases that are cut."""
    return cut.where("__slice is not null").groupBy(F.col(case).alias("__case"), F.col("__slice").alias("__s")).agg(*[c.alias(n) for n, c in aggs.items()])


def _with(cut: DataFrame, of_slices: DataFrame, case: str) -> DataFrame:
    on = F.col(case).eqNullSafe(F.col("__case")) & (F.col("__slice") == F.col("__s"))
    return cut.join(F.broadcast(of_slices), on, "left").drop("__case", "__s")


def following(log: DataFrame, *cols: str, case: str, order: tuple[str, ...] = ("timestamp", "id"), step: int = 1, rows: int = ROWS) -> DataFrame:
    """The log with next_<col>: the value `step` rows later in the case.

    The rows that a slice lacks are the first ones of the next slices: at most `step` of each are carried.
    """
    cut = sliced(log, case, order, rows)
    head = F.slice(F.sort_array(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))), 1, step)
    first = W.partitionBy(case, "__slice").orderBy(*order)
    heads = cut.where("__slice is not null").select(case, "__slice", *dict.fromkeys([*order, *cols])).withColumn("__i", F.row_number().over(first)).where(F.col("__i") <= step)
    later = F.slice(F.flatten(F.collect_list("__head").over(W.partitionBy("__case").orderBy("__s").rowsBetween(1, step))), 1, step)
    halo = _of_slices(heads, case, __head=head).select("__case", "__s", later.alias("__halo"))
    out = _with(cut, halo, case)
    left = F.count(F.lit(1)).over(first.rowsBetween(1, step))  # rows of the slice that follow, `step` at most
    value = lambda c: F.when(left == step, F.lead(c, step).over(first)).otherwise(F.get(F.col("__halo"), step - F.col("__left") - 1)[c])
    out = out.withColumn("__left", left.cast("int")).withColumns({f"next_{c}": value(c) for c in cols})
    return out.drop("__slice", "__halo", "__left")


def placed(log: DataFrame, case: str, order: tuple[str, ...] = ("timestamp", "id"), rows: int = ROWS) -> DataFrame:
    """The log with `place`, from 0: the number of rows before each in its case."""
    cut = sliced(log, case, order, rows)
    before = F.sum("__n").over(W.partitionBy("__case").orderBy("__s").rowsBetween(W.unboundedPreceding, -1))
    starts = _of_slices(cut, case, __n=F.count("*")).select("__case", "__s", before.alias("__before"))
    number = F.row_number().over(W.partitionBy(case, "__slice").orderBy(*order)) - 1
    return _with(cut, starts, case).withColumn("place", F.coalesce("__before", F.lit(0).cast("long")) + number).drop("__slice", "__before")
