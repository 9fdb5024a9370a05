"""Trace algebra over an event log (id, activity, timestamp, resource, cost, idcase).

Predicates are Columns for filter(); the rest are frames from frames. Nothing orders by timestamp alone:
id breaks ties, so first, last and next events are defined. `case` names the case column.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import slices

# --- predicates over single events -------------------------------------------------------------


def has_activity(name: str) -> Column:
    return F.col("activity") == name


def activity_in(*names: str) -> Column:
    return F.col("activity").isin(*names)


def activity_matches(part: str) -> Column:
    """Substring, ignoring case."""
    return F.contains(F.lower("activity"), F.lit(part.lower()))


def activity_starts_with(part: str) -> Column:
    return F.startswith(F.lower("activity"), F.lit(part.lower()))


def activity_ends_with(part: str) -> Column:
    return F.endswith(F.lower("activity"), F.lit(part.lower()))


def performed_by(name: str) -> Column:
    return F.col("resource") == name


def resource_defined() -> Column:
    return F.col("resource").isNotNull()


def resource_undefined() -> Column:
    return F.col("resource").isNull()


def cost_known() -> Column:
    return F.col("cost").isNotNull()


def cost_unknown() -> Column:
    return F.col("cost").isNull()


_COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__", "eq": "__eq__"}


def cost_is(op: str, value: float) -> Column:
    """op is gt, gte, lt, lte or eq."""
    return getattr(F.col("cost"), _COMPARE[op])(value)


def cost_between(low: float, high: float) -> Column:
    return F.col("cost").between(low, high)


def _ts(value: str | datetime) -> Column:
    return F.lit(datetime.fromisoformat(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def time_before(value: str) -> Column:
    return F.col("timestamp") < _ts(value)


def time_after(value: str) -> Column:
    return F.col("timestamp") > _ts(value)


def time_in(low: str, high: str) -> Column:
    """Both ends included, compared as timestamps."""
    return F.col("timestamp").between(_ts(low), _ts(high))


def in_year(year: int) -> Column:
    """From the year's first to the next year's first midnight, included, as the predicate is defined."""
    return time_in(f"{year}-01-01", f"{year + 1}-01-01")


def _half_open(start: date, end: date) -> Column:
    """A range on the bare column, which Parquet can use, unlike a formatted timestamp."""
    at = lambda d: _ts(datetime(d.year, d.month, d.day))
    return (F.col("timestamp") >= at(start)) & (F.col("timestamp") < at(end))


def in_month(year: int, month: int) -> Column:
    return _half_open(date(year, month, 1), date(year + month // 12, month % 12 + 1, 1))


def on_day(day: str) -> Column:
    d = date.fromisoformat(day)
    return _half_open(d, d + timedelta(days=1))


def year_prefix(year: int) -> Column:
    """The text form `timestamp LIKE '2016%'`."""
    return _half_open(date(year, 1, 1), date(year + 1, 1, 1))


def in_case(name: str, case: str = "idcase") -> Column:
    return F.col(case) == name


# --- entities and aggregates --------------------------------------------------------------------


def entity(log: DataFrame, key: str | None, where: Column | None = None, having: Column | None = None, **aggs: Column) -> DataFrame:
    """Rows (no key), or the different values of key with aggregates and a condition on them."""
    log = log if where is None else log.where(where)
    if key is None:
        return log
    if not aggs:
        return log.select(key).distinct()
    out = log.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
    return out if having is None else out.where(having)


def seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_timestamp((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def argmax_ties(log: DataFrame, key: str, metric: Column, least: bool = False) -> DataFrame:
    """key, m of all keys at the extreme of the metric. Keys of null metric don't count."""
    return top_ties(log, key, metric, 1, least)


def top_ties(log: DataFrame, key: str, metric: Column, n: int, least: bool = False) -> DataFrame:
    """key, m of the n best keys and of all that tie with the last of them.

    The cutoff is the n-th value by a distributed top-n; no window over all keys is needed.
    """
    grouped = log.groupBy(key).agg(metric.alias("m")).where("m is not null")
    order = F.asc("m") if least else F.desc("m")
    cut = grouped.select("m").orderBy(order).limit(n).agg((F.max if least else F.min)("m").alias("cut"))
    keep = F.col("m") <= F.col("cut") if least else F.col("m") >= F.col("cut")
    return grouped.join(F.broadcast(cut), keep).select(key, "m")


def case_duration(log: DataFrame, case: str = "idcase") -> DataFrame:
    """case, duration: whole seconds from a case's first to its last event."""
    return log.groupBy(case).agg((seconds(F.max("timestamp")) - seconds(F.min("timestamp"))).alias("duration"))


def throughput_days(log: DataFrame, case: str = "idcase") -> DataFrame:
    return case_duration(log, case).select(case, (F.col("duration") / 86400.0).alias("days"))


def first_event(log: DataFrame, *cols: str, case: str = "idcase") -> DataFrame:
    """The given columns of the first event of each case."""
    at = F.struct("timestamp", "id")
    return log.groupBy(case).agg(*[F.min_by(c, at).alias(c) for c in cols])


def last_event(log: DataFrame, *cols: str, case: str = "idcase") -> DataFrame:
    at = F.struct("timestamp", "id")
    return log.groupBy(case).agg(*[F.max_by(c, at).alias(c) for c in cols])


def trace(log: DataFrame, case: str = "idcase") -> DataFrame:
    """case, trace: the activities of a case in order, as an array."""
    events = F.sort_array(F.collect_list(F.struct("timestamp", "id", "activity")))
    return log.groupBy(case).agg(F.transform(events, lambda e: e["activity"]).alias("trace"))


def fingerprints(log: DataFrame, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    """case, length and two 64-bit sums (xor) of hashes of (place, activity): equal for cases of the same activities in the same order.

    Such sums are merged in any order and from any parts of a case, so no case is gathered; only places need its order.
    """
    rows = slices.ROWS if slice_rows is None else slice_rows
    log = log.select(case, "timestamp", "id", "activity")
    if slice_rows is None and not slices.is_large(log):
        at = log.withColumn("place", (F.row_number().over(W.partitionBy(case).orderBy("timestamp", "id")) - 1).cast("long"))
    else:
        at = slices.placed(log, case, rows=rows)
    sums = [F.bit_xor(F.xxhash64(F.lit(salt), "place", F.coalesce("activity", F.lit("")), F.col("activity").isNull())).alias(n) for n, salt in (("one", 1), ("two", 2))]
    return at.groupBy(case).agg(F.count("*").alias("length"), *sums)


def variants(log: DataFrame, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    """variant (activities joined by commas), cases.

    A small log's cases are spelled out at once. Those of a large one are grouped by fingerprint; only the first and the last
    case of each group are spelled out, and if these differ the query fails rather than counting unlike cases together.
    """
    if slice_rows is None and not slices.is_large(log):
        return trace(log, case).groupBy(F.array_join("trace", ",").alias("variant")).agg(F.count("*").alias("cases"))
    groups = fingerprints(log, case, slice_rows).groupBy("length", "one", "two").agg(F.count("*").alias("cases"), F.min(case).alias("__first"), F.max(case).alias("__last"))
    ends = groups.select("length", "one", "two", "cases", F.explode(F.array_distinct(F.array("__first", "__last"))).alias("__end"))
    spelled = log.select(case, "timestamp", "id", "activity").join(ends, F.col(case).eqNullSafe(F.col("__end")))
    each = spelled.groupBy("length", "one", "two", "cases", "__end").agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", "activity"))).alias("__events"))
    text = each.select("length", "one", "two", "cases", F.array_join(F.transform("__events", lambda e: e["activity"]), ",").alias("variant"))
    out = text.groupBy("length", "one", "two", "cases").agg(F.min("variant").alias("variant"), F.max("variant").alias("__other"))
    unlike = F.raise_error(F.lit("two variants have one fingerprint")).cast("string")
    checked = F.when(F.col("variant") == F.col("__other"), F.col("variant")).otherwise(unlike)
    return out.select(checked.alias("variant"), "cases").groupBy("variant").agg(F.sum("cases").alias("cases"))


def rework(log: DataFrame, case: str = "idcase") -> DataFrame:
    """case, rework: events beyond the first of each activity in a case."""
    each = log.groupBy(case, "activity").agg(F.count("*").alias("n"))
    return each.groupBy(case).agg(F.sum(F.col("n") - 1).alias("rework"))


def solely_by(log: DataFrame, name: str | None = None, case: str = "idcase") -> DataFrame:
    """Cases all of whose known resources are one, of the given name if any. Null resources don't count."""
    out = log.groupBy(case).agg(F.countDistinct("resource").alias("n"), F.min("resource").alias("resource")).where("n = 1")
    return (out if name is None else out.where(F.col("resource") == name)).select(case, "resource")


# --- membership of cases ------------------------------------------------------------------------


def _cases(log: DataFrame, where: Column, case: str) -> DataFrame:
    return log.where(where).select(case)


def lacks(log: DataFrame, where: Column, case: str = "idcase") -> DataFrame:
    """Cases without an event of the condition: one pass, no anti join. A null case is no case."""
    return log.where(F.col(case).isNotNull()).groupBy(case).agg(F.count_if(where).alias("n")).where("n = 0").select(case)


def satisfies_both(log: DataFrame, one: Column, other: Column, case: str = "idcase") -> DataFrame:
    return _cases(log, one, case).intersect(_cases(log, other, case))


def excludes(log: DataFrame, base: Column, excluded: Column, case: str = "idcase") -> DataFrame:
    return _cases(log, base, case).subtract(_cases(log, excluded, case))


def all_cost_null(log: DataFrame, case: str = "idcase") -> DataFrame:
    return excludes(log, cost_unknown(), cost_known(), case)


def both_but_not(log: DataFrame, one: Column, other: Column, third: Column, case: str = "idcase") -> DataFrame:
    """A intersect B except C, from left to right."""
    return satisfies_both(log, one, other, case).subtract(_cases(log, third, case))


def union_of(log: DataFrame, **conditions: Column) -> DataFrame:
    """n, grp: the number of events of each labelled condition, equal rows once. One pass over the log."""
    counts = log.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    rows = F.explode(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("grp")) for k in conditions]))
    return counts.select(rows.alias("r")).select("r.n", "r.grp").distinct()


# --- order inside a case ------------------------------------------------------------------------


def _ordered_pairs(log: DataFrame, ref: Column, later: bool, case: str, slice_rows: int | None) -> DataFrame:
    """The log with __at, the time of an event of the condition: a row for each such event before (later) or after a row in its case.

    Pairs of a case are as many as they are, but a large case isn't one key: its events are dealt by slices of its order, and
    each event of the condition goes to the slices that can hold its partners.
    """
    before = F.col("timestamp") > F.col("__at") if later else F.col("timestamp") < F.col("__at")
    if slice_rows is None and not slices.is_large(log):
        marked = log.where(ref).select(F.col(case).alias("__case"), F.col("timestamp").alias("__at"))
        return log.join(marked, (F.col(case) == F.col("__case")) & before).drop("__case")
    cut = slices.sliced(log, case, rows=slices.ROWS if slice_rows is None else slice_rows)
    own = F.col("__slice")
    sizes = cut.where(own.isNotNull()).groupBy(F.col(case).alias("__of")).agg(F.max("__slice").alias("__last"))
    marked = cut.where(ref).select(F.col(case).alias("__case"), F.col("timestamp").alias("__at"), own.alias("__own"))
    spread = marked.join(F.broadcast(sizes), F.col("__case").eqNullSafe(F.col("__of")), "left")
    to = F.sequence("__own", F.col("__last")) if later else F.sequence(F.lit(0), F.col("__own"))
    spread = spread.select("__case", "__at", F.explode(F.when(F.col("__own").isNotNull(), to).otherwise(F.array(F.lit(-1)))).alias("__s"))
    on = (F.col(case) == F.col("__case")) & (F.coalesce(own, F.lit(-1)) == F.col("__s")) & before
    return cut.join(spread, on).drop("__case", "__s", "__slice")


def events_after(log: DataFrame, activity: str, *cols: str, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    """Events after each occurrence of the activity in their case; an event comes once per occurrence."""
    return _ordered_pairs(log, has_activity(activity), True, case, slice_rows).select(*cols)


def events_before(log: DataFrame, activity: str, *cols: str, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    return _ordered_pairs(log, has_activity(activity), False, case, slice_rows).select(*cols)


def events_after_count(log: DataFrame, activity: str, case: str = "idcase") -> DataFrame:
    """case, n: how many rows events_after() has in each case, from running counts instead of its join.

    An event counts once for each earlier occurrence of the activity; events of one instant don't see
    each other. Cases without any row are left out.
    """
    at = log.groupBy(case, "timestamp").agg(F.count("*").alias("events"), F.count_if(has_activity(activity)).alias("hits"))
    before = F.sum("hits").over(W.partitionBy(case).orderBy("timestamp").rowsBetween(W.unboundedPreceding, -1))
    return at.withColumn("before", before).groupBy(case).agg(F.sum(F.col("events") * F.coalesce("before", F.lit(0))).alias("n")).where("n > 0")


def precedes(log: DataFrame, first: str, second: str, case: str = "idcase") -> DataFrame:
    """Cases in which some `first` comes before some `second`: its earliest before the latest of the other."""
    ends = log.where(activity_in(first, second)).groupBy(case).agg(F.min(F.when(has_activity(first), F.col("timestamp"))).alias("a"), F.max(F.when(has_activity(second), F.col("timestamp"))).alias("b"))
    return ends.where("a < b").select(case)


def elapsed_between(log: DataFrame, first: str, second: str, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    """case, elapsed: seconds for every pair of a `first` and a later `second` of a case."""
    log = log.where(activity_in(first, second)).select(case, "timestamp", "id", "activity")
    pairs = _ordered_pairs(log, has_activity(first), True, case, slice_rows).where(has_activity(second))
    return pairs.select(case, (seconds("timestamp") - seconds("__at")).alias("elapsed"))


def following(log: DataFrame, *cols: str, case: str = "idcase", step: int = 1, slice_rows: int | None = None) -> DataFrame:
    """The log with next_<col> for each given column: its value in the next event of the case.

    A large log's cases of more than slice_rows events are spread over several tasks (`slices`).
    """
    if slice_rows is not None or slices.is_large(log):
        return slices.following(log, *cols, case=case, step=step, rows=slices.ROWS if slice_rows is None else slice_rows)
    order = W.partitionBy(case).orderBy("timestamp", "id")
    return log.withColumns({f"next_{c}": F.lead(c, step).over(order) for c in cols})


def directly_follows(log: DataFrame, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    """activity, next_activity, n."""
    steps = following(log.select(case, "timestamp", "id", "activity"), "activity", case=case, slice_rows=slice_rows)
    return steps.where("next_activity is not null").groupBy("activity", "next_activity").agg(F.count("*").alias("n"))


def service_duration(log: DataFrame, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    """The log with service: seconds to the next event of the case, null at its end."""
    out = following(log, "timestamp", case=case, slice_rows=slice_rows)
    return out.withColumn("service", seconds("next_timestamp") - seconds("timestamp")).drop("next_timestamp")


def consecutive_repeat(log: DataFrame, other_resource: bool = False, case: str = "idcase", slice_rows: int | None = None) -> DataFrame:
    """Cases in which an activity directly follows itself, by another resource if so wished."""
    steps = following(log.select(case, "timestamp", "id", "activity", "resource"), "activity", "resource", case=case, slice_rows=slice_rows)
    same = F.col("activity") == F.col("next_activity")
    if other_resource:
        same &= F.col("resource") != F.col("next_resource")
    return steps.where(same).select(case).distinct()


def since_start(log: DataFrame, *activities: str, case: str = "idcase") -> DataFrame:
    """case and a column for each activity: seconds from the case's start to its first occurrence."""
    firsts = [F.min(F.when(has_activity(a), F.col("timestamp"))).alias(f"__{i}") for i, a in enumerate(activities)]
    out = log.groupBy(case).agg(F.min("timestamp").alias("__start"), *firsts)
    return out.select(case, *[(seconds(f"__{i}") - seconds("__start")).alias(a) for i, a in enumerate(activities)])
