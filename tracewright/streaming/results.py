"""Structured Streaming forms of what a run does row by row: append, resume, running totals, order in a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append(samples: DataFrame, path: str, checkpoint: str, form: str = "json", once: bool = True) -> StreamingQuery:
    """Each batch's rows are added to the files; the checkpoint makes a restart go on where it stopped."""
    writer = samples.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def resumed(samples: DataFrame, key: str = "id", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Without ids that came before; with a time column the state is dropped behind the watermark."""
    return samples.dropDuplicates([key]) if time is None else samples.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def running_totals(samples: DataFrame, *metrics: str) -> DataFrame:
    """Counts and means so far, for complete or update mode."""
    return samples.groupBy().agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"{m}_n") for m in metrics])


def windowed_counts(log: DataFrame, width: str, delay: str) -> DataFrame:
    """Events of each activity in tumbling windows of event time, late ones up to the delay."""
    timed = log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    out = timed.groupBy(F.window("timestamp", width).alias("w"), "activity").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "activity", "n")


def events_after(log: DataFrame, activity: str, within: str, delay: str, case: str = "idcase") -> DataFrame:
    """Events after an occurrence of the activity in their case, at most `within` later: a stream-stream join with bounded state."""
    timed = log.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ref = timed.where(F.col("activity") == activity).select(F.col(case).alias("ref_case"), F.col("timestamp").alias("ref_at")).withWatermark("ref_at", delay)
    later = timed.withWatermark("timestamp", delay)
    on = (F.col(case) == F.col("ref_case")) & (F.col("timestamp") > F.col("ref_at")) & (F.col("timestamp") <= F.col("ref_at") + F.expr(f"INTERVAL {within}"))
    return later.join(ref, on).drop("ref_case", "ref_at")
