"""Sinks: what a run writes. Folders of part files unless a single file is asked for by the format."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str]) -> bool:
    """CSV with header and the given columns in order; nothing is written when there are no rows."""
    if df.isEmpty():
        return False
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
    return True


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def scores(df: DataFrame, path: str, metric: str, mode: str = "append") -> None:
    """run_id, predicted, gold, difficulty, score of the samples that have the score; no quoting."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\t\r\n]+", " ")
    cols = [F.col("id"), flat("predicted_sql"), flat("gold_sql"), F.col("hardness"), F.col(metric).cast("string")]
    df.where(F.col(metric).isNotNull()).select(F.concat_ws("\t", *cols).alias("value")).write.mode(mode).option("lineSep", "\r\n").text(path)


def statements(df: DataFrame, path: str, order: str) -> None:
    """One predicted statement a line, in the order of the gold file."""
    df.orderBy(order).select(F.coalesce("predicted_sql", F.lit("")).alias("value")).write.mode("overwrite").text(path)


def totals(scored: DataFrame) -> dict[str, Any]:
    """The closing figures of a run: scores, tokens and throughput as ratios of sums; null without data."""
    timed = F.col("prompt_n").isNotNull() | F.col("predicted_n").isNotNull()
    r = scored.agg(
        F.count("*").alias("n"), F.count("error").alias("failed"), F.avg("em").alias("em"), F.avg("ex").alias("ex"), F.sum("total_tokens").alias("tokens"), F.count("total_tokens").alias("token_n"),
        F.count_if(timed).alias("timed"), *[F.sum(c).alias(c) for c in ("prompt_n", "prompt_ms", "predicted_n", "predicted_ms")],
    ).first()
    out = {"samples_total": r["n"], "samples_failed": r["failed"], "em_score": r["em"], "ex_score": r["ex"], "total_tokens": r["tokens"], "tokens_per_query": round(r["tokens"] / r["token_n"], 2) if r["token_n"] else None}
    for k in ("prompt", "predicted"):
        n, ms = (r[f"{k}_n"], r[f"{k}_ms"]) if r["timed"] else (None, None)
        out |= {f"{k}_n": n, f"{k}_ms": None if ms is None else round(ms, 3), f"{k}_per_token_ms": round(ms / n, 6) if n and ms is not None else None, f"{k}_per_second": round(n / (ms / 1000), 2) if ms and n is not None else None}
    return out


def plain(value: Any) -> Any:
    """JSON-ready: NumPy scalars become Python's, NaN becomes null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    value = value.item() if hasattr(value, "item") else value
    return None if isinstance(value, float) and math.isnan(value) else value


def _located(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _located(spark, path)
    return fs.exists(found)


def discard(spark: SparkSession, path: str) -> None:
    found, fs = _located(spark, path)
    fs.delete(found, True)


def metadata(spark: SparkSession, values: dict[str, Any], path: str) -> None:
    """One JSON file, in the file system that Spark finds the path in."""
    found, fs = _located(spark, path)
    out = fs.create(found, True)
    try:
        out.write(bytearray(json.dumps(plain(values), indent=2).encode()))
    finally:
        out.close()


def report(title: str, df: DataFrame, rows: int = 50) -> None:
    """A console table of an aggregate frame."""
    print(f"\n{title}\n{'=' * len(title)}")
    df.show(rows, truncate=False)
