"""The event log derived from the table `events`, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EVENT_LOG = """
SELECT event_id AS id, event_type AS activity, ts AS timestamp,
       CASE WHEN k % 10 = 0 THEN NULL ELSE concat('r', CAST(k % 10 AS {text})) END AS resource,
       CASE WHEN event_type IN ('purchase', 'view') THEN value END AS cost,
       concat('case ', CAST(user_id AS {text})) AS idcase,
       concat(CAST(user_id AS {text}), '-', CAST(CAST(ts AS DATE) AS {text})) AS daycase
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

DUCK_LOG = _EVENT_LOG.format(text="VARCHAR", events="events")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, activity, timestamp, resource (nullable), cost (nullable), idcase, daycase (a short trace)."""
    return spark.sql(_EVENT_LOG.format(text="STRING", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
