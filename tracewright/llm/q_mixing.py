"""Query op9_source_mix and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, table
from .mixing import deal, planned


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    The mix is made in full, texts, shards and keys, and its rows are counted: a taking that is lost or
    doubled on the way to a shard shows in taken.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    facts = ["row", "doc_id", "size", "source_size", "target"]
    with Scratch(spark) as scratch:
        # numbered once and stored: the mix and the rows that it is counted for are two plans
        docs = scratch.keep(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        rows, plan = planned(docs)
        mixed = scratch.keep(deal(rows, plan).select("row", "doc_id", "text", "source", "shard", "mix_key"), "mix")
        times = mixed.groupBy("row").agg(F.count("*").alias("times"))
        taken = F.col("size") * F.coalesce(F.col("times"), F.lit(0))
        return checkpointed(rows.select(*facts).join(times, "row", "left").select(*facts[1:], taken.alias("taken")))


SQL = r"""
WITH docs AS (
  SELECT doc_id, size, src, key % 65536 AS cell, key FROM (
    SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce('s' || source, 'n') AS src,
           ('0x' || substr(md5('9:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15))::BIGINT AS key
    FROM documents) d
), sizes AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY src
), ranked AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][rank % 3 + 1] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY CAST(src = 'n' AS INT), src) - 1 AS rank FROM sizes) r
), levels AS (
  SELECT *, row_number() OVER o AS place,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank)
), targets AS (
  SELECT src, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, place) FROM levels WHERE level <= CAST(cap AS DOUBLE) / weight)) AS target,
         least(65536, greatest(1, CAST(ceil(source_size / 131072.0) AS BIGINT))) AS blocks
  FROM levels
), blocks AS (
  SELECT d.src, d.cell % t.blocks AS block, t.source_size, t.target, sum(d.size) AS words
  FROM docs d JOIN targets t ON t.src = d.src GROUP BY ALL
), upto AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         sum(words) OVER (PARTITION BY src ORDER BY ('0x' || substr(md5('9.block:' || src || ':' || CAST(block AS VARCHAR)), 1, 15))::BIGINT, block
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM blocks
), plan AS (
  SELECT src, block, source_size, target, whole + CAST(upto <= rest AS INT) AS whole, upto > rest AND upto - words < rest AS part, rest - (upto - words) AS gap
  FROM (SELECT *, target - whole * source_size AS rest FROM upto) u
), dealt AS (
  SELECT d.doc_id, d.size, d.key, p.* FROM docs d JOIN targets t ON t.src = d.src JOIN plan p ON p.src = d.src AND p.block = d.cell % t.blocks
), ordered AS (
  SELECT *, CASE WHEN part THEN sum(size) OVER o END AS run, row_number() OVER o AS turn
  FROM dealt WINDOW o AS (PARTITION BY src, block ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), gaps AS (
  SELECT *, gap - coalesce(max(CASE WHEN run <= gap THEN run END) OVER (PARTITION BY src, block), 0) AS missing FROM ordered
), best AS (
  SELECT src, block, arg_min(turn, (abs(size - missing), turn)) AS turn FROM gaps WHERE part AND run > gap AND abs(size - missing) < missing GROUP BY ALL
)
SELECT g.doc_id, g.size, g.source_size, g.target, CAST(g.size * (g.whole + CASE WHEN g.part AND (g.run <= g.gap OR g.turn = b.turn) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM gaps g LEFT JOIN best b ON b.src = g.src AND b.block = g.block
"""
