"""Query op8_sampled_shards and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sharding import shard


def op8_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document under the law `bytes`: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, law="bytes")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# Records in order of md5(text) and doc_id, cut by the middle of their bytes; CRC-32 byte by byte over its table.
SQL = r"""
WITH tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h,
         list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, size, h, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) AS text_crc32 FROM d, tbl
), placed AS (
  SELECT *, least(7, (2 * sum(size) OVER o - size) * 8 // (2 * sum(size) OVER ())) AS shard, row_number() OVER o AS n
  FROM c WINDOW o AS (ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM placed
"""
