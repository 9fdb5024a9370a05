"""Query op7_warc and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .common import checkpointed, discard, table
from .warc import archived, read_archives


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as read back from archives: page_id, payload_bytes, payload_digest, record_type, refers_to, problem (null).

    The archives are removed once they have been read.
    """
    archives, folder = archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    read = read_archives(archives, folder, payloads=False)
    out = checkpointed(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"))
    discard(spark, folder)
    return out


# The digest: 160 bits in groups of 40, each as eight characters of five bits.
SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), last AS (
  SELECT h, max(page_id) AS last FROM p GROUP BY h
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((('0x' || substr(p.h, CAST((i // 8) * 10 + 1 AS INT), 10))::BIGINT >> CAST(5 * (7 - i % 8) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p JOIN last ON last.h = p.h
"""
