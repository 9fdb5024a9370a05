"""Query op3_near_dedup and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .minhash import Scheme, near_duplicates


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of linked documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Scheme(size=4)).drop("hash", "first")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.common >= 80 * (na.n + nb.n - p.common)
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.d
), least_of AS (
  SELECT d, min(r) AS component_id FROM reach GROUP BY d
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN least_of c ON c.d = w.doc_id
"""
