"""Query op12_vector_codes and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, table
from .vectorcode import compress


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of embeddings by four codebooks of 256 entries after four rounds, with their errors, summed by label too."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    with Scratch(spark) as scratch:
        return checkpointed(compress(rows, scratch).withColumnRenamed("id", "vec_id").drop("label"))


def _round(n: int) -> str:
    """Codebooks n + 1 (c{n+1}) of codebooks n, by the nearest entries of codebooks n (a{n})."""
    return f"""
), d{n} AS (
  SELECT x.r, x.p, c.e, list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v) AS dist FROM x JOIN c{n} c ON x.p = c.p
), a{n} AS (
  SELECT r, p, e, dist FROM d{n} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY dist, e) = 1
), m{n} AS (
  SELECT p, e, i, floor(sum(y) / count(*)) AS y
  FROM (SELECT a.p, a.e, unnest(x.v) AS y, unnest(range(len(x.v))) AS i FROM a{n} a JOIN x ON x.r = a.r AND x.p = a.p) GROUP BY p, e, i
), c{n + 1} AS (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS v FROM m{n} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e"""


SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM k, range(4) t(p)
), c0 AS (
  SELECT p, r AS e, v FROM x WHERE r < 256{"".join(map(_round, range(4)))}
), d4 AS (
  SELECT x.r, x.p, c.e, list_inner_product(x.v, x.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v) AS dist FROM x JOIN c4 c ON x.p = c.p
), a4 AS (
  SELECT r, p, e, dist FROM d4 QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY dist, e) = 1
), coded AS (
  SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a4 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS i FROM c4)) AS codebooks_sha256
FROM coded JOIN k ON k.r = coded.r
"""
