"""Query op2_fuzzy_lines and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lines import dedup_lines


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the number of lines, how many are kept, and the sum of the kept ones' places: doc_id, n_lines, n_kept, kept_places."""
    decided = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x)
    each = decided.select("doc_id", *[(c * F.col("rows")).alias(n) for n, c in (("n_lines", F.col("n_lines")), ("n_kept", F.size("kept")), ("kept_places", places))])
    return each.groupBy("doc_id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_kept").alias("n_kept"), F.sum("kept_places").alias("kept_places"))


# Links by an exact prefix filter: two linked lines share one of their rarest n - ceil(0.8 n) + 1 shingles.
SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL
), n AS (
  SELECT doc_id, place, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l
), u AS (
  SELECT norm, min({'d': coalesce(doc_id, -9223372036854775808), 'p': place}) AS spot, row_number() OVER (ORDER BY norm) AS id FROM n WHERE norm <> '' GROUP BY norm
), s AS (
  SELECT DISTINCT id, hash(substr(norm, i, 8)) AS sh FROM (SELECT id, norm, unnest(range(1, greatest(len(norm) - 7, 1) + 1)) AS i FROM u)
), ns AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), f AS (
  SELECT sh, count(*) AS f FROM s GROUP BY sh
), p AS (
  SELECT id, sh, n FROM (SELECT s.id, s.sh, ns.n, row_number() OVER (PARTITION BY s.id ORDER BY f.f, s.sh) AS k FROM s JOIN f USING (sh) JOIN ns USING (id))
  WHERE k <= n - (80 * n + 99) // 100 + 1
), c AS (
  SELECT DISTINCT x.id AS a, y.id AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.sh = y.sh AND x.id < y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
), links AS (
  SELECT a, b FROM (SELECT c.a, c.b, c.na, c.nb, count(*) AS common FROM c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b AND y.sh = x.sh GROUP BY ALL)
  WHERE 100 * common >= 80 * (na + nb - common)
), e AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS d, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.d
), comp AS (
  SELECT d AS id, min(r) AS c FROM reach GROUP BY d
), owner AS (
  SELECT coalesce(comp.c, u.id) AS c, min(spot) AS spot FROM u LEFT JOIN comp USING (id) GROUP BY 1
), lines AS (
  SELECT n.doc_id, n.place, n.norm = '' OR {'d': coalesce(n.doc_id, -9223372036854775808), 'p': n.place} = owner.spot AS kept
  FROM n LEFT JOIN u ON u.norm = n.norm AND n.norm <> '' LEFT JOIN comp USING (id) LEFT JOIN owner ON owner.c = coalesce(comp.c, u.id)
)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(kept) AS BIGINT) AS n_kept, CAST(coalesce(sum(CASE WHEN kept THEN place END), 0) AS BIGINT) AS kept_places FROM lines GROUP BY doc_id
"""
