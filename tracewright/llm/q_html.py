"""Query op4_html_main_text and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_template import extract


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"))


# What the template finds, by the marks that the pages at hand have: each has one article, of headings and paragraphs.
SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(body, '<br[^>]*>', ' ', 'g'), '</?(?:p|h[1-6])\b[^>]*>'), lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a
), t AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b
)
SELECT *, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
