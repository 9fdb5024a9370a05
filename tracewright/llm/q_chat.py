"""Query op1_preference_chat and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .chat import format_preferences, paired
from .common import table


def op1_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k+1 as preference pairs: a row for each rendered turn, prompts once."""
    return format_preferences(paired(table(spark, sf_dir, "conversations")))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 1 AS rejected, turn, role, text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, rejected, turn ORDER BY role NULLS FIRST, text NULLS FIRST) - 1 AS nth FROM t
), met AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.nth, r.nth) AS nth,
         c.pair_id IS NOT NULL AS has_c, r.pair_id IS NOT NULL AS has_r, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM (SELECT * FROM n WHERE NOT rejected) c FULL JOIN (SELECT * FROM n WHERE rejected) r ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.nth = r.nth
), marked AS (
  SELECT *, has_c AND has_r AND c_role IS NOT DISTINCT FROM r_role AND c_text IS NOT DISTINCT FROM r_text AS same FROM met
), parted AS (
  SELECT *, bool_and(same) OVER (PARTITION BY pair_id ORDER BY turn, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shared FROM marked
), rows_out AS (
  SELECT pair_id, 'prompt' AS part, turn, nth, c_role AS role, c_text AS text FROM parted WHERE shared
  UNION ALL SELECT pair_id, 'chosen', turn, nth, c_role, c_text FROM parted WHERE NOT shared AND has_c
  UNION ALL SELECT pair_id, 'rejected', turn, nth, r_role, r_text FROM parted WHERE NOT shared AND has_r
), rendered AS (
  SELECT pair_id, part, turn, CAST(nth AS INT) AS nth, role,
         '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered
  FROM rows_out
)
SELECT *, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 22 END AS loss_start, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(length(rendered) - 1 AS INT) END AS loss_end FROM rendered
"""
