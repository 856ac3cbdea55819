"""The queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from .ann import op9_nearest
from .decontaminate import op10_decontaminate
from .language_id import op4_language_id
from .license_scan import op5_license_scan
from .line_dedup import op3_line_dedup
from .mixing import op8_mixing
from .near_dedup import op6_near_dedup
from .preferences import op7_preferences
from .token_store import op2_token_store
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_store, op3_line_dedup, op4_language_id, op5_license_scan, op6_near_dedup, op7_preferences, op8_mixing, op9_nearest, op10_decontaminate)}

ORACLE_SQL = {
    "op7_preferences": """
WITH t AS (
  SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
g AS (
  SELECT pair_id, side, turn, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY role, text) AS s
  FROM t GROUP BY pair_id, side, turn),
d AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.turn, b.turn)) AS split
  FROM (SELECT * FROM g WHERE side = 0) a FULL JOIN (SELECT * FROM g WHERE side = 1) b
    ON a.pair_id = b.pair_id AND a.turn = b.turn
  WHERE a.s IS DISTINCT FROM b.s GROUP BY 1),
r AS (
  SELECT t.*, '<|' || role || '|>' || chr(10) || text || chr(10) AS s, split IS NULL OR turn < split AS common
  FROM t LEFT JOIN d USING (pair_id)),
p AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side, common ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM r)
SELECT pair_id,
  count(DISTINCT CASE WHEN common THEN turn END) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY turn, role, text) FILTER (WHERE common AND side = 0), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY turn, role, text) FILTER (WHERE NOT common AND side = 0), '') AS chosen,
  coalesce(string_agg(CAST(CAST(stop - length(s) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE NOT common AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY turn, role, text) FILTER (WHERE NOT common AND side = 1), '') AS rejected,
  coalesce(string_agg(CAST(CAST(stop - length(s) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE NOT common AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM p GROUP BY pair_id
""",
}
