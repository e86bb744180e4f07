"""Query of operator 12: the prefix trie of the rebuilt conversations, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm._shared import table
from corvane.llm.trie import prefix_trie


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal number's digits, bit by bit.
_STEP = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {_STEP}), 4294967295)"

ORACLE = f"""
WITH turns AS (
  SELECT conv, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS ord
  FROM (SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv, conv - conv % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv FROM turns)
), pieces AS (
  SELECT c.conv, 0 AS part, t.ord, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.base AND t.ord <= c.h
  UNION ALL SELECT c.conv, 1, t.ord, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.conv AND t.ord > c.h
), paths AS (
  SELECT conv, coalesce(path, []) AS path FROM convs LEFT JOIN (SELECT conv, list({{'r': role, 't': text}} ORDER BY part, ord) AS path FROM pieces GROUP BY conv) USING (conv)
), occ AS (
  SELECT conv, d AS depth, path[:d] AS node, len(path) = d AS ended FROM (SELECT conv, path, unnest(range(0, len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT depth, node, min(conv) AS owner, count(*) AS n,
    sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE ended), '')) AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS words,
    count(*) FILTER (WHERE ended) = count(*) AS leaf
  FROM occ GROUP BY depth, node
), sums AS (
  SELECT up AS depth, node[:up] AS node, sum((n - 1) * words) AS tokens, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE depth = up + 1) AS children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) GROUP BY ALL
)
SELECT n.owner AS conv_id, n.depth, p.owner AS parent_conv_id, n.n AS n_convs, s.children AS n_children, s.leaves AS n_leaves,
  CAST(s.tokens AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1] AND n.depth > 0
"""
