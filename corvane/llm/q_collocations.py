"""Query of operator 13: the phrase collocations of every language, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm._shared import table
from corvane.llm.collocations import collocations


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first 2000 phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\f\r]')) AS piece FROM texts)
), words AS (
  SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces)
), runs AS (
  SELECT lang, w AS w1, lead(w) OVER (PARTITION BY id ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY id ORDER BY i) AS w3 FROM words
), grams AS (
  SELECT lang, 1 AS size, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 10
), sides AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), lefts AS (
  SELECT s.*, x.f AS l FROM sides s JOIN counts x ON x.lang = s.lang AND x.phrase = s.lp
), cuts AS (
  SELECT s.*, y.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM lefts s JOIN counts y ON y.lang = s.lang AND y.phrase = s.rp
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM candidates WHERE size = 3
  ) GROUP BY ALL
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, n, score
  FROM lowest c JOIN totals USING (lang) LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
)
SELECT * FROM ranked WHERE rank <= 2000
"""
