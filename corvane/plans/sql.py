"""Parts of the DuckDB SQL that checks the queries: each gives common table expressions under a prefix."""

from __future__ import annotations

#: The identifier without a lookbehind, which RE2 lacks: digit-led words are matched too and then left out.
IDENT = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\[[0-9]+\])?(?:\(\))?|[0-9][A-Za-z0-9_]*"
RUN = "[぀-ヿ㐀-䶿一-鿿々〆ヵヶー]+"

CHUNKS = r"""chunks AS (
  SELECT doc_id AS position, text, coalesce(source, '') AS page_title, regexp_extract(text, '\A[^.\n]*') AS section_title,
    'https://docs.example/' || coalesce(lang, '') || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '/' AS source_url, coalesce(lang, '') AS category
  FROM documents WHERE text IS NOT NULL)"""
QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
LABELLED = "'ページタイトル: ' || page_title || chr(10) || 'セクションタイトル: ' || section_title || chr(10) || '本文: ' || text"
SYMBOL_TEXT = "page_title || chr(10) || section_title || chr(10) || replace(source_url, 'https://docs.example', '') || ' ' || chr(10) || text"


def idents(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{IDENT}'), lambda x: NOT regexp_matches(x, '^[0-9]'))"


def variants(p: str, src: str, key: str, text: str) -> str:
    """{p}_var(key, v, folded): forms of every identifier before lower-casing, and their lower-case copy if it differs."""
    suffix = "list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.'))"
    return f"""
{p}_id AS (SELECT {key} AS key, unnest({idents(text)}) AS m FROM {src}),
{p}_form AS (SELECT key, m, ends_with(m, '()') AS call, CASE WHEN ends_with(m, '()') THEN left(m, length(m) - 2) ELSE m END AS bare FROM {p}_id),
{p}_part AS (SELECT *, regexp_replace(bare, '\\[[0-9]+\\]$', '') AS plain, string_split(regexp_replace(bare, '\\[[0-9]+\\]$', ''), '.') AS parts FROM {p}_form),
{p}_var AS (SELECT key, unnest(list_distinct([m, bare, plain] || {suffix} || CASE WHEN call THEN list_transform({suffix}, lambda s: s || '()') ELSE [] END || parts)) AS v FROM {p}_part)"""


def tokens(p: str, src: str, key: str, text: str, sizes: tuple[int, ...]) -> str:
    """{p}_tok(key, term): every token, repeats included."""
    grams = "".join(f"\n  UNION ALL SELECT key, unnest(list_transform(range(1, length(run) - {n} + 2), lambda i: substr(run, i, {n}))) FROM {p}_run" for n in sizes)
    return variants(p, src, key, text) + f""",
{p}_run AS (SELECT {key} AS key, unnest(regexp_extract_all({text}, '{RUN}')) AS run FROM {src}),
{p}_tok AS (SELECT key, v AS term FROM {p}_var UNION ALL SELECT key, lower(v) FROM {p}_var WHERE lower(v) <> v{grams})"""


def symbols(p: str, src: str) -> str:
    """{p}_tok(key, term): each symbol of a chunk once."""
    return variants(p, src, "position", SYMBOL_TEXT) + f""",
{p}_tok AS (SELECT DISTINCT key, term FROM (SELECT key, v AS term FROM {p}_var UNION ALL SELECT key, lower(v) FROM {p}_var))"""


def bm25(p: str, docs: str, asked: str, k: int) -> str:
    """{p}(query_id, rank, position, score) from {docs}_tok and {asked}_tok."""
    return f"""
{p}_tf AS (SELECT key, term, count(*) AS tf FROM {docs}_tok GROUP BY ALL),
{p}_len AS (SELECT key, sum(tf) AS n FROM {p}_tf GROUP BY ALL),
{p}_all AS (SELECT (SELECT count(*) FROM chunks) AS n_docs, coalesce(nullif((SELECT sum(n) FROM {p}_len) / (SELECT count(*) FROM chunks), 0), 1.0) AS average),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY ALL),
{p}_score AS (
  SELECT q.key AS query_id, t.key AS position,
    sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1.0 - 0.75 + 0.75 * (n / average))))) AS score
  FROM (SELECT DISTINCT key, term FROM {asked}_tok) q JOIN {p}_tf t USING (term) JOIN {p}_df USING (term) JOIN {p}_len l ON l.key = t.key CROSS JOIN {p}_all GROUP BY ALL),
{p} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS INTEGER) AS rank, position, score FROM {p}_score) WHERE rank <= {k})"""


def symbol_search(p: str, k: int) -> str:
    """{p}(query_id, rank, position, score) by symbols of chunks and queries."""
    return symbols(f"{p}d", "chunks") + "," + variants(f"{p}q", "queries", "query_id", "text") + f""",
{p}_exact AS (SELECT DISTINCT key, m AS term FROM {p}q_id),
{p}_asked AS (SELECT DISTINCT key, term FROM (SELECT key, v AS term FROM {p}q_var UNION ALL SELECT key, lower(v) FROM {p}q_var)),
{p}_hits AS (SELECT a.key AS query_id, d.key AS position, count(*) AS variants, count(e.term) AS exact
  FROM {p}_asked a JOIN {p}d_tok d USING (term) LEFT JOIN {p}_exact e ON e.key = a.key AND e.term = a.term GROUP BY ALL),
{p} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, variants DESC, position) AS INTEGER) AS rank, position, CAST(exact * 1000 + variants AS DOUBLE) AS score FROM {p}_hits) WHERE rank <= {k})"""


def dense(p: str, k: int) -> str:
    """{p}(query_id, rank, position, score): vectors of the queries' ids against all vectors."""
    return f"""
{p}_score AS (SELECT q.query_id, v.vec_id AS position, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM queries q JOIN embeddings e ON e.vec_id = q.query_id CROSS JOIN embeddings v),
{p} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, position) AS INTEGER) AS rank, position, score FROM {p}_score) WHERE rank <= {k})"""


def fuse(p: str, lists: list[tuple[str, float]], k: int, rrf_k: int, candidate_k: int) -> str:
    """{p}(query_id, rank, position, score) from ranked lists and weights."""
    every = " UNION ALL ".join(f"SELECT query_id, position, rank, {n} AS nth, CAST({w} AS DOUBLE) AS weight FROM {name} WHERE rank <= {candidate_k}" for n, (name, w) in enumerate(lists))
    return f"""
{p}_all AS ({every}),
{p}_score AS (SELECT query_id, position, sum(weight / ({rrf_k}.0 + rank)) AS score, min(rank) AS best, min(nth * 1000000 + rank) AS seen FROM {p}_all GROUP BY ALL),
{p} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, seen, position) AS INTEGER) AS rank, position, score FROM {p}_score) WHERE rank <= {k})"""


def ranked(name: str) -> str:
    return f"SELECT query_id, rank, position, round(score, 6) AS score FROM {name}"
