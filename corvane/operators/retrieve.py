"""Inverted index, BM25, field, symbol and dense retrieval over batches of queries.

Every retriever takes queries (query_id, text) and returns ``ranked(query_id, rank, score, position)``. Query terms go to
the corpus in bounded blocks (``operators.scan``), and only the first chunks of each query are shuffled. Parts of a score are added as
integers of ``SCORE_UNIT``-ths, which is exact in any order, and ranked on nine decimals, then by position, so equal
documents cannot swap with the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import scan

K1, B = 1.5, 0.75
SCORE_UNIT = 1 << 40
TERM_LIMIT = 200_000


def small(df: DataFrame, limit: int = TERM_LIMIT) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, as counted; else left to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def require(value: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query by ``order``, ranked from 1; Spark prunes before the shuffle."""
    by = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= require(k, "top_k"))


def token_rows(chunks: DataFrame, text: Column, sizes: tuple[int, ...]) -> DataFrame:
    """position, term: a row for every token of a text; lower-casing runs on rows, in generated code."""
    raw = chunks.select("position", F.explode(T.unfolded_tokens(text, sizes)).alias("m"))
    return raw.select("position", F.explode(T.folded(F.col("m"))).alias("term"))


def labelled_rows(chunks: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Tokens of the labelled text that plain BM25 searches."""
    return token_rows(chunks, T.searchable_text(F.col("page_title"), F.col("section_title"), F.col("text")), sizes)


def term_frequencies(rows: DataFrame) -> DataFrame:
    """position, term, tf, length: the postings of token rows."""
    counted = rows.groupBy("position", "term").agg(F.count("*").alias("tf"))
    return counted.withColumn("length", F.sum("tf").over(Window.partitionBy("position")))


def corpus_statistics(chunks: DataFrame, n_tokens: DataFrame) -> DataFrame:
    """One row: n_docs and avg_length (over all chunks, 1.0 where there is nothing), from a table of counts ``tf``."""
    total = n_tokens.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    sizes = chunks.agg(F.count("*").alias("n_docs")).join(total)
    return sizes.select("n_docs", "n_tokens", F.coalesce(F.nullif(F.col("n_tokens") / F.nullif(F.col("n_docs"), F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("avg_length"))


def query_terms(queries: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """query_id, ord, term: distinct tokens of each query in order of first appearance."""
    return queries.select("query_id", F.posexplode(F.array_distinct(T.tokens(F.col("text"), sizes))).alias("ord", "term"))


def tokenless(queries: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """query_id of queries without any token, which plain BM25 rejects."""
    return queries.where(F.size(T.tokens(F.col("text"), sizes)) == 0).select("query_id")


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * (length / average)))


def _exact_bm25(hits: DataFrame, block: scan.Block, k1: float, b: float) -> tuple[Callable, Callable]:
    """What a posting adds to a score in ``SCORE_UNIT``-ths, and scores on nine decimals, for a block of queries."""
    sizes = hits.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens")).first()
    n_docs, average = sizes["n_docs"], sizes["n_tokens"] / sizes["n_docs"] if sizes["n_tokens"] else 1.0
    frequency = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = np.zeros(len(block.terms))
    for row in frequency.select("term", inverse_frequency(F.lit(n_docs), F.col("df")).alias("idf")).toLocalIterator():
        idf[row["term"]] = row["idf"]

    def unit(term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.floor(idf[term] * saturation(tf, length, average, k1, b) * float(SCORE_UNIT) + 0.5).astype(np.int64)

    return unit, lambda sums: np.floor(sums / float(SCORE_UNIT) * 1e9 + 0.5).astype(np.int64)


def ranked_bm25(texts: DataFrame, queries: DataFrame, k: int, sizes: tuple[int, ...], k1: float = K1, b: float = B, once: bool = False) -> DataFrame:
    """BM25 over texts (position, text); ``once``: over the variants of their identifiers, which count once."""
    asked = query_terms(queries, sizes).select("query_id", "term", F.lit(1).cast("bigint").alias("weight"))
    ranked = scan.ranked_batch(texts, asked, require(k, "top_k"), sizes, once, lambda hits, block: _exact_bm25(hits, block, k1, b))
    return ranked.select("query_id", "position", (F.col("unit") / F.lit(float(SCORE_UNIT))).alias("score"), "rank")


def labelled_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select("position", T.searchable_text(F.col("page_title"), F.col("section_title"), F.col("text")).alias("text"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 5, sizes: tuple[int, ...] = (2, 3), k1: float = K1, b: float = B) -> DataFrame:
    """BM25 over the labelled text of chunks."""
    return ranked_bm25(labelled_texts(chunks), queries, k, sizes, k1, b)


FIELDS = ("identifiers", "section_title", "page_title", "body")


def field_rows(chunks: DataFrame, field: str, sizes: tuple[int, ...] = (2,)) -> DataFrame:
    """Token rows of one isolated field of a chunk."""
    if field not in FIELDS:
        raise ValueError(f"unsupported retrieval field: {field}")
    if field == "identifiers":
        fields = T.symbol_fields(F.col("page_title"), F.col("section_title"), F.col("source_url"), F.col("text"))
        return chunks.select("position", F.explode(T.symbols(fields)).alias("term"))
    return token_rows(chunks, F.col("text" if field == "body" else field), sizes)


def field_texts(chunks: DataFrame, field: str) -> DataFrame:
    """position and text of one isolated field of a chunk."""
    if field not in FIELDS:
        raise ValueError(f"unsupported retrieval field: {field}")
    if field == "identifiers":
        return chunks.select("position", T.symbol_fields(F.col("page_title"), F.col("section_title"), F.col("source_url"), F.col("text")).alias("text"))
    return chunks.select("position", F.col("text" if field == "body" else field).alias("text"))


def field_bm25(chunks: DataFrame, queries: DataFrame, field: str, k: int = 5, sizes: tuple[int, ...] = (2,)) -> DataFrame:
    """BM25 over one field; queries without tokens find nothing."""
    return ranked_bm25(field_texts(chunks, field), queries, k, sizes, once=field == "identifiers")


def symbol_records(chunks: DataFrame) -> DataFrame:
    """The symbol sidecar: position, key, text hash and identifiers of each chunk."""
    fields = T.symbol_fields(F.col("page_title"), F.col("section_title"), F.col("source_url"), F.col("text"))
    return chunks.select("position", "source_url", "chunk_index", "start_index", T.text_sha256(F.col("text")).alias("text_sha256"), T.symbols(fields).alias("identifiers"))


def symbol_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, is_exact: every variant of a query's identifiers."""
    exact = T.distinct_identifiers(F.col("text"))
    variants = F.array_distinct(F.flatten(F.transform(exact, T.identifier_variants)))
    return queries.select("query_id", F.explode(variants).alias("term"), exact.alias("exact")).select("query_id", "term", F.array_contains("exact", F.col("term")).cast("int").alias("is_exact"))


def symbol_ranking(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` chunks of each query from its hits (query_id, position, is_exact): exact ones, then variants, then position."""
    counted = hits.groupBy("query_id", "position").agg(F.sum("is_exact").alias("exact_hits"), F.count("*").alias("variant_hits"))
    ranked = top_k(counted, k, F.desc("exact_hits"), F.desc("variant_hits"), F.col("position"))
    return ranked.select("query_id", "rank", (F.col("exact_hits") * 1000 + F.col("variant_hits")).cast("double").alias("score"), "position")


def symbol_search(records: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Chunks by exact identifier hits, then variant hits, then position; score = 1000 x exact + variants."""
    hits = records.select("position", F.explode("identifiers").alias("term")).join(small(symbol_terms(queries)), "term")
    return symbol_ranking(hits, k)


def ranked_symbols(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``symbol_search`` by a scan of the chunks."""
    asked = symbol_terms(queries).select("query_id", "term", (F.col("is_exact").cast("bigint") * F.lit(1 << 32) + 1).alias("weight"))
    one = lambda term, tf, length: np.ones(len(term), dtype=np.int64)
    ranked = scan.ranked_batch(field_texts(chunks, "identifiers"), asked, require(k, "top_k"), (), True, lambda hits, block: (one, lambda sums: sums))
    exact, variants = F.shiftright("unit", 32), F.col("unit").bitwiseAND(F.lit((1 << 32) - 1))
    return ranked.select("query_id", "rank", (exact * 1000 + variants).cast("double").alias("score"), "position")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


QUERY_BLOCK = 4096


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact inner-product search: queries (query_id, vector) against vectors (position, vector).

    Queries go to the tasks in blocks of ``QUERY_BLOCK`` (a bounded broadcast, one scan of the vectors each); a task multiplies
    batches of vectors with the block and hands on what can be among the k best of a query, so no vector is shuffled. Ties
    (on six decimals) go to the lower position. Null vectors and vectors of another size than the query's take no part.
    """
    require(k, "top_k")
    spark = vectors.sparkSession
    rows = vectors.select("position", F.col("vector").cast("array<double>").alias("vector")).dropna()
    every: DataFrame | None = None
    for block in _query_blocks(queries):
        found = rows.mapInArrow(_best_of(spark.sparkContext.broadcast(block), k), "query_id bigint, position bigint, score double")
        every = found if every is None else every.unionByName(found)
    if every is None:
        every = spark.createDataFrame([], "query_id bigint, position bigint, score double")
    return top_k(every, k, F.desc(F.round("score", 6)), F.col("position")).select("query_id", "rank", "score", "position")


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, in blocks of vectors of one size."""
    held: list[tuple[int, list[float]]] = []
    for row in queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).dropna().orderBy(F.size("vector")).toLocalIterator():
        if held and (len(held) == QUERY_BLOCK or len(row[1]) != len(held[0][1])):
            yield np.array([q for q, _ in held]), np.array([v for _, v in held])
            held = []
        held.append((row[0], row[1]))
    if held:
        yield np.array([q for q, _ in held]), np.array([v for _, v in held])


def _best_of(shared, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        floor = np.full(len(ids), -np.inf)  # of the k-th score so far
        top = np.full((len(ids), k), -np.inf)
        for batch in batches:
            size = asked.shape[1]
            fit = pc.equal(pc.list_value_length(batch.column(1)), size)
            some = batch.filter(fit)
            for at in range(0, some.num_rows, 1024):
                part = some.slice(at, 1024)
                scores = asked @ part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).T
                # Scores are ranked on six decimals, so whatever may round to the k-th goes on.
                query, place = np.nonzero(scores >= floor[:, None] - 2e-6)
                if len(query):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query]), part.column(0).take(pa.array(place)), pa.array(scores[query, place])], names=["query_id", "position", "score"])
                top = -np.sort(-np.concatenate([top, scores], axis=1), axis=1)[:, :k]
                floor = top[:, -1]

    return scan
