"""Rank fusion, reranking and parent expansion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import scratch
from corvane.operators.retrieve import require, small, top_k

TECHNICAL_FIELDS = ("identifiers", "section_title", "page_title", "body_dense", "body_lexical")


def field_weights(identifiers: float = 1.0, titles: float = 1.0) -> dict[str, float]:
    """Weights of the technical fields; body lists always weigh 1."""
    return {f: identifiers if f == "identifiers" else titles if f.endswith("title") else 1.0 for f in TECHNICAL_FIELDS}


#: The four presets.
FIELD_WEIGHTS = {
    "equal": field_weights(),
    "identifier_priority": field_weights(identifiers=3.0),
    "title_priority": field_weights(titles=2.0),
    "identifier_title_priority": field_weights(identifiers=3.0, titles=2.0),
}


def fuse(lists: Sequence[tuple[DataFrame, float]], k: int = 5, rrf_k: int = 60, candidate_k: int = 20) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists, in their order.

    A list is cut to ``candidate_k`` first; a key that a list repeats counts once, at its best rank, and later ranks keep
    their numbers. Order: score, best rank, first appearance (list, then rank), position.
    """
    if len(lists) < 2:
        raise ValueError("fusion requires at least two retrievers")
    require(rrf_k, "rrf_k"), require(candidate_k, "candidate_k")
    if any(weight <= 0 for _, weight in lists):
        raise ValueError("weights must be positive")
    every: DataFrame | None = None
    for nth, (ranked, weight) in enumerate(lists):
        rows = ranked.where(F.col("rank") <= candidate_k).select("query_id", "position", "rank", F.lit(nth).alias("nth"), F.lit(float(weight)).alias("weight"))
        every = rows if every is None else every.unionByName(rows)
    once = every.groupBy("query_id", "position", "nth", "weight").agg(F.min("rank").alias("rank"))
    parts = F.array_sort(F.collect_list(F.struct("nth", "rank", "weight")))
    fused = once.groupBy("query_id", "position").agg(
        F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["weight"] / (F.lit(float(rrf_k)) + p["rank"])).alias("score"),
        F.min("rank").alias("best_rank"),
        F.min(F.struct("nth", "rank")).alias("first_seen"),
    )
    return top_k(fused, k, F.desc(F.round("score", 12)), F.col("best_rank"), F.col("first_seen"), F.col("position"))


def lexical_overlap(query: Column, document: Column) -> Column:
    """The deterministic pair scorer: share of the query's distinct tokens that the document has."""
    asked = F.array_distinct(T.tokens(query, (2,)))
    return F.coalesce(F.size(F.array_intersect(asked, T.tokens(document, (2,)))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """Candidates in the order of a pair scorer, then of their rank; the trace is in the extra columns.

    ``scorer`` maps the question and the labelled document to a score: an expression here, a pandas UDF for a model.
    """
    document = T.searchable_text(F.col("page_title"), F.col("section_title"), F.col("chunk_text"))
    texts = chunks.select("position", "page_title", "section_title", F.col("text").alias("chunk_text"))
    asked = queries.select("query_id", F.col("text").alias("question"))
    pairs = candidates.select("query_id", "position", F.col("rank").alias("original_rank"), F.col("score").alias("retrieval_score")).join(small(asked), "query_id")
    pairs = texts.join(small(scratch.written(pairs, "pairs")), "position")
    scored = pairs.select("query_id", "position", "original_rank", "retrieval_score", scorer(F.col("question"), document).alias("score"))
    checked = scored.withColumn("score", F.when(F.isnan("score") | (F.abs("score") == float("inf")), F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(F.col("score")))
    ranked = top_k(checked, k, F.desc(F.round("score", 9)), F.col("original_rank"), F.col("position"))
    return ranked.withColumn("rank_change", F.col("original_rank") - F.col("rank"))


def expand_to_parents(children: DataFrame, mapping: DataFrame, k: int = 5) -> DataFrame:
    """Ranked children (query_id, rank, score, position) to their parents, by each parent's first child.

    ``mapping``: position, parent_id. Every child must resolve; ``unresolved`` lists those that do not.
    """
    met = mapping.join(small(children), "position")
    of_parent = Window.partitionBy("query_id", "parent_id")
    first = met.withColumn("nth", F.row_number().over(of_parent.orderBy("rank"))).withColumn("child_hits", F.count("*").over(of_parent)).where("nth = 1")
    return top_k(first.withColumnRenamed("rank", "child_rank"), k, F.col("child_rank")).select("query_id", "rank", "score", "parent_id", F.col("position").alias("child_position"), "child_rank", "child_hits")


def unresolved(children: DataFrame, mapping: DataFrame) -> DataFrame:
    return children.join(mapping, "position", "left_anti").select("position").distinct()


def expansion_trace(children: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per query: children, parents, compression ratio and the most children of a parent."""
    hits = mapping.join(small(children), "position").groupBy("query_id", "parent_id").agg(F.count("*").alias("n"))
    return hits.groupBy("query_id").agg(F.sum("n").alias("n_children"), F.count("*").alias("n_parents"), (F.count("*") / F.sum("n")).alias("compression_ratio"), F.max("n").alias("max_children"))
