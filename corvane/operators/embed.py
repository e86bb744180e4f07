"""Embedding build: chunks to unit vectors by a provider, with prefixes, and the checks of a stored vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

Encoder = Callable[[Column], Column]


def normalised(vector: Column) -> Column:
    """The vector at length one, so that inner products are cosines; null for a zero, empty or non-finite vector."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length = F.sqrt(squares)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & (length > 0) & (length < float("inf"))
    return F.when(fine, F.transform(vector, lambda x: (x / length).cast("float")))


def embed_chunks(chunks: DataFrame, encode: Encoder, prefix: str = "") -> DataFrame:
    """position, text_sha256, vector of every chunk. ``encode`` maps a text column to a vector column: an expression, or a
    pandas UDF for a model, which Spark runs over Arrow batches where the chunks lie; ``prefix`` precedes every passage."""
    text = F.concat(F.lit(prefix), T.searchable_text(F.col("page_title"), F.col("section_title"), F.col("text")))
    return chunks.select("position", T.text_sha256(F.col("text")).alias("text_sha256"), normalised(encode(text)).alias("vector"))


def embed_queries(queries: DataFrame, encode: Encoder, prefix: str = "") -> DataFrame:
    """query_id, vector of every question."""
    return queries.select("query_id", normalised(encode(F.concat(F.lit(prefix), F.col("text")))).alias("vector"))


def hashed_words(size: int = 64) -> Encoder:
    """The deterministic provider: words counted by hash, with a sign."""

    def encode(text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
        places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
        signs = F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(F.lit("sign"), w), F.lit(2)) == 0, 1.0).otherwise(-1.0))
        pairs = F.arrays_zip(places.alias("place"), signs.alias("sign"))
        total = lambda k: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(p["place"] == k, p["sign"]).otherwise(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), total)

    return encode


def vector_problems(vectors: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """position, problem of a stored vector table: missing, extra, stale (another text), wrong_size or not_unit."""
    now = chunks.select("position", T.text_sha256(F.col("text")).alias("now"))
    met = vectors.select("position", "text_sha256", "vector").join(now, "position", "full_outer")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    problem = (
        F.when(F.col("now").isNull(), "extra").when(F.col("vector").isNull(), "missing").when(F.col("now") != F.col("text_sha256"), "stale")
        .when(F.size("vector") != size, "wrong_size").when(F.abs(length - 1) > 1e-3, "not_unit")
    )
    return met.select("position", problem.alias("problem")).where("problem IS NOT NULL")
