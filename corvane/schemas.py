"""Schemas (as DDL) of the relations that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_DOCUMENT = "source_url string, canonical_url string, content string, content_sha256 string, source_kind string, logical_path string, category string, fetched_at string, metadata string"
SECTION = "text string, page_title string, section_title string, source_path string, source_url string, anchor string, category string, python_version string"
CHUNK = "position bigint, text string, page_title string, section_title string, source_url string, category string, chunk_index int, start_index int"
RANKED = "query_id bigint, rank int, score double, position bigint"
CITATION = "label string, page_title string, section_title string, url string"
#: A ranking names its chunk by (source_url, chunk_index, start_index); ``position`` is its place in the corpus.
KEY = ["source_url", "chunk_index", "start_index"]


def document_url(lang, doc_id):
    """The URL that stands for a document; ids are padded so that no URL holds another's."""
    return F.concat(F.lit("https://docs.example/"), lang, F.lit("/"), F.lpad(doc_id.cast("string"), 8, "0"), F.lit("/"))


def document_chunks(docs: DataFrame) -> DataFrame:
    """``documents`` read as one chunk each; a chunk's position is its document id, which keeps corpus order."""
    return docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("position"),
        "text",
        F.coalesce("source", F.lit("")).alias("page_title"),
        F.regexp_extract("text", r"\A[^.\n]*", 0).alias("section_title"),
        document_url(F.coalesce("lang", F.lit("")), F.col("doc_id")).alias("source_url"),
        F.coalesce("lang", F.lit("")).alias("category"),
        F.lit(0).alias("chunk_index"),
        F.lit(0).alias("start_index"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
