"""Query of operator 3: the benchmark items found in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm._shared import table
from corvane.llm.decontam import find_contamination


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, distance of each item found in a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark"))
