"""Query of operator 2: the quality score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._shared import discard, saved, table
from corvane.llm.q_langid import fold
from corvane.llm.quality import document_statistics, score_quality, train_quality


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fold 2 of 4 is held out."""
    rows = document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    # Training reads these rows several times; they are joined once.
    known = saved(rows.where(fold("doc_id", 4) != 2).join(labels, "doc_id").select("stats", "label"), "labelled")
    out = score_quality(rows, train_quality(known))
    discard(known)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
