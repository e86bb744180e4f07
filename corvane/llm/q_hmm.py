"""Query of operator 5: the likelihood of every document under unigrams and under the hidden Markov model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._shared import table
from corvane.llm.hmm import score_texts
from corvane.llm.q_langid import fold


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; fold 0 of 10 is held out."""
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 10) != 0)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
