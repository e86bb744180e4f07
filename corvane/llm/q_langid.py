"""Query of operator 7: the language of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._shared import table
from corvane.llm.langid import identify_languages, train_languages


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; fold 0 of 5 is held out."""
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(fold("doc_id", 5) != 0).select("text", "lang"))
    out = identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
