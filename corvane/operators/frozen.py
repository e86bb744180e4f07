"""Frozen contexts: the evidence of a question set, recorded once and replayed without retrieval, and stored sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.retrieve import small


def _digest(chunks: Column) -> Column:
    return T.text_sha256(F.to_json(F.transform(chunks, lambda c: F.struct(c["rank"].alias("rank"), c["source_url"].alias("source_url"), c["text"].alias("text")))))


def freeze(gathered: DataFrame) -> DataFrame:
    """Rows of ``context.gathered`` with a digest of their chunks, to be written."""
    return gathered.withColumn("chunks_sha256", _digest(F.col("chunks")))


def thaw(frozen: DataFrame, questions: DataFrame) -> DataFrame:
    """The recorded evidence of exactly these questions (query_id, text): a question that is missing, extra, asked otherwise, or
    whose chunks no longer have their digest raises an error when the row is read."""
    asked = questions.select("query_id", F.col("text").alias("now"))
    met = frozen.join(asked, "query_id", "full_outer")
    wrong = (
        F.when(F.col("chunks_sha256").isNull(), "no frozen contexts for question ").when(F.col("now").isNull(), "frozen contexts of an unknown question ")
        .when(F.col("now") != F.col("question"), "another text was frozen for question ").when(_digest(F.col("chunks")) != F.col("chunks_sha256"), "frozen contexts changed for question ")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("query_id").cast("string"))).cast("string")).otherwise(F.col("question"))
    return met.select("query_id", checked.alias("question"), "chunks")


def stored_sections(sections: DataFrame, section_id: Column) -> DataFrame:
    """Sections with their id and text hash, to be written; an id that repeats raises an error when it is read."""
    rows = sections.withColumn("section_id", section_id).withColumn("text_sha256", T.text_sha256(F.col("text")))
    twice = rows.groupBy("section_id").agg(F.count("*").alias("n"))
    met = rows.join(twice, "section_id")
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated section id "), F.col("section_id"))).cast("string")).otherwise(F.col("section_id"))
    return met.select(checked.alias("section_id"), *(c for c in rows.columns if c != "section_id"))


def section_problems(stored: DataFrame) -> DataFrame:
    """section_id, problem of stored sections: repeated_id, changed_text or blank_text."""
    twice = stored.groupBy("section_id").count().where("count > 1").select("section_id", F.lit("repeated_id").alias("problem"))
    changed = stored.where(T.text_sha256(F.col("text")) != F.col("text_sha256")).select("section_id", F.lit("changed_text").alias("problem"))
    blank = stored.where(F.coalesce(F.trim("text"), F.lit("")) == "").select("section_id", F.lit("blank_text").alias("problem"))
    return twice.unionByName(changed).unionByName(blank)


def pending(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Questions that have no saved record yet: where an interrupted evaluation goes on."""
    return questions.join(records.select("query_id").distinct(), "query_id", "left_anti")


def cited_chunks(answers: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, position of the retrieved chunks whose URL the answer's ``sources`` cite."""
    cited = answers.select("query_id", F.explode("sources").alias("s")).select("query_id", F.col("s.url").alias("source_url")).distinct()
    met = chunks.select("position", "source_url").join(small(ranked.select("query_id", "position")), "position")
    return met.join(cited, ["query_id", "source_url"], "left_semi").select("query_id", "position")


def seconds_summary(records: DataFrame, *columns: str) -> DataFrame:
    """One row: mean and median of columns of seconds."""
    return records.agg(*(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("median", F.median))))
