"""The batch answer pipeline: retrieve, select, prompt, generate, validate, repair once, fail closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import contracts as C
from corvane.functions import prompts as P
from corvane.functions import text as T
from corvane.operators.context import gathered, select_within_budget

Generator = Callable[[Column, Column], Column]


def extractive_generator(prompt: Column, contexts: Column) -> Column:
    """The deterministic provider: the first sentence of the first context, cited."""
    sentence = F.regexp_extract(F.get(contexts, 0)["text"], r"\A[^.\n]*", 0)
    return F.when(F.size(contexts) == 0, F.lit("")).otherwise(F.concat(sentence, F.lit(" [S1]")))


def first_choice(choices: list[list[int]], prefix: list[int]) -> list[int]:
    """Token ids that may follow ``prefix`` under a constrained choice, ascending."""
    n = len(prefix)
    return sorted({c[n] for c in choices if c[:n] == prefix and len(c) > n})


def answer_batch(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, budget: int = 8192, generate: Generator = extractive_generator, repair: Generator | None = None) -> DataFrame:
    """query_id, status, answer_text, reason, sources, attempts for every question.

    No retrieved chunk: abstained with ``no_retrieval_results``. An invalid answer is repaired once; if that fails too the
    status is ``failed`` with the contract's reasons.
    """
    some = select_within_budget(gathered(ranked, chunks, queries), budget)
    ready = some.where("fits").withColumn("contexts", P.prompt_contexts(F.col("selected")))
    n = F.size("selected").cast("long")
    first = ready.withColumn("raw", generate(P.generation_prompt(F.col("question"), F.col("contexts")), F.col("contexts"))).withColumn("wrong", C.citation_reasons(F.col("raw"), n))
    again = (repair or generate)(P.regeneration_prompt(F.col("question"), F.col("contexts")), F.col("contexts"))
    fixed = first.withColumn("attempts", F.when(F.size("wrong") > 0, 2).otherwise(1)).withColumn("raw", F.when(F.size("wrong") > 0, again).otherwise(F.col("raw"))).withColumn("wrong", C.citation_reasons(F.col("raw"), n))
    valid = F.size("wrong") == 0
    answered = fixed.select("query_id", F.when(valid, "answered").otherwise("failed").alias("status"), F.when(valid, T.normal_space(F.col("raw"))).alias("answer_text"), F.when(~valid, F.array_join("wrong", ",")).alias("reason"), F.when(valid, C.cited_sources(F.col("raw"), F.col("selected"))).alias("sources"), "attempts")
    every = queries.select("query_id").join(answered, "query_id", "left").join(some.select("query_id", "fits"), "query_id", "left")
    return every.select("query_id", F.coalesce("status", F.when(F.col("fits") == F.lit(False), F.lit("failed")).otherwise("abstained")).alias("status"), "answer_text", F.coalesce("reason", F.when(F.col("status").isNull(), F.when(F.col("fits") == F.lit(False), F.lit("context_budget_exceeded")).otherwise("no_retrieval_results"))).alias("reason"), "sources", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def routed(questions: DataFrame, bases: DataFrame) -> DataFrame:
    """Questions (query_id, text, base_id) with the fields of their knowledge base; an unknown or disabled base raises an error
    when the row is read. ``bases``: base_id, enabled, and what a run needs, one row a base."""
    fields = [c for c in bases.columns if c not in ("base_id", "enabled")]
    met = questions.join(bases.withColumn("known", F.lit(True)), "base_id", "left")
    wrong = F.when(F.col("known").isNull(), "unknown knowledge base ").when(~F.coalesce("enabled", F.lit(True)), "knowledge base is disabled: ")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.coalesce("base_id", F.lit("(none)")))).cast("string")).otherwise(F.col("base_id"))
    return met.select("query_id", "text", checked.alias("base_id"), *fields)


def rendered(answers: DataFrame) -> DataFrame:
    """query_id, output: an answer with its list of sources, or why there is none, as lines of text."""
    sources = F.array_join(F.transform(F.coalesce("sources", F.array().cast(answers.schema["sources"].dataType)), C.source_line), "\n")
    body = F.when(F.col("status") == "answered", F.concat(F.col("answer_text"), F.when(sources != "", F.concat(F.lit("\n\n"), sources)).otherwise("")))
    return answers.select("query_id", body.when(F.col("status") == "abstained", F.concat(F.lit("no answer: "), F.col("reason"))).otherwise(F.concat(F.lit("failed: "), F.coalesce("reason", F.lit("unknown")))).alias("output"))
