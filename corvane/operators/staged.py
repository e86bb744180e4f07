"""The staged answer pipelines: exact choice before prose, and evidence before an answer.

Each stage is a column over the rows of the one before: a provider maps (prompt, contexts) to its output, an expression or
a pandas UDF. Rows that are settled early carry nulls through the later stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import contracts as C
from corvane.functions import prompts as P
from corvane.functions import text as T
from corvane.operators.answer import Generator, extractive_generator
from corvane.operators.context import gathered, select_by_prompts

NO_CONTEXTS = "array<struct<label:string,page_title:string,section_title:string,text:string>>"


def _empty() -> Column:
    return F.array().cast(NO_CONTEXTS)


def _settled(queries: DataFrame, rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Every question: those without chunks abstain, those where none fits fail."""
    every = queries.select("query_id").join(selected.select("query_id", "fits"), "query_id", "left").join(rows, "query_id", "left")
    status = F.coalesce("status", F.when(F.col("fits").isNull(), "abstained").otherwise("failed"))
    reason = F.coalesce("reason", F.when(F.col("status").isNull(), F.when(F.col("fits").isNull(), "no_retrieval_results").otherwise("context_budget_exceeded")))
    return every.select("query_id", status.alias("status"), "answer_text", reason.alias("reason"), "sources", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def _cited(rows: DataFrame, first: Column, again: Column, skip: Column, skip_attempts: Column) -> DataFrame:
    """Validates the first answer, else the second; ``skip`` marks rows that abstained before."""
    n = F.size("selected").cast("long")
    tried = rows.withColumn("raw", F.when(~skip, first)).withColumn("wrong", C.citation_reasons(F.col("raw"), n))
    fixed = tried.withColumn("second", F.size(F.coalesce("wrong", F.array().cast("array<string>"))) > 0).withColumn("raw", F.when(F.col("second"), again).otherwise(F.col("raw"))).withColumn("wrong", C.citation_reasons(F.col("raw"), n))
    valid = ~skip & (F.size("wrong") == 0)
    return fixed.select(
        "query_id", F.when(skip, "abstained").when(valid, "answered").otherwise("failed").alias("status"), F.when(valid, T.normal_space(F.col("raw"))).alias("answer_text"),
        F.when(skip, "insufficient_evidence").when(~valid, F.array_join("wrong", ",")).alias("reason"), F.when(valid, C.cited_sources(F.col("raw"), F.col("selected"))).alias("sources"),
        F.when(skip, skip_attempts).when(F.col("second"), 2).otherwise(1).alias("attempts"),
    )


def overlap_choice(prompt: Column, contexts: Column) -> Column:
    """The deterministic chooser: answer if there is any context."""
    return F.when(F.size(contexts) > 0, "answer").otherwise("abstain")


def two_stage(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, budget: int = 8192, choose: Generator = overlap_choice, generate: Generator = extractive_generator) -> DataFrame:
    """Chooses answer or abstain exactly, then generates prose for answers only, with one repair."""
    question = F.col("question")
    sizes = [(F.length(P.choice_prompt(question, _empty())), "none"), (F.length(P.generation_prompt(question, _empty())), "bracket"), (F.length(P.regeneration_prompt(question, _empty())), "bracket")]
    selected = select_by_prompts(gathered(ranked, chunks, queries), budget, sizes)
    ready = selected.where("fits").withColumn("contexts", P.prompt_contexts(F.col("selected")))
    chosen = choose(P.choice_prompt(question, F.col("contexts")), F.col("contexts"))
    exact = F.when(chosen.isin("answer", "abstain"), chosen).otherwise(F.raise_error(F.lit("generator returned an unknown choice")))
    ready = ready.withColumn("choice", exact)
    rows = _cited(ready, generate(P.generation_prompt(question, F.col("contexts")), F.col("contexts")), generate(P.regeneration_prompt(question, F.col("contexts")), F.col("contexts")), F.col("choice") == "abstain", F.lit(1))
    return _settled(queries, rows, selected)


def first_sentence_evidence(prompt: Column, contexts: Column) -> Column:
    """The deterministic extractor: the first sentence of the first context, as evidence JSON."""
    fact = F.substring(F.trim(F.regexp_extract(F.get(contexts, 0)["text"], r"\A[^.\n]*", 0)), 1, C.MAX_FACT_LENGTH)
    return F.to_json(F.struct(F.array(F.struct(F.lit("S1").alias("source"), F.array(fact).alias("facts"))).alias("evidence")))


def evidence_generator(prompt: Column, evidence: Column) -> Column:
    first = F.get(evidence, 0)
    return F.concat(F.get(first["facts"], 0), F.lit(" ["), first["source"], F.lit("]"))


def evidence_first(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, budget: int = 8192, extract: Generator = first_sentence_evidence, generate: Callable[[Column, Column], Column] = evidence_generator) -> DataFrame:
    """Extracts verbatim evidence (one repair), abstains without any, and answers from the evidence alone (one repair)."""
    question = F.col("question")
    sizes = [(F.length(P.evidence_prompt(question, _empty(), retry)), "bare") for retry in (False, True)]
    selected = select_by_prompts(gathered(ranked, chunks, queries), budget, sizes)
    ready = selected.where("fits").withColumn("contexts", P.prompt_contexts(F.col("selected")))
    texts = F.transform("contexts", lambda c: c["text"])
    one = ready.withColumn("out", extract(P.evidence_prompt(question, F.col("contexts")), F.col("contexts"))).withColumn("bad", C.evidence_reasons(F.col("out"), texts))
    two = one.withColumn("tries", F.when(F.size("bad") > 0, 2).otherwise(1)).withColumn("out", F.when(F.size("bad") > 0, extract(P.evidence_prompt(question, F.col("contexts"), True), F.col("contexts"))).otherwise(F.col("out"))).withColumn("bad", C.evidence_reasons(F.col("out"), texts))
    parsed = two.withColumn("evidence", F.when(F.size("bad") == 0, F.from_json("out", C.EVIDENCE)["evidence"]))
    good = parsed.where(F.col("evidence").isNotNull())
    rows = _cited(good, generate(P.evidence_answer_prompt(question, F.col("evidence")), F.col("evidence")), generate(P.evidence_answer_prompt(question, F.col("evidence"), True), F.col("evidence")), F.size("evidence") == 0, F.col("tries"))
    broken = parsed.where(F.col("evidence").isNull()).select("query_id", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("answer_text"), F.array_join("bad", ",").alias("reason"), F.lit(None).cast(rows.schema["sources"].dataType).alias("sources"), F.lit(2).alias("attempts"))
    return _settled(queries, rows.unionByName(broken), selected)


def extractive_contract(prompt: Column, contexts: Column) -> Column:
    """The deterministic provider of the answer-or-abstain contract: the first sentence, cited; without contexts it abstains."""
    some = F.size(contexts) > 0
    fields = F.struct(F.when(some, "answer").otherwise("abstain").alias("status"), F.when(some, extractive_generator(prompt, contexts)).otherwise("").alias("answer_text"), F.when(~some, "insufficient_evidence").alias("reason"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def answer_or_abstain(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, budget: int = 8192, generate: Generator = extractive_contract) -> DataFrame:
    """One JSON output that answers with citations or abstains; an output that breaks the contract is repaired once."""
    question = F.col("question")
    prompt = lambda contexts, retry: P.answer_or_abstain_prompt(question, contexts, retry)
    selected = select_by_prompts(gathered(ranked, chunks, queries), budget, [(F.length(prompt(_empty(), retry)), "bracket") for retry in (False, True)])
    ready = selected.where("fits").withColumn("contexts", P.prompt_contexts(F.col("selected")))
    n = F.size("selected").cast("long")
    field = lambda name: F.get_json_object("out", f"$.{name}")
    cites = F.when(field("status") == "answer", C.citation_reasons(field("answer_text"), n)).otherwise(F.array().cast("array<string>"))
    wrong = lambda: F.when(F.size(C.answer_json_reasons(F.col("out"))) > 0, C.answer_json_reasons(F.col("out"))).otherwise(cites)
    one = ready.withColumn("out", generate(prompt(F.col("contexts"), False), F.col("contexts"))).withColumn("bad", wrong())
    again = generate(prompt(F.col("contexts"), True), F.col("contexts"))
    two = one.withColumn("attempts", F.when(F.size("bad") > 0, 2).otherwise(1)).withColumn("out", F.when(F.size("bad") > 0, again).otherwise(F.col("out"))).withColumn("bad", wrong())
    fine, answers = F.size("bad") == 0, field("status") == "answer"
    rows = two.select(
        "query_id", F.when(~fine, "failed").when(answers, "answered").otherwise("abstained").alias("status"), F.when(fine & answers, T.normal_space(field("answer_text"))).alias("answer_text"),
        F.when(~fine, F.array_join("bad", ",")).when(~answers, field("reason")).alias("reason"), F.when(fine & answers, C.cited_sources(field("answer_text"), F.col("selected"))).alias("sources"), "attempts",
    )
    return _settled(queries, rows, selected)
