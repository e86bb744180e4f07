"""Retrieval, candidate, answer and portability metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.retrieve import small

CUTS = (1, 3, 5, 10)


def url_hit(url: Column, keywords: Column) -> Column:
    """True if the URL contains any keyword."""
    return F.exists(keywords, lambda k: F.contains(url, k))


def within_prefixes(urls: Column, prefixes: Column) -> Column:
    """True if every URL starts with one of the prefixes."""
    return F.forall(urls, lambda u: F.exists(prefixes, lambda p: F.startswith(u, p)))


def question_ranks(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, depth: int = 10, relevant: DataFrame | None = None) -> DataFrame:
    """Every question (query_id, query_type, topic) with its first relevant rank (null: none within ``depth``).

    A chunk is relevant if its URL holds one of the question's ``keywords``, or, where a relation of judgements is given, if
    ``relevant`` has (query_id, position); judgements of any number are joined, never gathered into a list.
    """
    some = ranked.where(F.col("rank") <= depth)
    if relevant is None:
        found = some.join(chunks.select("position", "source_url"), "position").join(questions.select("query_id", "keywords"), "query_id").where(url_hit(F.col("source_url"), F.col("keywords")))
    else:
        found = some.join(relevant.select("query_id", "position").distinct(), ["query_id", "position"])
    first = found.groupBy("query_id").agg(F.min("rank").alias("first_relevant_rank"))
    return questions.select("query_id", "query_type", "topic").join(first, "query_id", "left")


def ranking_metrics(ranks: DataFrame, *groups: str) -> DataFrame:
    """Hit rates and mean reciprocal rank, overall and for each value of each group (nulls left out)."""
    rank = F.col("first_relevant_rank")
    measures = [F.count("*").alias("n_questions"), *(F.avg(F.coalesce(rank <= k, F.lit(False)).cast("int")).alias(f"hit_at_{k}") for k in CUTS), F.avg(F.coalesce(F.lit(1.0) / rank, F.lit(0.0))).alias("mrr_at_10"), F.count_if(rank.isNull()).alias("n_missed")]
    if not groups:
        return ranks.agg(*measures)
    named = ranks.select("first_relevant_rank", F.explode(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(g).alias("dimension"), F.col(g).alias("value")) for g in groups))).alias("g"))
    return named.where("g.value IS NOT NULL").groupBy("g.dimension", "g.value").agg(*measures)


def compare(baseline: DataFrame, experiment: DataFrame) -> DataFrame:
    """One row: questions improved, tied, worsened, and those that entered or left the top 5 and 10.

    A question that only one side has raises an error.
    """
    far = 1 << 30
    b, e = (d.select("query_id", F.coalesce("first_relevant_rank", F.lit(far)).alias(n)) for d, n in ((baseline, "b"), (experiment, "e")))
    both = b.join(e, "query_id", "full_outer")
    ok = both.withColumn("b", F.when(F.col("b").isNull() | F.col("e").isNull(), F.raise_error(F.lit("question ids must match")).cast("int")).otherwise(F.col("b")))
    moved = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("query_id"))))
    lists = [x for k in (5, 10) for x in (moved((F.col("b") > k) & (F.col("e") <= k)).alias(f"entered_top_{k}"), moved((F.col("e") > k) & (F.col("b") <= k)).alias(f"left_top_{k}"))]
    return ok.agg(F.count_if(F.col("e") < F.col("b")).alias("improved"), F.count_if(F.col("e") == F.col("b")).alias("tied"), F.count_if(F.col("e") > F.col("b")).alias("worsened"), *lists)


def candidate_recall(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, candidate_k: int = 30, relevant: DataFrame | None = None) -> DataFrame:
    """One row: recall at 10, 20, 30 and mean numbers of distinct URLs, pages and sections among the candidates."""
    if candidate_k < 30:
        raise ValueError("candidate_k must be at least 30")
    ranks = question_ranks(ranked, chunks, questions, candidate_k, relevant)
    met = chunks.select("position", "source_url", "section_title").join(small(ranked.where(F.col("rank") <= candidate_k).select("query_id", "position")), "position")
    spread = met.groupBy("query_id").agg(F.countDistinct("source_url").alias("urls"), F.countDistinct(F.substring_index("source_url", "#", 1)).alias("pages"), F.countDistinct("source_url", "section_title").alias("sections"))
    every = ranks.join(spread, "query_id", "left")
    recall = [F.avg(F.coalesce(F.col("first_relevant_rank") <= k, F.lit(False)).cast("int")).alias(f"recall_at_{k}") for k in (10, 20, 30)]
    return every.agg(F.count("*").alias("n_questions"), *recall, *(F.avg(F.coalesce(c, F.lit(0))).alias(f"mean_{c}") for c in ("urls", "pages", "sections")))


def coverage_label(completeness: Column, required: Column, missing: Column) -> Column:
    """complete, partial or insufficient, from a 0-4 score and lists of normalised facts."""
    all_missing = (F.size(required) > 0) & (F.size(F.array_except(required, missing)) == 0)
    return F.when((completeness <= 1) | all_missing, "insufficient").when((completeness >= 3) & (F.size(missing) == 0), "complete").otherwise("partial")


def _derived() -> tuple[Column, Column, Column]:
    """grounded, coverage_label and answerability_label as a case's scores give them."""
    grounded = (F.col("faithfulness") >= 3) & (F.col("citation_support") >= 3) & (F.col("n_unsupported") == 0)
    label = F.when(F.col("abstained"), F.when(F.col("answerable"), "false_abstention").otherwise("correct_abstention")).when(F.col("answerable") & grounded, "supported_answer").otherwise("false_answer")
    return grounded, coverage_label(F.col("completeness"), F.col("required"), F.col("missing")), label


def judged(cases: DataFrame) -> DataFrame:
    """Cases with the derived labels grounded, coverage_label and answerability_label."""
    return cases.withColumns(dict(zip(("grounded", "coverage_label", "answerability_label"), _derived(), strict=True)))


#: Revisions of the judge's request and of the derivation, and what each failed check says.
PROMPT_REVISION, SCHEMA_REVISION, DERIVED_REVISION = "rag-grounding-v3", "rag-judge-evidence-v3", "rag-derived-evaluation-v1"
NOT_DERIVED = "{} does not match the local derivation rule"
COMPLETE_WITH_MISSING = "complete coverage conflicts with missing required facts"
INSUFFICIENT_WITH_4 = "insufficient coverage conflicts with completeness=4"
FOUR_WITH_MISSING = "completeness=4 conflicts with missing required facts"
ABSTENTION_NOT_ABSTAINED = "abstention label requires abstained=true"
ABSTENTION_WITH_ANSWER = "abstention label conflicts with a substantive answer body"
TOKENS_DONT_ADD = "total_tokens must equal input_tokens + output_tokens"


def _failed(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(wrong, F.lit(message)) for message, wrong in checks)))


def judge_issues(cases: DataFrame) -> Column:
    """What is wrong with a judge's own record (prompt_revision, schema_revision, input_tokens, output_tokens, total_tokens; a
    case without token counts has nothing to add up)."""
    off = lambda name, want: ~F.col(name).eqNullSafe(F.lit(want))
    return _failed([
        (f"prompt revision must be {PROMPT_REVISION}", off("prompt_revision", PROMPT_REVISION)),
        (f"schema revision must be {SCHEMA_REVISION}", off("schema_revision", SCHEMA_REVISION)),
        (TOKENS_DONT_ADD, F.col("total_tokens") != F.col("input_tokens") + F.col("output_tokens")),
    ])


def derived_issues(cases: DataFrame, abstention: str = "") -> Column:
    """What is inconsistent between a case's recorded labels, the labels that its scores give, and each other.

    Cases may have ``derived_revision`` and ``answer_text`` too; an answer text other than ``abstention`` has substance.
    """
    labels = ("grounded", "coverage_label", "answerability_label")
    now = {c: e for c, e in zip(labels, _derived(), strict=True)}
    n_missing = F.size("missing")
    abstains = F.col("answerability_label").endswith("abstention")
    checks = [(NOT_DERIVED.format(c), ~F.col(c).eqNullSafe(now[c])) for c in labels]
    if "derived_revision" in cases.columns:
        checks.append((f"derived revision must be {DERIVED_REVISION}", ~F.col("derived_revision").eqNullSafe(F.lit(DERIVED_REVISION))))
    checks += [
        (COMPLETE_WITH_MISSING, (F.col("coverage_label") == "complete") & (n_missing > 0)),
        (INSUFFICIENT_WITH_4, (F.col("coverage_label") == "insufficient") & (F.col("completeness") == 4)),
        (FOUR_WITH_MISSING, (F.col("completeness") == 4) & (n_missing > 0)),
        (ABSTENTION_NOT_ABSTAINED, abstains & ~F.col("abstained")),
    ]
    if "answer_text" in cases.columns:
        body = F.regexp_replace(F.coalesce("answer_text", F.lit("")), r"(?U)^\s+|\s+$", "")
        checks.append((ABSTENTION_WITH_ANSWER, abstains & (body != "") & (body != abstention)))
    return _failed(checks)


ANSWERABILITY = ("supported_answer", "false_answer", "correct_abstention", "false_abstention")


def label_counts(cases: DataFrame) -> DataFrame:
    """answerability_label, n: every label is there, even with none."""
    every = cases.sparkSession.createDataFrame([(x,) for x in ANSWERABILITY], "answerability_label string")
    counted = cases.groupBy("answerability_label").agg(F.count("*").alias("n"))
    return every.join(counted, "answerability_label", "left").select("answerability_label", F.coalesce("n", F.lit(0)).alias("n"))


def rag_summary(cases: DataFrame) -> DataFrame:
    """One row of rates over the cases that each rate is about (null where there are none)."""
    rate = lambda cond, among: F.avg(F.when(among, cond.cast("int")))
    answered, able = ~F.col("abstained"), F.col("answerable")
    return cases.agg(
        F.count("*").alias("n_cases"), F.count_if(able).alias("n_answerable"), F.count_if(F.col("abstained")).alias("n_abstained"),
        rate(F.col("grounded"), answered).alias("grounded_rate"), rate(F.col("coverage_label") == "complete", answered & able).alias("complete_rate"),
        rate(F.col("abstained"), ~able).alias("correct_abstention_rate"), rate(F.col("abstained"), able).alias("false_abstention_rate"),
        rate(answered, ~able).alias("false_answer_rate"), F.avg("faithfulness").alias("mean_faithfulness"), F.avg("completeness").alias("mean_completeness"),
        F.avg("citation_support").alias("mean_citation_support"), F.sum("n_unsupported").alias("n_unsupported"), F.median("n_chars").alias("median_chars"), F.max("n_chars").alias("max_chars"),
    )


def portability_summary(cases: DataFrame) -> DataFrame:
    """One row of counts over boolean columns of portability cases."""
    done, able = F.col("generation_succeeded"), F.col("answerable")
    return cases.agg(
        F.count("*").alias("question_count"), F.count_if(able).alias("answerable_count"), F.count_if(~able).alias("unanswerable_count"),
        F.count_if(done & ~F.col("abstained")).alias("valid_answer_count"), F.count_if(done & F.col("abstained")).alias("valid_abstain_count"),
        F.count_if(~able & ~F.col("abstained") & done).alias("false_answer_count"), F.count_if(able & F.col("abstained") & done).alias("false_abstention_count"),
        F.count_if(~done).alias("contract_failure_count"), F.count_if(able & F.col("correct_source_top5")).alias("correct_source_top5_count"),
        F.count_if(done & ~F.col("citation_format_valid")).alias("citation_format_failure_count"), F.avg(F.when(done, F.col("input_tokens"))).alias("average_input_tokens"),
    )
