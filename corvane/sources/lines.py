"""JSON lines with their numbers, and strict question sets over them.

A text file is read in splits, so no task knows the number of its first line. ``numbered`` counts the lines of each split and
adds up the counts of a file's earlier splits: one row a split meets in a window, the lines stay where they were read.

A question set is a list of rules over the parsed line. The first rule that a line breaks is its ``problem``, so a set is read
whole and its errors name their lines; ``strict`` makes the first of them an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import scratch
from corvane.sources.files import QUERY_TYPES

TEXTS = ("id", "question", "query_type", "topic", "expected_answer", "reason", "expected_behavior")
LISTS = ("expected_url_keywords", "required_facts")
KINDS = ("retrieval", "holdout", "rag", "answerability", "portability")
Rule = tuple[str, Column]


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line of the text files at ``path``, blank ones included."""
    meta = F.col("_metadata")
    read = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    rows = scratch.written(read, "lines")
    splits = rows.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def _kind(name: str) -> Column:
    """The JSON type of a field; VOID where it is null or absent."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get("json", f"$.{name}", "variant")), F.lit("VOID"))


def _bad_text(name: str) -> Column:
    return (_kind(name) != "STRING") | (F.trim(F.coalesce(name, F.lit(""))) == "")


def _bad_list(name: str, least: int = 1) -> Column:
    blank = F.exists(F.coalesce(name, F.array().cast("array<string>")), lambda x: x.isNull() | (F.trim(x) == ""))
    kinds = ["ARRAY<STRING>"] if least else ["ARRAY<STRING>", "ARRAY<VOID>"]
    return ~_kind(name).isin(kinds) | blank | (F.coalesce(F.size(name), F.lit(0)) < least)


def _given(name: str) -> Column:
    return _kind(name) != "VOID"


def _texts(*names: str) -> list[Rule]:
    return [(f"{n} must not be empty", _bad_text(n)) for n in names]


def _rules(kind: str) -> list[Rule]:
    """What lines of a kind of question set must not be, in the order in which it is told."""
    unknown = ("unsupported query_type", ~F.trim("query_type").isin(*QUERY_TYPES))
    labels = ("id", "query_type", "topic")
    keywords = ("expected_url_keywords must be a non-empty string list", _bad_list("expected_url_keywords"))
    if kind in ("retrieval", "holdout"):
        labelled = F.lit(kind == "holdout") | _given("id") | _given("query_type") | _given("topic")
        some = _bad_text("id") | _bad_text("query_type") | _bad_text("topic")
        return [*_texts("question"), keywords, (f"{', '.join(labels)} must all be non-empty strings", labelled & some), (unknown[0], labelled & unknown[1])]
    answerable = F.col("answerable")
    if kind == "rag":
        return [*_texts("id", "question", "query_type", "topic"), unknown, ("answerable must be true", (_kind("answerable") != "BOOLEAN") | ~answerable), *_texts("expected_answer"), ("required_facts must be a non-empty string list", _bad_list("required_facts")), keywords]
    boolean = ("answerable must be a boolean", _kind("answerable") != "BOOLEAN")
    if kind == "answerability":
        held = F.size("expected_url_keywords") > 0
        typed = _given("query_type") & (_bad_text("query_type") | unknown[1])
        return [
            *_texts("id", "question"), boolean, ("expected_url_keywords must be a string list", _bad_list("expected_url_keywords", 0)), ("answerable cases require expected_url_keywords", answerable & ~held),
            ("expected_answer must not be empty", answerable & _bad_text("expected_answer")), ("unanswerable cases require empty expected_url_keywords", ~answerable & held),
            ("reason must not be empty", ~answerable & _bad_text("reason")), ("expected_behavior must be abstain", ~answerable & (_bad_text("expected_behavior") | (F.trim("expected_behavior") != "abstain"))), (unknown[0], typed),
        ]
    if kind == "portability":
        lists = [(f"{n} must be a string list", _given(n) & _bad_list(n, 0)) for n in LISTS]
        none = [F.coalesce(F.size(n), F.lit(0)) == 0 for n in LISTS]
        return [
            *_texts("id"), boolean, *_texts("query_type"), unknown, *lists, ("expected_answer must not be empty", answerable & _bad_text("expected_answer")),
            ("answerable cases require keywords and facts and no reason", answerable & (none[0] | none[1] | _given("reason"))), ("unanswerable cases have no answer, keywords or facts", ~answerable & (_given("expected_answer") | ~none[0] | ~none[1])),
            ("reason must not be empty", ~answerable & _bad_text("reason")), *_texts("question", "topic"),
        ]
    raise ValueError(f"unknown kind of question set: {kind}")


def questions(lines: DataFrame, kind: str, development: DataFrame | None = None) -> DataFrame:
    """file, line, the fields and ``problem`` of every line (file, line, value) that is not blank.

    Texts and list items come without outer spaces. Of lines with one id in a file all but the first have the problem
    ``duplicate id``. ``development`` (id): ids that a holdout set must not have.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of question set: {kind}")
    parsed = lines.where(F.trim("value") != "").withColumn("json", F.try_parse_json("value"))
    # A field of another type than its own is null here; the rules ask for its type too.
    get = lambda n, t: F.when(F.startswith(F.schema_of_variant("json"), F.lit("OBJECT")), F.try_variant_get("json", f"$.{n}", t))
    rows = parsed.select("file", "line", "json", *(get(n, "string").alias(n) for n in TEXTS), *(get(n, "array<string>").alias(n) for n in LISTS), get("answerable", "boolean").alias("answerable"))
    problem = F.when(F.col("json").isNull(), "invalid JSON").when(~F.startswith(F.schema_of_variant("json"), F.lit("OBJECT")), "expected a JSON object")
    for text, wrong in _rules(kind):
        problem = problem.when(F.coalesce(wrong, F.lit(False)), text)
    rows = rows.withColumn("problem", problem)
    rows = rows.withColumns({n: F.trim(n) for n in TEXTS}).withColumns({n: F.transform(n, F.trim) for n in LISTS})
    first = Window.partitionBy("file", "id").orderBy("line")
    rows = rows.withColumn("problem", F.when(F.col("problem").isNull() & F.col("id").isNotNull() & (F.row_number().over(first) > 1), "duplicate id").otherwise(F.col("problem")))
    if development is not None:
        known = development.select("id").where("id IS NOT NULL").distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("known"), "id is a development question's")))
    return rows.select("file", "line", *TEXTS, *LISTS, "answerable", "problem")


def strict(rows: DataFrame) -> DataFrame:
    """Rows of ``questions`` without ``problem``; a row that has one raises an error, with its line, when it is read."""
    told = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("problem"))
    line = F.when(F.col("problem").isNotNull(), F.raise_error(told).cast("long")).otherwise(F.col("line"))
    return rows.select("file", line.alias("line"), *(c for c in rows.columns if c not in ("file", "line", "problem")))

