"""Citation, answer and evidence contracts as Column expressions.

JSON is checked in the JVM: ``parse_json`` rejects repeated keys and broken text, a regular expression tells the
non-standard constants apart, and a second look with the keys' count tells a repeated key from broken text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Citation and link shapes, and the limits of extracted evidence.
CITATION = r"\[S(\d+)\]"
CANONICAL_CITATION = r"\[S([1-9]\d*)\]"
CITATION_LIKE = r"\[[sS][^\]\r\n]*\]"
MARKDOWN_LINK = r"!?\[[^\]\r\n]+\]\([^\)\r\n]+\)"
MAX_FACTS, MAX_FACT_LENGTH = 3, 240
KEYS = ("status", "answer_text", "reason")


def _reasons(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks)))


def citation_numbers(answer: Column, pattern: str = CITATION) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), lambda n: n.cast("long"))


def distinct_citations(answer: Column) -> Column:
    return F.array_distinct(citation_numbers(answer))


def citation_reasons(answer: Column, n_chunks: Column) -> Column:
    """Why a cited answer is invalid, in the contract's order; empty for a valid one."""
    numbers = citation_numbers(answer, CANONICAL_CITATION)
    like = F.regexp_extract_all(answer, F.lit(CITATION_LIKE), F.lit(0))
    return _reasons(
        ("empty_answer", T.normal_space(answer) == ""),
        ("url_detected", answer.rlike(T.URL)),
        ("markdown_link_detected", answer.rlike(MARKDOWN_LINK)),
        ("malformed_citation", F.size(like) != F.size(numbers)),
        ("citation_out_of_range", F.exists(numbers, lambda n: n > n_chunks)),
        ("citation_required", F.size(numbers) == 0),
    )


def valid_citations(answer: Column, n_chunks: Column) -> Column:
    return F.filter(distinct_citations(answer), lambda n: (n >= 1) & (n <= n_chunks))


def invalid_citations(answer: Column, n_chunks: Column) -> Column:
    return F.filter(distinct_citations(answer), lambda n: (n < 1) | (n > n_chunks))


def without_citations(answer: Column, numbers: Column) -> Column:
    """The answer without the markers of ``numbers``."""
    marks = F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0)))
    gone = F.filter(marks, lambda m: F.array_contains(numbers, F.regexp_extract(m, CITATION, 1).cast("long")))
    return F.aggregate(gone, answer, lambda text, mark: F.replace(text, mark, F.lit("")))


def cited_sources(answer: Column, chunks: Column) -> Column:
    """Sources of the valid citations, the first label of each URL; ``chunks`` is the ranked array of chunk structs."""
    numbers = valid_citations(answer, F.size(chunks).cast("long"))
    first = F.filter(numbers, lambda n: ~F.exists(numbers, lambda m: (F.array_position(numbers, m) < F.array_position(numbers, n)) & (F.get(chunks, m.cast("int") - 1)["source_url"] == F.get(chunks, n.cast("int") - 1)["source_url"])))

    def source(n: Column) -> Column:
        chunk = F.get(chunks, n.cast("int") - 1)
        return F.struct(F.concat(F.lit("S"), n.cast("string")).alias("label"), chunk["page_title"].alias("page_title"), chunk["section_title"].alias("section_title"), chunk["source_url"].alias("url"))

    return F.transform(first, source)


def source_line(source: Column) -> Column:
    return F.concat(F.lit("["), source["label"], F.lit("] "), source["page_title"], F.lit(" - "), source["section_title"], F.lit(": "), source["url"])


def answer_json_reasons(raw: Column) -> Column:
    """Why raw output is not the strict answer-or-abstain object; empty for a valid one.

    Order: code fence, JSON, keys, types, status, then the rules of the branch.
    """
    text = F.btrim(raw, F.lit(" \t\n\r\x0b\x0c"))
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    constant = bare.rlike(r"(?<![A-Za-z0-9_])-?(?:NaN|Infinity)(?![A-Za-z0-9_])")
    value = F.try_parse_json(text)
    loose = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    repeated = value.isNull() & loose.isNotNull() & (F.size(keys) > F.size(F.array_distinct(keys)))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant"))
    get = lambda k: F.try_variant_get(value, f"$.{k}", "string")
    is_object = text.startswith("{")
    missing = F.exists(F.array(*map(F.lit, KEYS)), lambda k: ~F.array_contains(keys, k))
    extra = F.exists(keys, lambda k: ~k.isin(*KEYS))
    types = _reasons(("status_wrong_type", kind("status") != "STRING"), ("answer_text_wrong_type", kind("answer_text") != "STRING"), ("reason_wrong_type", ~kind("reason").isin("STRING", "VOID")))
    status, body, reason = get("status"), get("answer_text"), get("reason")
    answer = _reasons(("answer_reason_must_be_null", reason.isNotNull()), ("empty_answer", T.normal_space(body) == ""))
    full = body != ""
    abstain = _reasons(
        ("unknown_reason", F.coalesce(reason != "insufficient_evidence", F.lit(True))),
        ("abstain_answer_text_must_be_empty", full),
        ("abstain_citation_detected", full & body.rlike(CITATION_LIKE)),
        ("abstain_url_detected", full & body.rlike(T.URL)),
        ("abstain_markdown_link_detected", full & body.rlike(MARKDOWN_LINK)),
    )
    one = lambda name: F.array(F.lit(name))
    return (
        F.when(text.startswith("```") | text.endswith("```"), one("markdown_code_fence"))
        .when(text == "", one("invalid_json"))
        .when(repeated, one("duplicate_key"))
        .when(value.isNull() & constant, one("non_standard_json_value"))
        .when(value.isNull(), one("invalid_json"))
        .when(~is_object, one("top_level_not_object"))
        .when(missing | extra, _reasons(("missing_key", missing), ("extra_key", extra)))
        .when(F.size(types) > 0, types)
        .when(~status.isin("answer", "abstain"), one("unknown_status"))
        .when(status == "answer", answer)
        .otherwise(abstain)
    )


EVIDENCE = "evidence array<struct<source:string,facts:array<string>>>"


def evidence_reasons(raw: Column, contexts: Column) -> Column:
    """Why raw output is not valid evidence; ``contexts`` is the ranked array of sanitised texts.

    The first problem decides: JSON, schema, then source by source, then the number of facts.
    """
    text = F.btrim(raw, F.lit(" \t\n\r\x0b\x0c"))
    rows = F.from_json(text, EVIDENCE)["evidence"]
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    label = lambda r: F.regexp_extract(F.coalesce(r["source"], F.lit("")), r"^S([1-9]\d*)$", 1)
    number = lambda r: F.when(label(r).rlike(r"^\d{1,9}$"), label(r)).cast("int")
    known = lambda r: number(r).isNotNull() & (number(r) <= F.size(contexts))
    source_text = lambda r: T.normal_space(F.coalesce(F.get(contexts, F.coalesce(number(r), F.lit(1)) - 1), F.lit("")))

    def problem(r: Column) -> Column:
        clean = F.transform(r["facts"], lambda f: F.btrim(f, F.lit(" \t\n\r\x0b\x0c")))
        return (
            F.when(r.isNull(), F.lit("invalid_evidence_schema"))
            .when(~known(r), F.lit("invalid_evidence_source"))
            .when(F.size(F.filter(rows, lambda o: o["source"] == r["source"])) > 1, F.lit("duplicate_evidence_source"))
            .when(F.coalesce(F.size(clean), F.lit(0)) < 1, F.lit("invalid_evidence_facts"))
            .when(F.exists(clean, lambda f: f.isNull() | (f == "")), F.lit("invalid_evidence_facts"))
            .when(F.exists(clean, lambda f: F.length(f) > MAX_FACT_LENGTH), F.lit("evidence_fact_too_long"))
            .when(F.exists(clean, lambda f: f.rlike(T.URL) | f.rlike(MARKDOWN_LINK)), F.lit("unsafe_evidence_text"))
            .when(F.exists(clean, lambda f: ~F.contains(source_text(r), T.normal_space(f))), F.lit("unsupported_evidence_fact"))
        )

    problems = F.array_compact(F.transform(rows, problem))
    facts = F.aggregate(rows, F.lit(0), lambda n, r: n + F.coalesce(F.size(r["facts"]), F.lit(0)))
    one = lambda name: F.array(F.lit(name))
    return (
        F.when((text == "") | text.startswith("```") | text.endswith("```") | F.try_parse_json(text).isNull(), one("invalid_evidence_json"))
        .when((F.array_join(keys, ",") != "evidence") | rows.isNull(), one("invalid_evidence_schema"))
        .when(F.size(problems) > 0, F.slice(problems, 1, 1))
        .when(facts > MAX_FACTS, one("too_many_evidence_facts"))
        .otherwise(F.array().cast("array<string>"))
    )
