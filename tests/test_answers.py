"""The batch answer pipelines and their prompts."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import prompts as P
from corvane.operators import answer as A
from corvane.operators import context as X
from corvane.operators import staged as G

CHUNKS = "position bigint, text string, page_title string, section_title string, source_url string"


@pytest.fixture(scope="module")
def case(spark):
    chunks = spark.createDataFrame([(1, "First fact here. More", "p", "s", "https://x.example/1"), (2, "Other text", "p", "s", "https://x.example/2"), (3, "z" * 9000, "p", "s", "https://x.example/3")], CHUNKS)
    ranked = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 0.5, 2), (3, 1, 1.0, 3)], "query_id bigint, rank int, score double, position bigint")
    queries = spark.createDataFrame([(1, "q"), (2, "nothing"), (3, "too long")], "query_id bigint, text string")
    return queries, ranked, chunks


@pytest.mark.parametrize("run", [A.answer_batch, G.two_stage, G.evidence_first, G.answer_or_abstain])
def test_outcomes(case, run):
    got = {r["query_id"]: r for r in run(*case, 3000).collect()}
    assert (got[1]["status"], got[1]["answer_text"], got[1]["attempts"]) == ("answered", "First fact here [S1]", 1)
    assert [s["url"] for s in got[1]["sources"]] == ["https://x.example/1"]
    assert (got[2]["status"], got[2]["reason"], got[2]["attempts"]) == ("abstained", "no_retrieval_results", 0)
    assert (got[3]["status"], got[3]["reason"]) == ("failed", "context_budget_exceeded")


def test_one_repair_then_closed(case):
    bad = lambda prompt, contexts: F.lit("no citation")
    got = {r["query_id"]: r for r in A.answer_batch(*case, 3000, generate=bad, repair=A.extractive_generator).collect()}
    assert (got[1]["status"], got[1]["attempts"]) == ("answered", 2)
    got = {r["query_id"]: r for r in G.two_stage(*case, 3000, generate=bad).collect()}
    assert (got[1]["status"], got[1]["reason"], got[1]["attempts"]) == ("failed", "citation_required", 2)


def test_choice_and_evidence_abstain(case):
    no = lambda prompt, contexts: F.lit("abstain")
    got = {r["query_id"]: r for r in G.two_stage(*case, 3000, choose=no).collect()}
    assert (got[1]["status"], got[1]["reason"]) == ("abstained", "insufficient_evidence")
    empty = lambda prompt, contexts: F.lit('{"evidence":[]}')
    got = {r["query_id"]: r for r in G.evidence_first(*case, 3000, extract=empty).collect()}
    assert (got[1]["status"], got[1]["reason"]) == ("abstained", "insufficient_evidence")
    wrong = lambda prompt, contexts: F.lit('{"evidence":[{"source":"S1","facts":["made up"]}]}')
    got = {r["query_id"]: r for r in G.evidence_first(*case, 3000, extract=wrong).collect()}
    assert (got[1]["status"], got[1]["reason"]) == ("failed", "unsupported_evidence_fact")


def test_prompt_sizes_are_exact(spark, case):
    queries, ranked, chunks = case
    rows = X.gathered(ranked.where("query_id = 1"), chunks, queries)
    built = rows.withColumn("c", P.prompt_contexts(F.col("chunks")))
    for build, kind in ((P.choice_prompt, "none"), (P.generation_prompt, "bracket"), (P.evidence_prompt, "bare"), (P.answer_or_abstain_prompt, "bracket")):
        full = built.select(F.length(build(F.col("question"), F.col("c")))).first()[0]
        empty = F.length(build(F.col("question"), F.array().cast(X.NO_CONTEXTS)))
        assert [len(X.select_by_prompts(rows, n, [(empty, kind)]).first()["selected"]) for n in (full, full - 1)] == [2, 1]


def test_constrained_choice():
    assert A.first_choice([[1, 2, 3], [1, 4], [5]], [1]) == [2, 4] and A.first_choice([[1]], [1]) == []


def test_answer_or_abstain_repairs_once(case):
    bad = lambda prompt, contexts: F.when(F.contains(prompt, F.lit(P.CONTRACT_FAILED)), G.extractive_contract(prompt, contexts)).otherwise("not json")
    got = {r["query_id"]: r for r in G.answer_or_abstain(*case, 3000, generate=bad).collect()}
    assert (got[1]["status"], got[1]["attempts"]) == ("answered", 2)
    uncited = lambda prompt, contexts: F.lit('{"status":"answer","answer_text":"no mark","reason":null}')
    got = {r["query_id"]: r for r in G.answer_or_abstain(*case, 3000, generate=uncited).collect()}
    assert (got[1]["status"], got[1]["reason"], got[1]["attempts"]) == ("failed", "citation_required", 2)
    no = lambda prompt, contexts: F.lit('{"status":"abstain","answer_text":"","reason":"insufficient_evidence"}')
    got = {r["query_id"]: r for r in G.answer_or_abstain(*case, 3000, generate=no).collect()}
    assert (got[1]["status"], got[1]["reason"], got[1]["sources"]) == ("abstained", "insufficient_evidence", None)


def test_frozen_contexts_replay(spark, case, tmp_path):
    from corvane.operators import frozen as Z

    queries, ranked, chunks = case
    some = queries.where("query_id <> 2")
    Z.freeze(X.gathered(ranked, chunks, some)).write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert {r["query_id"]: len(r["chunks"]) for r in Z.thaw(stored, some).collect()} == {1: 2, 3: 1}
    for wrong, said in ((queries, "no frozen"), (some.where("query_id = 1"), "unknown"), (some.withColumn("text", F.lit("x")), "another text")):
        with pytest.raises(Exception, match=said):
            Z.thaw(stored, wrong).collect()
    changed = stored.withColumn("chunks", F.slice("chunks", 1, 1))
    with pytest.raises(Exception, match="changed"):
        Z.thaw(changed, some).collect()
    assert [r[0] for r in Z.pending(queries, stored).select("query_id").collect()] == [2]
    answers = A.answer_batch(queries, ranked, chunks, 3000)
    assert [tuple(r) for r in Z.cited_chunks(answers, ranked, chunks).collect()] == [(1, 1)]
    times = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "generation_seconds double")
    assert tuple(Z.seconds_summary(times, "generation_seconds").first()) == (3.0, 2.0)


def test_stored_sections(spark):
    from corvane.operators import frozen as Z

    rows = spark.createDataFrame([("a", "one"), ("b", " ")], "anchor string, text string")
    stored = Z.stored_sections(rows, F.col("anchor"))
    assert [tuple(r) for r in Z.section_problems(stored).collect()] == [("b", "blank_text")]
    assert {r["problem"] for r in Z.section_problems(stored.withColumn("text", F.lit("x"))).collect()} == {"changed_text"}
    with pytest.raises(Exception, match="repeated section id"):
        Z.stored_sections(rows, F.lit("same")).collect()


def test_embeddings_are_unit_vectors_and_checked(spark):
    from corvane.operators import embed as V
    from corvane.operators import retrieve as R

    rows = [(i, t, "p", "s") for i, t in enumerate(["red green blue", "red green", "yellow words here", "red green blue"])]
    chunks = spark.createDataFrame(rows, "position bigint, text string, page_title string, section_title string")
    vectors = V.embed_chunks(chunks, V.hashed_words(16), "passage: ")
    assert V.vector_problems(vectors, chunks, 16).count() == 0
    asked = V.embed_queries(spark.createDataFrame([(9, "red green blue")], "query_id bigint, text string"), V.hashed_words(16), "query: ")
    assert R.dense_search(vectors, asked, 4).where("position = 2").first()["rank"] >= 3
    wrong = vectors.where("position <> 0").withColumn("vector", F.when(F.col("position") == 1, F.array(F.lit(2.0).cast("float"))).otherwise(F.col("vector")))
    stale = chunks.withColumn("text", F.when(F.col("position") == 2, "other").otherwise(F.col("text")))
    assert {tuple(r) for r in V.vector_problems(wrong, stale, 16).collect()} == {(0, "missing"), (1, "wrong_size"), (2, "stale")}
    zero = spark.createDataFrame([([0.0, 0.0],), ([float("nan")],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in zero.select(V.normalised(F.col("v"))).collect()] == [None] * 4


def test_reports(spark, tmp_path):
    from corvane.operators import publish

    path = str(tmp_path / "r.json")
    assert publish.read_report(spark, path) is None
    for report in ({"b": 1, "a": [1.5]}, {"a": 2}):
        publish.write_report(spark, path, report)
        assert publish.read_report(spark, path) == report
    with pytest.raises(ValueError):
        publish.write_report(spark, path, {"x": float("nan")})


def test_rendered_and_routed(spark, case):
    got = {r["query_id"]: r["output"] for r in A.rendered(A.answer_batch(*case, 3000)).collect()}
    assert got == {1: "First fact here [S1]\n\n[S1] p - s: https://x.example/1", 2: "no answer: no_retrieval_results", 3: "failed: context_budget_exceeded"}
    asked = lambda base: spark.createDataFrame([(1, "q", base)], "query_id bigint, text string, base_id string")
    bases = spark.createDataFrame([("a", True, "/a"), ("b", False, "/b")], "base_id string, enabled boolean, root string")
    assert tuple(A.routed(asked("a"), bases).first()) == (1, "q", "a", "/a")
    for base, said in (("b", "disabled"), ("c", "unknown"), (None, "unknown")):
        with pytest.raises(Exception, match=said):
            A.routed(asked(base), bases).collect()


def test_locked_archive(spark, tmp_path):
    from corvane.sources.archive import locked_archive
    from corvane.sources.crawl import Response

    lock, url = str(tmp_path / "lock.json"), "https://x.example/a.zip"
    serve = lambda body, at=url, status=200: lambda _: Response(at, status, "application/zip", body)
    assert bytes(locked_archive(spark, url, lock, serve(b"one")).first()[0]) == b"one"
    assert locked_archive(spark, url, lock, serve(b"one")).count() == 1
    for transport, said in ((serve(b"two"), "not the locked one"), (serve(b"one", "http://x.example/a.zip"), "not https"), (serve(b"", status=500), "cannot fetch"), (serve(b"x" * 20), "larger")):
        with pytest.raises(ValueError, match=said):
            locked_archive(spark, url, lock, transport, max_bytes=10)
    with pytest.raises(ValueError, match="https"):
        locked_archive(spark, "http://x.example/a.zip", lock, serve(b"one"))
    assert locked_archive(spark, url, lock, serve(b"two"), refresh=True).count() == 1
    assert bytes(locked_archive(spark, url, lock, serve(b"two")).first()[0]) == b"two"
