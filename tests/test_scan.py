"""Ranking by scans against rows of tokens and stored indexes, and what such a batch shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import terms
from corvane.functions import text as T
from corvane.operators import fusion, scan, scratch
from corvane.operators import index as N
from corvane.operators import retrieve as R

KIND = "position bigint, text string, page_title string, section_title string, source_url string, category string, chunk_index int, start_index int"
ODD = ["", "  ", "os.path.join() Os.Path[3]() a.b.c[12] x[0]", "9abc _x __y__ É é ñandú Name name NAME", "日本語の処理 Foo.bar日本 京", "a..b a. .b [1] f()()", "x" * 500 + ".Y"]


def chunks(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "Page", f"S{(i or 0) % 3}", f"https://x.example/Dir{(i or 0) % 5}/", "c", 0, 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], KIND)


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "The", "os.path.join()", "Run", "日本語", "処理 京都", *(f"w{i}" for i in range(60))]
    return [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(n)], [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(15)]


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["position"], round(r["score"], 9)) for r in df.collect())


def shuffled_records(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("sizes", [(2, 3), (2,), ()])
def test_counted_tokens_equal_token_rows(spark, sizes):
    texts = ODD + corpus(1)[0]
    rows = R.token_rows(chunks(spark, texts), F.col("text"), sizes) if sizes else chunks(spark, texts).select("position", F.explode(T.unfolded_tokens(F.col("text"), (2,))).alias("m")).where(~F.col("m").rlike(T.JAPANESE_RUN)).select("position", F.explode(T.folded(F.col("m"))).alias("term"))
    want = {(r["position"], r["term"]): (r["tf"], r["length"]) for r in R.term_frequencies(rows).collect()}
    got = {(r["position"], r["term"]): (r["tf"], r["length"]) for r in scan.term_rows(chunks(spark, texts), sizes).collect()}
    assert got == want
    assert {(i, s) for i, t in enumerate(texts) for s in terms.symbols(t)} == {tuple(r) for r in chunks(spark, texts).select("position", F.explode(T.symbols(F.col("text")))).collect()}


@pytest.mark.parametrize(("queries_a_block", "pairs"), [(1024, 1 << 20), (4, 7)])
def test_scans_rank_like_stored_indexes(spark, tmp_path, monkeypatch, queries_a_block, pairs):
    monkeypatch.setattr(scan, "BLOCK_QUERIES", queries_a_block)
    monkeypatch.setattr(scan, "BATCH_PAIRS", pairs)
    texts, asked = corpus(2)
    docs, questions = chunks(spark, texts + texts[:30]), queries(spark, [*asked, "", "!!", "os.path"])  # copies tie
    for name, rows, found in (("l", R.labelled_rows(docs), R.bm25(docs, questions, 6, (2,))), ("b", R.field_rows(docs, "body", N.SIZES), R.field_bm25(docs, questions, "body", 6)), ("i", R.field_rows(docs, "identifiers", N.SIZES), R.field_bm25(docs, questions, "identifiers", 6))):
        assert ranked(found) == ranked(N.indexed_bm25(N.build_index(docs, rows, str(tmp_path / name)), questions, 6, (2,)))
    assert ranked(R.ranked_symbols(docs, questions, 6)) == ranked(R.symbol_search(R.symbol_records(docs), questions, 6))
    none = docs.where("false")
    assert R.bm25(none, questions).count() == 0 and R.bm25(docs, questions.where("false")).count() == 0


def test_rows_of_one_position_are_one_chunk(spark):
    docs = chunks(spark, ["alpha beta", "gamma", "alpha delta", "beta"], [1, 2, 1, None]).repartition(4)
    got = {(r["position"], r["term"]): (r["tf"], r["length"]) for r in scan.term_rows(docs, (2,)).collect()}
    assert got == {(1, "alpha"): (2, 4), (1, "beta"): (1, 4), (1, "delta"): (1, 4), (2, "gamma"): (1, 1), (None, "beta"): (1, 1)}
    assert [r["position"] for r in R.field_bm25(docs, queries(spark, ["alpha"]), "body").collect()] == [1]


@pytest.mark.parametrize("rank", [lambda d, q: R.bm25(d, q, 5), lambda d, q: R.field_bm25(d, q, "body", 5)])
def test_a_batch_shuffles_no_pairs(spark, rank):
    """Every chunk shares words with every query: once 24,000 sums of pairs were shuffled."""
    docs = chunks(spark, [f"the of and w{i}" for i in range(400)])
    before = shuffled_records(spark)
    assert rank(docs, queries(spark, [f"the of and w{i}" for i in range(60)])).count() == 300
    assert shuffled_records(spark) - before < 8000


def test_evidence_is_gathered_once(spark, monkeypatch):
    """A pipeline of several stages once looked for its chunks in the corpus, and ranked them, in each."""
    from corvane.operators import staged

    names = []
    monkeypatch.setattr(scratch, "written", lambda df, what, f=scratch.written: (names.append(what), f(df, what))[1])
    docs, asked = chunks(spark, ["alpha beta. more", "gamma delta. more"]), queries(spark, ["alpha", "gamma", "none"])
    plans = staged.evidence_first(asked, R.bm25(docs, asked, 2), docs)._jdf.queryExecution().executedPlan().toString()
    assert names.count("evidence") == 1 and names.count("ranked") == 1 and "MapInArrow" not in plans


def test_parents_meet_few_children(spark):
    """The mapping of all children is neither sorted nor shuffled for the few that were found."""
    found = spark.createDataFrame([(0, 1, 2.0, 7), (0, 2, 1.0, 3)], "query_id bigint, rank int, score double, position bigint")
    mapping = spark.range(200_000).select(F.col("id").alias("position"), (F.col("id") % 4).cast("string").alias("parent_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled_records(spark)
        assert [r["parent_id"] for r in fusion.expand_to_parents(found, mapping, 5).collect()] == ["3"]
        assert fusion.expansion_trace(found, mapping).first()["n_children"] == 2
        assert shuffled_records(spark) - before < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_come_in_small_batches(spark):
    """An Arrow batch once had as many pages and sections as the session's default allows."""
    from corvane.operators import chunk, html

    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    pages = spark.createDataFrame([(1, "https://x.example/", "a", "<main><h1>T</h1><p>words</p></main>")], "page_id bigint, url string, logical_path string, html string")
    for plan in (lambda: html.parse_pages(pages), lambda: chunk.chunk_sections(pages.select(F.col("html").alias("text"))), lambda: chunk.child_chunks(chunks(spark, ["a"]))):
        for key in keys:
            spark.conf.unset(key)
        plan()
        assert [int(spark.conf.get(k).rstrip("b")) for k in keys] == [scan.BATCH_TEXTS, scan.BATCH_BYTES]


def test_stored_sections_with_quotes_match_their_sql(spark, tmp_path):
    import duckdb

    from corvane.plans import documents as D

    rows = [(1, 'token = "ab" c. more', "en", "s"), (2, "a\\b\tc", 'e"n', "s"), (3, "plain. text", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    run, sql = D.QUERIES["stored_sections"]
    result = con.sql(sql)
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(tuple(r[result.columns.index(c)] for c in ("position", "section_id", "text_sha256")) for r in result.fetchall())
