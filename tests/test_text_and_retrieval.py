"""Tokens, BM25, symbols, dense search and fusion against small models in Python."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import fusion as X
from corvane.operators import retrieve as R


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("use os.path.join() and x[0]", ["use", "os.path.join()", "and", "x[0]"]),
        ("9abc a1 __init__", ["a1", "__init__"]),
        ("", []),
        ("日本 foo日本bar", ["foo", "bar"]),
    ],
)
def test_identifiers(spark, text, want):
    assert one(spark, T.identifiers(F.col("t")), t=text) == want


def test_variants_keep_folded_repeats(spark):
    got = one(spark, T.identifier_variants(F.col("t")), t="Path.path")
    assert got == ["Path.path", "path.path", "path", "Path", "path"]
    assert "join()" in one(spark, T.identifier_variants(F.col("t")), t="os.path.join()")


def test_ngrams_do_not_cross_runs(spark):
    assert one(spark, T.character_ngrams(F.col("t"), (2, 3)), t="東京都 x 大阪") == ["東京", "京都", "東京都", "大阪"]


def test_sanitised(spark):
    text = r"at https://a.b/c or /usr/lib/x.py or C:\a\b.txt done"
    assert one(spark, T.sanitised(F.col("t")), t=text) == f"at {T.URL_MARK} or {T.PATH_MARK} or {T.PATH_MARK} done"


def chunks(spark, texts):
    rows = [(i, t, "p", "s", f"https://x.example/{i:04d}/", "c", 0, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "position bigint, text string, page_title string, section_title string, source_url string, category string, chunk_index int, start_index int")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_field_bm25_against_model(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(0, 9))) for _ in range(30)]
    asked = ["alpha delta", "gamma", "none"]
    docs = [t.split() for t in texts]
    average = sum(map(len, docs)) / len(docs) or 1.0
    want = {}
    for q, text in enumerate(asked):
        scores = {}
        for term in dict.fromkeys(text.split()):
            df = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                if tf := d.count(term):
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0.0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / average))
        want[q] = [p for p, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]]
    got = {q: [] for q in want}
    for r in sorted(R.field_bm25(chunks(spark, texts), queries(spark, *asked), "body", 5).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["position"])
    assert got == want


def test_bm25_ties_follow_position(spark):
    got = R.bm25(chunks(spark, ["same words"] * 3), queries(spark, "words"), 3).orderBy("rank").collect()
    assert [r["position"] for r in got] == [0, 1, 2]


def test_tokenless_queries_are_reported(spark):
    assert [r[0] for r in R.tokenless(queries(spark, "!!", "ok")).collect()] == [0]


def test_symbols_prefer_exact(spark):
    records = R.symbol_records(chunks(spark, ["join", "os.path.join"]))
    got = R.symbol_search(records, queries(spark, "os.path.join"), 5).orderBy("rank").collect()
    assert [r["position"] for r in got] == [1, 0] and got[0]["score"] > 1000


def test_dense_ties_and_order(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "position bigint, vector array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.5])], "query_id bigint, vector array<float>")
    assert [r["position"] for r in R.dense_search(vectors, asked, 3).orderBy("rank").collect()] == [0, 1, 2]


def ranked(spark, *rows):
    return spark.createDataFrame([(0, r, 1.0, p) for r, p in rows], "query_id bigint, rank int, score double, position bigint")


def test_fusion_keeps_rank_gaps_and_ties(spark):
    a, b = ranked(spark, (1, 10), (2, 10), (3, 11)), ranked(spark, (1, 12), (2, 11))
    got = X.fuse([(a, 1.0), (b, 1.0)], 5, 60, 20).orderBy("rank").collect()
    assert [r["position"] for r in got] == [11, 10, 12]
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 62) and got[1]["score"] == pytest.approx(1 / 61)


@pytest.mark.parametrize("bad", [0, True, 1.5])
def test_limits_are_validated(spark, bad):
    with pytest.raises(ValueError):
        X.fuse([(ranked(spark, (1, 1)), 1.0), (ranked(spark, (1, 1)), 1.0)], 5, bad)


def test_fusion_needs_two_lists_and_positive_weights(spark):
    with pytest.raises(ValueError):
        X.fuse([(ranked(spark, (1, 1)), 1.0)])
    with pytest.raises(ValueError):
        X.fuse([(ranked(spark, (1, 1)), 1.0), (ranked(spark, (1, 1)), 0.0)])


def test_parents_by_first_child(spark):
    mapping = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "position bigint, parent_id string")
    kids = ranked(spark, (1, 2), (2, 1), (3, 3), (4, 9))
    got = X.expand_to_parents(kids, mapping, 5).orderBy("rank").collect()
    assert [(r["parent_id"], r["child_hits"]) for r in got] == [("B", 1), ("A", 2)]
    assert [r[0] for r in X.unresolved(kids, mapping).collect()] == [9]
    assert X.expansion_trace(kids, mapping).first()["compression_ratio"] == pytest.approx(2 / 3)


def test_rerank_keeps_original_rank_on_ties(spark):
    docs, asked = chunks(spark, ["a b", "a b", "a b c d"]), queries(spark, "c d")
    got = X.rerank(ranked(spark, (1, 0), (2, 1), (3, 2)), asked, docs, 3).orderBy("rank").collect()
    assert [r["position"] for r in got] == [2, 0, 1] and got[0]["rank_change"] == 2


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_bigram_topk", "field_bm25_body", "rrf_hybrid", "retrieval_eval", "retrieval_eval_by_group", "retrieval_compare", "candidate_recall"])
def test_whole_benchmark_texts_match_their_sql(spark, name):
    from corvane.plans import retrieval as P

    path, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    run, sql = P.QUERIES[name]
    df, result = run(spark, path), con.sql(sql)
    places = [result.columns.index(c) for c in df.columns]
    want = sorted([tuple(r[p] for p in places) for r in result.fetchall()], key=str)
    got = sorted(map(tuple, df.collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6) if all(isinstance(x, int | float) for x in g) else g == w


def test_a_stored_index_gives_the_same_ranking(spark, tmp_path):
    from corvane.operators import index as N

    rng = random.Random(7)
    docs = chunks(spark, [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(0, 9))) for _ in range(50)])
    asked = queries(spark, "alpha delta", "gamma", "none", "!!")
    index = N.build_index(docs, R.labelled_rows(docs), str(tmp_path / "i"))
    row = lambda df: sorted((r["query_id"], r["rank"], r["position"], round(r["score"], 9)) for r in df.collect())
    assert row(N.indexed_bm25(index, asked, 7)) == row(R.bm25(docs, asked, 7))
    empty = docs.where("false")
    assert N.indexed_bm25(N.build_index(empty, R.labelled_rows(empty), str(tmp_path / "e")), asked).count() == 0


def test_a_session_index_follows_its_files(spark, tmp_path):
    from corvane.operators import index as N

    path = str(tmp_path / "t")
    names = []
    for n in (3, 3, 5):
        docs = chunks(spark, ["some words here"] * n)
        if n == 5 or not names:
            docs.write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
        names.append(N.session_index(stored, "x", stored, lambda s=stored: R.labelled_rows(s)).n_docs)
    assert names == [3, 3, 5]


def test_dense_search_against_numpy(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 6)).round(2), rng.normal(size=(11, 6)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])]
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    vectors = spark.createDataFrame(rows, "position bigint, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(50, None), (51, [2.0])], "query_id bigint, vector array<float>")
    got = {(r["query_id"], r["rank"]): r["position"] for r in R.dense_search(vectors, asked, 5).collect()}
    scores = q.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    want = {(i, k + 1): p for i in range(11) for k, p in enumerate(sorted(range(300), key=lambda p: (-round(scores[i, p], 6), p))[:5])}
    assert got == want | {(51, 1): 901}


def test_section_parents_of_whole_texts(spark, monkeypatch):
    from corvane.plans import documents as P

    asked = []
    monkeypatch.setattr(P.R, "bm25", lambda chunks, queries, *a, f=P.R.bm25: (asked.append(queries), f(chunks, queries, *a))[1])
    P.section_parent_topk(spark, "/root/testdata/sf0.001")
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    assert {r["query_id"]: r["text"] for r in asked[0].collect()} == texts
