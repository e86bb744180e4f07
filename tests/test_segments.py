"""The incremental index against full builds."""

import random

import pytest

from corvane.operators import index as N
from corvane.operators import retrieve as R
from corvane.operators import segments as G

CHUNK = "position bigint, text string, page_title string, section_title string, source_url string, chunk_index int, start_index int"


def chunks(spark, texts):
    return spark.createDataFrame([(i, t, "", "", f"https://x.example/{i}", 0, 0) for i, t in texts.items()], CHUNK)


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["position"], round(r["score"], 8)) for r in df.collect())


def test_updates_tokenise_what_changed_and_rank_like_a_full_build(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choices(["alpha", "beta", "Gamma.x()", "delta", "日本語の処理", "eps"], k=rng.randint(0, 7)))
    texts = {i: text() for i in range(40)}
    questions = spark.createDataFrame(list(enumerate(["alpha delta", "x gamma", "処理 beta", "none"])), "query_id bigint, text string")
    path, seen = str(tmp_path / "index"), []

    def rows_of(some):
        seen.append(sorted(r["position"] for r in some.select("position").collect()))
        return R.labelled_rows(some)

    def step():
        docs = chunks(spark, texts)
        change = G.update(docs, path, rows_of, buckets=8, fanout=2)
        assert ranked(N.indexed_bm25(G.open_segments(spark, path), questions, 6)) == ranked(R.bm25(docs, questions, 6))
        return change

    assert step() == (1, 40, 0, 0) and seen.pop() == list(range(40))
    assert step() == (1, 0, 0, 0) and not seen  # nothing changed, nothing is written
    texts[3], texts[50] = "alpha alpha beta", "delta"
    del texts[7]
    assert step() == (2, 2, 2, 2) and seen.pop() == [3, 50]
    for k in (1, 2):
        texts[60 + k] = text()
    texts[50] = "eps"
    assert step()[1:3] == (3, 1) and seen.pop() == [50, 61, 62]
    del texts[60 + 1]
    assert step() == (4, 0, 1, 0)  # a removal alone tokenises nothing
    first = G.open_segments(spark, path, 1)
    assert first.n_docs == 40 and first.postings.select("position").distinct().where("position = 7").count() <= 1
    assert G.forget(spark, path) > 0 and G.versions(spark, path) == [4]
    assert ranked(N.indexed_bm25(G.open_segments(spark, path), questions, 6)) == ranked(R.bm25(chunks(spark, texts), questions, 6))


def test_a_second_writer_is_refused_and_an_empty_index_opens(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no index"):
        G.open_segments(spark, path)
    none = chunks(spark, {1: "x"}).where("false")
    assert G.update(none, path, R.labelled_rows, buckets=4) == (1, 0, 0, 0)
    asked = spark.createDataFrame([(1, "x")], "query_id bigint, text string")
    assert G.open_segments(spark, path).n_docs == 0 and N.indexed_bm25(G.open_segments(spark, path), asked).count() == 0
    monkeypatch.setattr(G, "versions", lambda *a: [])  # what a writer saw that began before
    with pytest.raises(RuntimeError, match="meanwhile"):
        G.update(chunks(spark, {1: "x"}), path, R.labelled_rows, buckets=4)
