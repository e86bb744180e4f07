"""Corpus order, pruned indexes, containment by anchors and windows over paragraph rows, against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import prompts as P
from corvane.operators import contain, fusion, order, scratch, spans
from corvane.operators import index as N
from corvane.operators import retrieve as R
from corvane.operators.context import largest_window, paragraph_spans

CHUNK = "position bigint, text string, page_title string, section_title string, source_url string, chunk_index int, start_index int"


def chunks(spark, texts):
    return spark.createDataFrame([(i, t, "", "", f"https://x.example/{i}", 0, 0) for i, t in enumerate(texts)], CHUNK)


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def plan_of(df):
    return df._jdf.queryExecution().toString()


# --- corpus order -----------------------------------------------------------------------------------------------------


def test_positions_are_places_in_the_order(spark):
    rng = random.Random(1)
    rows = [(page, section, f"t{rng.random()}") for page in range(12) for section in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page int, section int, position string").repartition(7)
    got = order.with_positions(df, "page", "section").collect()
    assert {(r["page"], r["section"]): r["position"] for r in got} == {k: n for n, k in enumerate(sorted((p, s) for p, s, _ in rows))}
    assert [r["n"] for r in order.with_positions(df, "page", "section", name="n", first=5).orderBy("n").limit(2).collect()] == [5, 6]


def test_positions_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)] + [("same", 4)] * 500, "k string, v int")
    got = sorted((r["position"], r["k"]) for r in order.with_positions(df, "k").collect())
    assert [p for p, _ in got] == list(range(503)) and [k for _, k in got] == [None, "a", "b"] + ["same"] * 500
    assert order.with_positions(df.where("false"), "k").count() == 0
    with pytest.raises(ValueError, match="order"):
        order.with_positions(df)


def test_pages_of_many_sections_keep_apart(spark, monkeypatch):
    """Section 100 of one page and section 0 of the next once had one position."""
    from corvane.plans import documents as D

    rows = [(page, k, f"word{page}x{k} and more text", "", "", f"u{page}", "") for page in (1, 2) for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id bigint, ordinal int, text string, page_title string, section_title string, source_url string, anchor string")
    seen = []
    monkeypatch.setattr(D, "html_sections", lambda *_: pages)
    monkeypatch.setattr(D.R, "bm25", lambda cut, *a, f=D.R.bm25: (seen.append(cut), f(cut, *a))[1])
    D.section_parent_topk(spark, "/root/testdata/sf0.001")
    assert seen[0].select("position").distinct().count() == seen[0].count() == 240


# --- pruned indexes ---------------------------------------------------------------------------------------------------


def corpus(seed, n=150):
    rng = random.Random(seed)
    rare = [f"rare{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        words = rng.choices(["the", "of", "and", "in", "os.path.join()", "Run"], k=rng.randint(3, 12)) + rng.choices(rare, k=rng.randint(0, 8))
        texts.append(" ".join(words) + rng.choice(["", " 日本語の処理", " 東京 京都々", "語"]))
    return texts, [" ".join(rng.choices(["the", "of", "in"], k=2) + rng.choices(rare, k=rng.randint(0, 5)) + rng.choices(["", "日本語", "処理", "os.path", "京"], k=1)) for _ in range(25)]


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["position"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize(("seed", "common", "k"), [(1, 25, 5), (2, 3, 2)])
def test_pruned_ranking_is_exact(spark, tmp_path, monkeypatch, seed, common, k):
    texts, asked = corpus(seed)
    docs, questions = chunks(spark, texts), queries(spark, asked)
    monkeypatch.setattr(N, "COMMON", common)
    monkeypatch.setattr(N, "FEW_PAIRS", 0)
    index = N.build_index(docs, R.labelled_rows(docs), str(tmp_path / "i"))
    for sizes in ((2, 3), (2,)):  # one index, any n-gram sizes
        assert ranked(N.indexed_bm25(index, questions, k, sizes)) == ranked(R.bm25(docs, questions, k, sizes))


def test_common_terms_are_looked_up_for_contenders_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "FEW_PAIRS", 0)
    texts, _ = corpus(5, 600)
    asked = ["the of " + " ".join(w for w in t.split() if w.startswith("rare")) for t in texts if t.count("rare") > 5][:20]
    docs, questions = chunks(spark, texts), queries(spark, asked)
    index = N.build_index(docs, R.labelled_rows(docs), str(tmp_path / "i"))
    every, some = N.indexed_scores(index, questions).count(), N.contenders(index, questions, 1).count()
    assert some < every / 4


def test_a_batch_reads_the_buckets_of_its_terms(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    docs = chunks(spark, [" ".join(rng.sample(words, 60)) for _ in range(400)])
    index = N.build_index(docs, R.labelled_rows(docs), str(tmp_path / "i"), buckets=1024)
    weighed = N.asked_terms(index, queries(spark, [" ".join(rng.sample(words, 5)) for _ in range(10)]))
    scan = N.in_buckets(index.postings, index, weighed)
    assert 0 < scan.count() < index.postings.count() / 10
    assert "PartitionFilters: [bucket" in plan_of(scan)


def test_symbols_and_overlap_by_postings(spark, tmp_path):
    texts, asked = corpus(6)
    docs, questions = chunks(spark, texts), queries(spark, [*asked, "", "!!", "join os.path"])
    symbols = N.build_index(docs, R.field_rows(docs, "identifiers", N.SIZES), str(tmp_path / "s"))
    assert ranked(N.indexed_symbols(symbols, questions, 6)) == ranked(R.symbol_search(R.symbol_records(docs), questions, 6))
    labelled = N.build_index(docs, R.labelled_rows(docs), str(tmp_path / "l"))
    candidates = scratch.written(N.indexed_bm25(labelled, questions, 12, (2,)), "candidates")
    want, got = fusion.rerank(candidates, questions, docs, 5), N.indexed_overlap(labelled, candidates, questions, 5)
    row = lambda df: sorted((r["query_id"], r["rank"], r["position"], round(r["score"], 9), r["original_rank"], r["rank_change"]) for r in df.collect())
    assert row(got) == row(want)


def test_states_of_many_and_of_no_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "FEW_FILES", 2)
    stored = lambda: spark.read.parquet(str(tmp_path / "t"))
    chunks(spark, ["a", "b", "c", "d"]).repartition(4).write.parquet(str(tmp_path / "t"))
    first = N.state_of(stored())
    assert len(stored().inputFiles()) > 2 and N.state_of(stored()) == first
    chunks(spark, ["e"]).write.mode("append").parquet(str(tmp_path / "t"))
    assert N.state_of(stored()) != first
    docs = chunks(spark, ["some text"])
    with pytest.raises(ValueError, match="files"):
        N.session_index(docs, "x", docs, lambda: R.labelled_rows(docs))


# --- containment ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containment_equals_contains(spark, seed):
    rng = random.Random(seed)
    words = ["aa", "b", "ccc", "d.", "é", "the", "long-word"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(80)] + ["", "nospacesatall", None]
    passages = ["", None, "nothing has this", "a", "é", "spacesat", "nospacesatall", "zzz zz z"]
    for t in rng.choices([t for t in texts if t], k=60):
        a = rng.randrange(len(t))
        passages.append(t[a : a + rng.choice([1, 2, 5, 9, 15, 40, 200])])
    asked = spark.createDataFrame(list(enumerate(passages)), "passage_id bigint, passage string")
    held = spark.createDataFrame(list(enumerate(texts)), "position bigint, text string").repartition(3)
    got = contain.containing(asked, held)
    assert sorted(map(tuple, got.collect())) == [(i, k) for i, p in enumerate(passages) for k, t in enumerate(texts) if p and t is not None and p in t]
    assert contain.containing(asked.where("false"), held).count() == 0 and contain.containing(asked, held.where("false")).count() == 0


@pytest.mark.parametrize("name", ["passage_containment", "retrieval_eval", "retrieval_eval_by_group", "retrieval_compare", "candidate_recall"])
def test_no_plan_pairs_all_rows(spark, name, monkeypatch):
    from corvane.plans import retrieval as Q

    plans = []
    monkeypatch.setattr(scratch, "written", lambda df, what, f=scratch.written: (plans.append(plan_of(df)), f(df, what))[1])
    plans.append(plan_of(Q.QUERIES[name][0](spark, "/root/testdata/sf0.001")))
    assert len(plans) > 2 and not any(word in p for p in plans for word in ("NestedLoop", "CartesianProduct"))


# --- paragraphs and windows -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "bins"), [(1, 4096), (2, 7), (3, 1)])
def test_windows_equal_the_step_by_step_model(spark, monkeypatch, seed, bins):
    monkeypatch.setattr(spans, "BIN", bins)
    rng = random.Random(seed)
    texts, matches, want = [], [], {}
    for k in range(60):
        parts = ["x" * rng.randint(1, 30) + rng.choice(["", " y", "\nz"]) for _ in range(rng.randint(1, 14))]
        text = rng.choice(["", "\n", " "]) + rng.choice(["\n\n", "\n \t\n", "\n\n\n\n"]).join(parts) + rng.choice(["", "  \n"])
        texts.append((k, text))
        for m in range(3):
            a, b = rng.choice(paragraph_spans(text))
            begin = rng.randint(a, b - 1)
            end = min(len(text), begin + rng.randint(1, 40))
            room = rng.choice([-3, 0, 1, 5, 20, 45, 80, 150, 1000])
            matches.append((10 * k + m, k, begin, end, room))
            found = (0, len(text), "full_section") if len(text) <= room else largest_window(text, (begin, end), lambda x, y, room=room: y - x <= room)
            if found:
                want[10 * k + m] = found if len(found) == 3 else (*found, "section_window")
    sections = spark.createDataFrame(texts, "section_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(matches, "match_id bigint, section_id bigint, match_start bigint, match_end bigint, room bigint")
    got = {r["match_id"]: (r["start"], r["end"], r["scope"]) for r in spans.grown_windows(sections, asked).collect()}
    assert got == want and len({v[2] for v in want.values()}) == 2


def test_interval_join_gives_each_pair_once(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(spans, "BIN", 10)
    some = [(rng.randint(0, 2), a, a + rng.randint(0, 60), i) for i, a in enumerate(rng.choices(range(300), k=80))]
    asked = [(rng.randint(0, 2), a, a + rng.randint(1, 60), i) for i, a in enumerate(rng.choices(range(300), k=50))]
    left = spark.createDataFrame(some, "section_id int, start bigint, end bigint, i int")
    right = spark.createDataFrame(asked, "section_id int, begin bigint, until bigint, j int")
    got = sorted((r["i"], r["j"]) for r in spans.overlapping(left, right).collect())
    assert got == sorted((i, j) for s, a, b, i in some for t, c, d, j in asked if s == t and a < d and c < b)


def test_matches_outside_their_text_are_errors(spark):
    sections = spark.createDataFrame([(1, "aaa\n\nbbb")], "section_id bigint, text string")
    for begin, end in ((2, 99), (-1, 2), (5, 5)):
        asked = spark.createDataFrame([(1, 1, begin, end, 2)], "match_id bigint, section_id bigint, match_start bigint, match_end bigint, room bigint")
        with pytest.raises(Exception, match="match"):
            spans.grown_windows(sections, asked).collect()


def test_room_is_what_the_prompts_leave(spark):
    held = [("p", "s", "first evidence"), ("p2", "s2", "more")]
    row = spark.createDataFrame([("the question", held, "page", "section", "t" * 40)], "question string, selected array<struct<page_title:string,section_title:string,text:string>>, page_title string, section_title string, text string")
    row = row.withColumn("room", spans.room_left(F.col("question"), F.col("selected"), F.col("page_title"), F.col("section_title"), 330))
    parts = F.concat("selected", F.array(F.struct("page_title", "section_title", F.left("text", F.col("room").cast("int")).alias("text"))))
    contexts = P.prompt_contexts(parts)
    got = row.select("room", F.length(P.generation_prompt(F.col("question"), contexts)).alias("a"), F.length(P.regeneration_prompt(F.col("question"), contexts)).alias("b")).first()
    assert got["room"] < 40 and max(got["a"], got["b"]) == 330
    none = row.select(spans.room_left(F.col("question"), F.slice("selected", 1, 0), F.col("page_title"), F.col("section_title"), 10).alias("room")).first()
    assert none["room"] < 0
