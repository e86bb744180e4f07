"""The registered queries and the pipeline on whole small folders: brute force, and empty tables."""

import random
from collections import Counter

import public_tokenizers
import pytest
from test_dedup import components, line_model, near_model, reference_print
from tokenizers import Tokenizer

from corvane.llm import decontam as D
from corvane.llm import registry

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_on_empty_tables(spark, empty, name):
    got = registry.queries()[name](spark, empty)
    assert got.columns and got.count() == 0


def test_the_pipeline_on_an_empty_table(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def folder_of(spark, path, rows, items):
    docs = [(i, t, g, "s", len(t or "")) for i, t, g in rows]
    spark.createDataFrame(docs, TABLES["documents"]).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, TABLES["benchmark"]).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"word{i}x" for i in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [f"Notice {k}: this line is common to very many of the documents" for k in range(3)]
    items = [(k, text(n)) for k, n in enumerate([6, 12, 30, 30])]
    rows = []
    for i in range(70):
        lines = [text(rng.randint(20, 60)) for _ in range(rng.randint(1, 3))]
        for line in rng.sample(common, rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), line.upper() if rng.random() < 0.3 else line)
        rows.append((i, "\n".join(lines), rng.choice(["en", "de", None])))
    for i in range(100, 130):  # near copies on both sides of the threshold
        body = rows[rng.randrange(40)][1].split(" ")
        cut = rng.choice([0, 2, 4, 8, 16, 30])
        rows.append((i, " ".join(body[: len(body) - cut] + [text(cut)] if cut else body), "en"))
    for i in range(200, 212):  # benchmark items, whole and changed
        passage = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            passage[rng.randrange(len(passage))] = "changed"
        rows.append((i, text(15) + " " + " ".join(passage) + " " + text(15), "de"))
    return [*rows, (300, None, "en"), (301, "", "en"), (302, "12 ²½", None), (303, "ok", None)], items


def found_in(text, passage):
    """Whether a window of the text has a weighted similarity of 0.8 or more with the passage."""
    item, words = ([D.bare(w) for w in D.words_of(t)] for t in (passage, text))
    k = min(5, len(item))
    counts, shingles, n = Counter(D.shingles_of(item, k)), D.shingles_of(words, k), len(item) - k + 1
    return max((D.weighted_similarity(Counter(shingles[a : a + n]), counts) for a in range(max(1, len(shingles) - n + 1))), default=0) >= 0.8


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_pipeline_against_brute_force(spark, tmp_path, seed):
    import corpus_pipeline

    rows, items = corpus(seed)
    state = [(i, t) for i, t, _ in rows if any(map(str.isalpha, t or ""))]
    state = [(i, kept) for i, _, _, kept in line_model(state)]
    state = [(i, t) for i, t in state if i in near_model(state)]
    state = [(i, t) for i, t in state if not any(found_in(t, passage) for _, passage in items)]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = sorted((i, t, len(t), library.encode(t, add_special_tokens=False).ids, True) for i, t in state)
    got = corpus_pipeline.run(spark, folder_of(spark, tmp_path, rows, items))
    assert sorted((r["doc_id"], r["text"], r["n_chars"], r["ids"], r["round_trip"]) for r in got.collect()) == want and len(want) < len(rows) - 10


def test_decontamination_query_against_brute_force(spark, tmp_path):
    rows, items = corpus(5)
    got = registry.queries()["op3_benchmark_decontamination"](spark, folder_of(spark, tmp_path, rows, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, k) for i, t, _ in rows for k, passage in items if found_in(t, passage)} and got


def test_simhash_query_against_brute_force(spark, tmp_path):
    rows, items = corpus(6)
    prints = [reference_print(t) for _, t, _ in rows]
    of = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {}
    for (i, _, _), c in zip(rows, of, strict=True):
        least[c] = min(least.get(c, i), i)
    got = registry.queries()["op8_simhash_near_dedup"](spark, folder_of(spark, tmp_path, rows, items)).collect()
    want = sorted((i, f"{p:016x}", least[c]) for (i, _, _), p, c in zip(rows, prints, of, strict=True))
    assert sorted(tuple(r) for r in got) == want
