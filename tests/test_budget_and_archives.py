"""Token budgets against a step-by-step model, and archives read by several tasks."""

import hashlib
import random
import zipfile

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.functions import prompts as P
from corvane.operators import budget as B
from corvane.operators.context import select_within_budget
from corvane.sources.zip_source import ZipPages

PATH = public_tokenizers.path("byte_bpe_50k.json")
CHUNKS = "array<struct<rank:int,position:bigint,source_url:string,page_title:string,section_title:string,text:string>>"


def evidence(spark, seed, n=12):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(["word", "資料", "https://a.example/x", "naïve", "x1", "and"]) for _ in range(rng.randint(0, k)))
    rows = [(q, text(9), [(r, 10 * q + r, f"u{r}", text(3), text(3), text(rng.choice([5, 40, 120]))) for r in range(1, rng.randint(0, 7) + 1)]) for q in range(n)]
    return rows, spark.createDataFrame(rows, f"query_id bigint, question string, chunks {CHUNKS}").repartition(3)


@pytest.mark.parametrize(("seed", "budget"), [(1, 400), (2, 520), (3, 100)])
def test_token_budget_equals_the_model(spark, seed, budget):
    rows, df = evidence(spark, seed)
    library = Tokenizer.from_file(PATH)
    shown = {r["query_id"]: (r["q"], r["c"]) for r in df.select("query_id", B.T.sanitised(F.col("question")).alias("q"), P.prompt_contexts(F.col("chunks")).alias("c")).collect()}
    want = {}
    for q, _, chunks in rows:
        question, contexts = shown[q]
        kept = []
        for k in range(len(chunks)):
            some = [contexts[i].asDict() | {"label": f"S{n}"} for n, i in enumerate([*kept, k], 1)]
            if all(len(library.encode(f(question, some), add_special_tokens=False).ids) <= budget for f in (B.generation_text, B.regeneration_text)):
                kept.append(k)
        want[q] = [chunks[i][1] for i in kept]
    got = {r["query_id"]: ([c["position"] for c in r["selected"]], r["fits"]) for r in B.select_by_tokens(df, budget, B.library_counter(PATH)).collect()}
    assert got == {q: (p, bool(p)) for q, p in want.items()}


def test_texts_equal_the_prompts_and_characters_the_default(spark):
    _, df = evidence(spark, 5)
    shown = df.withColumn("c", P.prompt_contexts(F.col("chunks")))
    for r in shown.select(B.T.sanitised(F.col("question")).alias("q"), "c", P.generation_prompt(F.col("question"), F.col("c")).alias("a"), P.regeneration_prompt(F.col("question"), F.col("c")).alias("b")).collect():
        contexts = [c.asDict() for c in r["c"]]
        assert (B.generation_text(r["q"], contexts), B.regeneration_text(r["q"], contexts)) == (r["a"], r["b"])
    characters = lambda: lambda texts: list(map(len, texts))
    row = lambda out: sorted((r["query_id"], [c["position"] for c in r["selected"]], r["fits"]) for r in out.collect())
    assert row(B.select_by_tokens(df, 900, characters)) == row(select_within_budget(df, 900))


def test_the_query_keeps_to_its_budget(spark):
    from corvane.plans import documents as D

    got = D.token_budget_select(spark, "/root/testdata/sf0.001")
    assert got.columns == ["query_id", "fits", "positions"] and got.count() == spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return str(path)


def test_members_spread_over_tasks(spark, tmp_path):
    spark.dataSource.register(ZipPages)
    path = archive(tmp_path / "a.zip", [(f"d/{i:03d}.html", f"<p>page {i}</p>" * 50) for i in range(300)] + [("d/x.txt", "no page")])
    load = lambda **options: spark.read.format("zip_pages").options(path=path, taskBytes=20_000, **options).load()
    rows = load()
    assert rows.rdd.getNumPartitions() > 5
    assert [r["logical_path"] for r in rows.orderBy("logical_path").collect()] == [f"d/{i:03d}.html" for i in range(300)]
    pages = rows.select(F.spark_partition_id().alias("task"), "content").agg(F.countDistinct("task").alias("tasks"), F.sum(F.length("content")).alias("n")).first()
    assert pages["tasks"] > 5 and pages["n"] == sum(len(f"<p>page {i}</p>" * 50) for i in range(300))
    assert load(sha256=hashlib.sha256(open(path, "rb").read()).hexdigest()).count() == 300
    with pytest.raises(Exception, match="SHA-256 differs"):
        load(sha256="0" * 64).count()
    with pytest.raises(Exception, match="too_many_members"):
        load(maxMembers=10).count()


@pytest.mark.parametrize(("members", "problem"), [([("../x.html", "a")], "unsafe_path"), ([("a.html", "x"), ("A.html", "y")], "collision"), ([("a/nul.html", "x")], "reserved_name")])
def test_unsafe_archives_are_refused_before_any_member_is_read(spark, tmp_path, members, problem):
    spark.dataSource.register(ZipPages)
    with pytest.raises(Exception, match=problem):
        spark.read.format("zip_pages").option("path", archive(tmp_path / "a.zip", [("fine.html", "x"), *members])).load().count()
    empty = archive(tmp_path / "e.zip", [])
    assert spark.read.format("zip_pages").option("path", empty).load().count() == 0
