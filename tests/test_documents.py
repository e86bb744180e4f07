"""Pages, chunks, contexts, contracts, evaluation, sources and sinks."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import contracts as C
from corvane.functions import url as U
from corvane.operators import chunk as K
from corvane.operators import context as X
from corvane.operators import evaluate as E
from corvane.operators import html as H
from corvane.operators import integrity as I
from corvane.operators import publish
from corvane.sources import config, crawl, files
from corvane.streaming import ingest

PAGE = """<html><head><title>T</title></head><body><nav>x</nav><main><p>Lead text that is long enough to stay.</p>
<h1 id=a>One</h1><p>First paragraph with enough text.<p>Second one.<ul><li>i1<li>i2 <b>b</b></ul>
<h2 id=a>Two</h2><pre>  code
   more  </pre><table><tr><th>k<th>v<tr><td>1<td>2</table><h2>Short</h2><p hidden>no</p><p>tiny</main></body></html>"""


def test_generic_page():
    got = H.parse_page(PAGE, "d/p.html", "https://x.example/d/p.html", H.ParserSettings())
    assert [s["section_title"] for s in got["sections"]] == ["T", "One", "Two"]
    assert [s["anchor"] for s in got["sections"]] == ["", "a", "a-2"]
    assert got["sections"][1]["text"] == "First paragraph with enough text.\n\nSecond one.\n\n- i1\n- i2 b"
    assert got["sections"][2]["text"] == "code\n   more\n\nk | v\n1 | 2"
    assert (got["excluded_sections"], got["code_blocks"], got["tables"]) == (1, 1, 1)


def test_sphinx_page_permalinks_and_parent_anchor():
    html = "<title>P</title><div class=body role=main><section id=s><h2>¶</h2><p class=rubric></p><dt>near</dt><p>Enough text in this section here.</p><h3>Real<a class=headerlink>¶</a></h3><p>More text that is long enough.</p></section></div>"
    got = H.parse_page(html, "lib/x.html", "https://x.example/lib/x.html", H.ParserSettings(sphinx=True))["sections"]
    assert [s["section_title"] for s in got] == ["¶", "Real"] and {s["anchor"] for s in got} == {"s"}


def test_bad_page_is_a_failure_row(spark):
    rows = spark.createDataFrame([(1, "http://x.example/a", "a", ""), (2, "http://x.example/b", "b", PAGE), (3, None, None, None)], "page_id bigint, url string, logical_path string, html string")
    got = H.ingestion_counters(H.parse_pages(rows)).first()
    assert (got["n_pages"], got["n_failed"], got["n_sections"]) == (3, 2, 3)


@pytest.mark.parametrize("sphinx", [False, True])
def test_whatever_a_parser_raises_stays_with_its_page(spark, sphinx):
    pages = ["<p>text</p><![foo bar]]>", "<div>" * 100_000, "<main><h1 id=a>T</h1><p>Enough text to make a section.</p></main>"]
    rows = spark.createDataFrame([(i, f"http://x.example/{i}", f"{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, logical_path string, html string")
    got = H.parse_pages(rows, H.ParserSettings(sphinx=sphinx)).select("page_id", "parsed.error", F.size("parsed.sections").alias("n")).orderBy("page_id").collect()
    assert got[0]["error"].startswith("AssertionError") and got[1]["error"] and (got[2]["error"], got[2]["n"]) == (None, 1)


def near_title(around):
    tree = H.tree_of(f"<body><h1>Page</h1>{around}</body>")
    return H._near_title(next(n for n in tree.walk() if n.attrs.get("id") == "x"))


def test_titles_from_around_a_heading():
    assert near_title("<section><p class=rubric>far</p><b></b><h2 id=x></h2><dt>near</dt></section>") == "near"
    assert near_title("<section><dt>before</dt><h2 id=x></h2><dt>after</dt></section>") == "before"
    assert near_title("<section><dt></dt><h2 id=x></h2><i></i><p><strong>bold</strong></p></section>") == "bold"
    assert near_title("<section><h2 id=x></h2><p>plain</p></section><h2>Later</h2>") == "Page"


@pytest.mark.parametrize("seed", range(20))
def test_split_invariants(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "longerword", "\n", "\n\n", "。", "、", " "]) for _ in range(rng.randint(0, 300)))
    size, overlap = rng.randint(5, 60), rng.randint(0, 4)
    covered = [c.isspace() for c in text]
    for piece, at in K.split_text(text, size, overlap):
        assert text[at : at + len(piece)] == piece and 0 < len(piece) <= max(size, len(text) if len(text) <= size else size)
        covered[at : at + len(piece)] = [True] * len(piece)
    assert all(covered)


def naive_window(text, match, budget):
    return X.largest_window(text, match, lambda a, b: b - a <= budget)


def test_window_grows_by_smaller_side():
    text = "aaaa\n\nbb\n\ncccccccc\n\ndd"
    at = text.index("bb")
    assert naive_window(text, (at, at + 2), 10) == (0, at + 2)
    assert naive_window(text, (at, at + 2), 1) is None
    with pytest.raises(ValueError):
        naive_window(text, (5, 5), 10)


@pytest.mark.parametrize("seed", range(25))
def test_window_against_all_windows(seed):
    """Greedy growth gives whole paragraphs around the match, and no further paragraph of an open side would fit."""
    rng = random.Random(seed)
    text = "\n\n".join("x" * rng.randint(1, 30) for _ in range(rng.randint(1, 8)))
    begin = rng.randrange(len(text))
    while text[begin] == "\n":
        begin = rng.randrange(len(text))
    budget = rng.randint(1, len(text) + 3)
    got = naive_window(text, (begin, begin + 1), budget)
    spans = X.paragraph_spans(text)
    starts, ends = {s for s, _ in spans}, {e for _, e in spans}
    own = next((s, e) for s, e in spans if s <= begin < e)
    if own[1] - own[0] > budget:
        assert got == (begin, begin + 1)
        return
    assert got[0] in starts and got[1] in ends and got[0] <= own[0] and own[1] <= got[1] and got[1] - got[0] <= budget
    more = [got[1] - max((s for s, _ in spans if s < got[0]), default=got[0] - budget - 9), min((e for _, e in spans if e > got[1]), default=got[1] + budget + 9) - got[0]]
    assert min(more) > budget or max(more) > budget


def test_budget_skips_and_goes_on(spark):
    kind = "query_id bigint, question string, chunks array<struct<rank:int,position:bigint,source_url:string,page_title:string,section_title:string,text:string>>"
    rows = [(1, "q", [(1, 1, "u", "p", "s", "x" * 50), (2, 2, "u", "p", "s", "y" * 5000), (3, 3, "u", "p", "s", "z" * 40)]), (2, "q", [(1, 4, "u", "p", "s", "y" * 5000)])]
    df = spark.createDataFrame(rows, kind)
    got = {r["query_id"]: r for r in X.select_within_budget(df, 500).collect()}
    assert [c["position"] for c in got[1]["selected"]] == [1, 3] and not got[2]["fits"]
    from corvane.functions import prompts as P

    full = df.where("query_id = 1").select(F.filter("chunks", lambda c: c["position"] != 2).alias("c"), "question").select(F.length(P.generation_prompt(F.col("question"), P.prompt_contexts(F.col("c")))).alias("a"), F.length(P.regeneration_prompt(F.col("question"), P.prompt_contexts(F.col("c")))).alias("b")).first()
    most = max(full["a"], full["b"])
    assert [len(X.select_within_budget(df.where("query_id = 1"), n).first()["selected"]) for n in (most, most - 1)] == [2, 1]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"status":"answer","answer_text":"a [S1]","reason":null}', []),
        ('{"status":"abstain","answer_text":"","reason":"insufficient_evidence"}', []),
        ("```json\n{}\n```", ["markdown_code_fence"]),
        ("", ["invalid_json"]),
        ("{bad", ["invalid_json"]),
        ('{"status":"answer","status":"answer","answer_text":"","reason":null}', ["duplicate_key"]),
        ('{"status":"answer","answer_text":"x","reason":NaN}', ["non_standard_json_value"]),
        ("[1]", ["top_level_not_object"]),
        ('{"status":"answer","why":1}', ["missing_key", "extra_key"]),
        ('{"status":1,"answer_text":2,"reason":3}', ["status_wrong_type", "answer_text_wrong_type", "reason_wrong_type"]),
        ('{"status":"maybe","answer_text":"","reason":null}', ["unknown_status"]),
        ('{"status":"answer","answer_text":" ","reason":"x"}', ["answer_reason_must_be_null", "empty_answer"]),
        ('{"status":"abstain","answer_text":"see [S1]","reason":null}', ["unknown_reason", "abstain_answer_text_must_be_empty", "abstain_citation_detected"]),
    ],
)
def test_answer_contract(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(C.answer_json_reasons(F.col("raw")).alias("r")).first()["r"] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ({"evidence": [{"source": "S1", "facts": ["quick  brown"]}]}, []),
        ({"evidence": [{"source": "S9", "facts": ["quick"]}]}, ["invalid_evidence_source"]),
        ({"evidence": [{"source": "S1", "facts": []}]}, ["invalid_evidence_facts"]),
        ({"evidence": [{"source": "S1", "facts": ["slow"]}]}, ["unsupported_evidence_fact"]),
        ({"evidence": [{"source": "S1", "facts": ["x" * 241]}]}, ["evidence_fact_too_long"]),
        ({"evidence": [{"source": "S1", "facts": ["the", "quick", "brown", "fox"]}]}, ["too_many_evidence_facts"]),
        ({"proof": []}, ["invalid_evidence_schema"]),
    ],
)
def test_evidence_contract(spark, raw, want):
    df = spark.createDataFrame([(json.dumps(raw), ["the quick brown\n fox"])], "raw string, contexts array<string>")
    assert df.select(C.evidence_reasons(F.col("raw"), F.col("contexts")).alias("r")).first()["r"] == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Ex.example:80/a/./b//c?x=1#f", "http://ex.example/a/b/c"),
        ("https://ex.example", "https://ex.example/"),
        ("https://ex.example:8443/a/", "https://ex.example:8443/a/"),
        ("https://u@ex.example/", None),
        ("https://ex.example/a/../b", None),
        ("ftp://ex.example/", None),
        ("https://ex.example/a%20b", "https://ex.example/a%20b"),
    ],
)
def test_normalised_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.normalised(F.col("u")).alias("x")).first()["x"] == want


def test_metrics_and_comparison(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (2, "a", 4), (3, None, None)], "query_id bigint, topic string, first_relevant_rank int")
    got = E.ranking_metrics(ranks).first()
    assert (got["hit_at_1"], got["hit_at_5"], got["n_missed"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 1)
    assert got["mrr_at_10"] == pytest.approx((1 + 0.25) / 3)
    better = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, None, 6)], ranks.schema)
    moved = E.compare(ranks, better).first()
    assert (moved["improved"], moved["worsened"], moved["entered_top_10"]) == (2, 1, [3])
    with pytest.raises(Exception, match="must match"):
        E.compare(ranks, better.where("query_id < 3")).collect()


def test_snapshot_digest_ignores_partitioning(spark):
    df = spark.range(100).withColumn("t", F.concat(F.lit("x"), "id"))
    one, two = (I.snapshot_digest(d, ["id"], "t").first() for d in (df.repartition(7), df.coalesce(1)))
    assert one == two and I.snapshot_digest(df.where("id > 0"), ["id"], "t").first() != one


def test_publish_switches_whole_versions(spark, tmp_path):
    root = str(tmp_path)
    publish.publish(root, {"a": spark.range(3)})
    second = publish.publish(root, {"a": spark.range(5)}, {"fingerprint": "f"})
    assert publish.read_published(spark, root, "a").count() == 5 and publish.manifest(spark, root)["fingerprint"] == "f"
    with pytest.raises(ValueError):
        publish.publish(root, {"a": spark.range(0)})
    assert publish.current(spark, root) == second and publish.recover(spark, root) == []
    assert len(publish.recover(spark, root, 0)) == 2
    assert publish.read_published(spark, root, "a").count() == 5


def test_a_lost_pointer_costs_no_version(spark, tmp_path):
    root = str(tmp_path)
    only = publish.publish(root, {"a": spark.range(3)})
    (tmp_path / "CURRENT").unlink()
    with pytest.raises(ValueError, match="pointer"):
        publish.recover(spark, root, 0)
    assert publish.complete_versions(spark, root) == [only]
    publish.restore(spark, root, only)
    assert publish.read_published(spark, root, "a").count() == 3
    with pytest.raises(ValueError):
        publish.restore(spark, root, "none")


def test_zip_source(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/p.html", PAGE)
        z.writestr("../evil.html", PAGE)
    df = spark.createDataFrame([(bytearray(out.getvalue()),)], "content binary")
    assert [r["logical_path"] for r in files.zip_pages(df, "https://x.example/", on_problem="skip").collect()] == ["a/p.html"]
    with pytest.raises(Exception, match="unsafe_path"):
        files.zip_pages(df, "https://x.example/").collect()
    members = files.zip_members(df).select(F.explode("members").alias("m")).select("m.*")
    assert {(r["path"], r["problem"]) for r in files.member_problems(members).collect()} == {("../evil.html", "unsafe_path")}
    with pytest.raises(Exception, match="SHA-256"):
        files.zip_pages(df, "https://x.example/", "0" * 64).collect()
    assert publish.deterministic_zip({"b": b"1", "a": b"2"}) == publish.deterministic_zip({"a": b"2", "b": b"1"})


@pytest.mark.parametrize(
    ("members", "problem"),
    [
        ({"a.html": 10, "A.html": 10}, "collision"),
        ({"a": 1, "a/b.html": 1}, "file_directory_collision"),
        ({"x/nul.html": 1}, "reserved_name"),
        ({"big.html": 5000}, "member_too_large"),
        ({f"{i}.html": 900 for i in range(9)}, "archive_too_large"),
        ({f"{i}.html": 1 for i in range(11)}, "too_many_members"),
    ],
)
def test_archives_beyond_the_rules_are_refused(spark, members, problem):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, size in members.items():
            z.writestr(name, "x" * size)
    df = spark.createDataFrame([(bytearray(out.getvalue()),)], "content binary")
    limits = {"max_members": 10, "max_member_bytes": 1000, "max_total_bytes": 8000}
    with pytest.raises(Exception, match=problem):
        files.zip_pages(df, "https://x.example/", **limits).collect()


def test_html_tree(spark, tmp_path):
    for name in ("lib/a.html", "lib/b.html", "ref/c.html", "lib/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(PAGE)
    got = files.html_tree(spark, str(tmp_path), "https://x.example/", ("lib/",), 1).collect()
    assert [(r["logical_path"], r["source_url"], r["category"]) for r in got] == [("lib/a.html", "https://x.example/lib/a.html", "lib")]
    (tmp_path / "lib/bad.html").write_bytes(b"<p>\xff\xfe</p>")
    rows = {r["logical_path"]: r for r in files.html_tree(spark, str(tmp_path), "https://x.example/", ("lib/",)).collect()}
    assert rows["lib/bad.html"]["content"] is None and rows["lib/a.html"]["content"] == PAGE


def test_crawl_scope_order_and_dedupe(spark):
    site = {
        "https://x.example/d/": '<a href="b.html">b</a><a href="a.html">a</a><a href="/out.html">o</a><a href="c.pdf">p</a>',
        "https://x.example/d/a.html": '<link rel="canonical" href="/d/b.html"><a href="mailto:x">m</a>',
        "https://x.example/d/b.html": '<a href="/d/">home</a>',
    }

    def transport(url):
        body = site.get(url)
        return crawl.Response(url, 200 if body else 404, "text/html; charset=utf-8", (body or "").encode())

    got = crawl.crawl(spark, ["https://x.example/d/"], transport, 10).orderBy("nth").collect()
    assert [r["source_url"] for r in got] == ["https://x.example/d/", "https://x.example/d/a.html"]
    assert got[1]["canonical_url"] == "https://x.example/d/b.html"
    assert crawl.crawl(spark, ["https://x.example/d/"], transport, 1).count() == 1


def test_crawl_refuses_redirects_out_of_scope_and_unreadable_pages(spark):
    def transport(url):
        if url.endswith("/robots.txt"):
            return crawl.Response(url, 200, "text/plain", b"User-agent: *\nDisallow: /d/no\n")
        if url == "https://x.example/d/":
            return crawl.Response(url, 200, "text/html", b'<a href="away">a</a><a href="bad">b</a><a href="no">n</a><a href="ok">o</a>')
        if url.endswith("away"):
            return crawl.Response("https://other.example/d/away", 200, "text/html", b"<p>x</p>")
        return crawl.Response(url, 200, "text/html; charset=utf-8", b"\xff" if url.endswith("bad") else b"<p>fine</p>")

    waits = []
    got = crawl.crawl(spark, ["https://x.example/d/"], transport, 10, allowed=crawl.robots(transport), pause=lambda: waits.append(1)).orderBy("nth").collect()
    assert [r["source_url"] for r in got] == ["https://x.example/d/", "https://x.example/d/ok"] and len(waits) == 3


def test_robots_that_cannot_be_had_allow_nothing():
    def site(status, url="https://x.example/robots.txt"):
        return crawl.robots(lambda _: crawl.Response(url, status, "text/plain", b""))

    for status, fine in ((200, True), (404, True), (410, True), (500, False), (403, False)):
        assert site(status)("https://x.example/d/a") is fine
    assert not site(200, "https://other.example/robots.txt")("https://x.example/d/a")

    def unreachable(url):
        raise OSError(url)

    assert not crawl.robots(unreachable)("https://x.example/d/a")


def test_crawl_counts_pages_only(spark):
    site = {
        "https://x.example/d/": ("text/html", b'<a href="http://[bad">x</a><a href="a">a</a><a href="b">b</a><a href="c">c</a><a href="d">d</a>'),
        "https://x.example/d/a": ("application/pdf", b'<a href="hidden">h</a>'),
        "https://x.example/d/b": ("text/html", b'<link rel="canonical" href="/d/">again'),
        "https://x.example/d/c": ("text/html", b'<p>c</p><a href="e">e</a><![foo bar]]>'),
        "https://x.example/d/d": ("text/html", b"<p>d</p>"),
    }
    got = crawl.crawl(spark, ["https://x.example/d/"], lambda u: crawl.Response(u, 200 if u in site else 404, *site.get(u, ("", b""))), 3)
    assert [r["source_url"][-1] for r in got.orderBy("nth").collect()] == ["/", "c", "d"]


def test_decoding():
    assert crawl.decode_html("é".encode("cp1252"), "text/html; charset=windows-1252") == "é"
    assert crawl.decode_html(b'<meta charset="latin-1">\xe9', "text/html").endswith("é")
    for body, kind in ((b"\xff", "text/html"), (b"x", "text/html; charset=none-such")):
        with pytest.raises(ValueError):
            crawl.decode_html(body, kind)


def test_config_is_strict(tmp_path):
    path = tmp_path / "c.toml"
    good = 'site_id = "s"\nbase_url = "https://x.example/"\nloader = "zip_html"\nparser = "generic"\n'
    path.write_text(good)
    assert config.load_config(path).chunk_size == 1000
    for bad in ("nope = 1", "chunk_size = 0", "chunk_size = true", 'chunk_size = "1"', "chunk_overlap = 5000"):
        path.write_text(good + bad)
        with pytest.raises(ValueError):
            config.load_config(path)


def test_questions(spark):
    rows = spark.createDataFrame([("1", "", "conceptual", ["k"]), ("1", "q", "odd", [])], "id string, question string, query_type string, expected_url_keywords array<string>")
    got = {r["problem"] for r in files.question_problems(rows, rows.select("id")).collect()}
    assert got == {"blank_question", "no_keywords", "duplicate_id", "unknown_query_type", "overlaps_development"}


def test_streaming_ingest_drops_repeated_content(spark, tmp_path):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    pages = spark.createDataFrame([(1, "https://x.example/a", PAGE, now), (2, "https://x.example/b", PAGE, now), (3, "https://x.example/c", PAGE.replace("Lead", "Other lead"), now)], ingest.PAGE)
    pages.write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("page_id").distinct().count() == 2
