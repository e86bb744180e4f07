"""Operators 2, 5, 6 and 7, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane.llm import hmm as M
from corvane.llm import langid as L
from corvane.llm import quality as Q
from corvane.llm.q_hmm import op5_lm_scoring
from corvane.llm.q_langid import op7_language_id
from corvane.llm.q_quality import op2_quality_classifier
from corvane.llm.urlfilter import Rule, judge_urls

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = {r["doc_id"]: r for r in op2_quality_classifier(spark, SF).collect()}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_quality_without_both_labels(spark, labels, want):
    rows = spark.createDataFrame([(Q.text_statistics("some text"), y) for y in labels], "stats array<double>, label int")
    model = Q.train_quality(rows)
    stats = Q.document_statistics(spark.createDataFrame([(1, None, 2), (1, "", 3), (None, "x " * 5000, 4)], "doc_id bigint, text string, score int"))
    got = Q.score_quality(stats, model).collect()
    assert len(got) == 3 and all(r["score"] == pytest.approx(want) for r in got)


def test_quality_scores_against_one_process(spark, tmp_path):
    rng = random.Random(5)
    words = {0: ["buy", "NOW!!!", "$$$", "click", "here"], 1: ["The", "garden", "was", "quiet", "today."]}
    rows, labels = [(0, None), (1, ""), (2, "x " * 30_000)], [(1, 0), (2, 1), (3, 2), (4, None), (5, 0), (5, 1)]
    for i in range(3, 160):
        y = i % 2
        rows.append((i, " ".join(rng.choice(words[y if rng.random() < 0.9 else 1 - y]) for _ in range(rng.randint(4, 40)))))
        labels.append((i, y))
    spark.createDataFrame([(i, t, "label", 7) for i, t in rows], "doc_id bigint, text string, stats string, score int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in op2_quality_classifier(spark, str(tmp_path)).collect()}
    stats = {i: Q.text_statistics(t) for i, t in rows}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnt = [(stats[i], y) for i, y in labels if y in (0, 1) and not held(i)]
    x, y = np.array([s for s, _ in learnt]), np.array([y for _, y in learnt], dtype=float)
    scale = np.sqrt(np.maximum((x**2).mean(axis=0) - x.mean(axis=0) ** 2, 1e-12))
    to = Q.fourier_map(x.mean(axis=0), np.where(scale < 1e-5, 1.0, scale))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    f = to(x)
    # Ridge as least squares over rows that are weighted, with rows that draw the solution to zero.
    solved = np.linalg.lstsq(np.vstack([f * np.sqrt(weight)[:, None], np.sqrt(Q.RIDGE) * np.eye(f.shape[1])]), np.concatenate([y * np.sqrt(weight), np.zeros(f.shape[1])]), rcond=None)[0]
    grid = np.linspace(-0.5, 1.5, Q.BINS + 1)
    at = np.clip(np.searchsorted(grid, f @ solved) - 1, 0, Q.BINS - 1)
    bins = sorted(set(at))
    mean = lambda a, b: np.mean(y[(at >= a) & (at <= b)])
    level = [max(min(mean(a, b) for b in bins if b >= k) for a in bins if a <= k) for k in bins]
    centre = [(grid[k] + grid[k + 1]) / 2 for k in bins]
    assert set(got) == set(stats)
    for i, s in stats.items():
        want = float(np.interp((to(np.array([s])) @ solved)[0], centre, level))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["held_out"] == held(i)


def test_pool_adjacent():
    assert Q.pool_adjacent(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == pytest.approx([0.1, 0.4, 0.4, 0.9])


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    f = Q.fourier_map(np.zeros(5), np.ones(5), features=4000, width=2.0)(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0**2))
    assert np.abs(f @ f.T - want).max() < 0.1


def test_held_out_language(spark):
    got = {r["doc_id"]: r for r in op7_language_id(spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_cases(spark):
    rows = [(1, "hello there my friend", "en"), (2, "guten tag mein freund", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", "fr"), (6, "zz", None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, lang string, lang_pred int")
    got = {r["doc_id"]: r for r in L.identify_languages(docs, L.train_languages(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"] and got[3]["score"] == 0.0
    assert sorted(r["doc_id"] for r in L.keep_known(docs, L.train_languages(docs)).collect()) == [1, 2, 6]
    none = L.train_languages(docs.where("false"))
    assert {r["lang_pred"] for r in L.identify_languages(docs, none).collect()} == {"und"}


def language_model(rows, texts):
    """Predictions by the definition: rates, log odds of the two sides of each bit, loss-weighted decoding."""
    grams = lambda t: [b for found in L.gram_buckets(t) for b in found.tolist()]
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    names = sorted(counts, key=lambda x: (-counts[x].total(), x))
    words = L.codewords(len(names)).astype(int)
    rate = lambda lang, b: 0.99 * counts[lang][b] / counts[lang].total() + 0.01 / L.BUCKETS
    side = lambda j, sign, b: np.mean([rate(x, b) for k, x in enumerate(names) if words[k, j] == sign])
    weight = lambda j, b: math.log(side(j, 1, b) / side(j, -1, b))
    bits = range(words.shape[1])
    margin = [[words[k, j] * sum(rate(x, b) * weight(j, b) for b in set().union(*counts.values())) for j in bits] for k, x in enumerate(names)]
    trust = [max(1e-3, min(row[j] for row in margin)) for j in bits]
    out = []
    for text in texts:
        if not any(map(str.isalpha, text or "")):
            out.append("und")
            continue
        found = Counter(grams(text))
        mean = [max(-4, min(4, sum(n * weight(j, b) for b, n in found.items()) / found.total())) for j in bits]
        loss = [sum(trust[j] * math.log1p(math.exp(-4 * words[k, j] * mean[j])) for j in bits) for k in range(len(names))]
        out.append(names[min(range(len(names)), key=lambda k: round(loss[k], 7))])
    return out


def test_languages_against_the_definition(spark, tmp_path):
    rng = random.Random(3)
    letters = {"aa": "abcde ", "bb": "cdefg ", "cc": "efghij ", "dd": "hijkla "}
    rows = [(i, "".join(rng.choice(letters[g]) for _ in range(rng.randint(5, 60))), g) for i, g in enumerate(rng.choices(list(letters), k=80))]
    rows += [(200, None, "aa"), (201, "²½①", "bb"), (202, "xyz XYZ", None), (203, "", "cc"), (204, "яж", None)]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_language_id(spark, str(tmp_path)).collect()}
    kept = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    assert [got[i]["lang_pred"] for i, _, _ in rows] == language_model(kept, [t for _, t, _ in rows])
    assert [got[i]["lang_pred"] for i in (200, 201, 203)] == ["und"] * 3


def test_many_languages_and_unseen_grams(spark):
    rows = [(f"common words {i} " * (3 if i == 7 else 1), f"l{i}") for i in range(300)]
    model = L.train_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 300 and model.languages[0] == "l7"
    two = L.train_languages(spark.createDataFrame([("aaaa bbbb " * 50, "often"), ("cccc", "rare")], "text string, lang string"))
    assert two.decode("ЯЖЯЖ")[0] == "often" and two.decode("ЯЖЯЖ")[2] and two.decode("cccc c")[0] == "rare"


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40, 600])
def test_codewords_are_apart(n):
    words = L.codewords(n).astype(int)
    apart = (words.shape[1] - words @ words.T) // 2
    assert (apart + np.eye(n) * 99).min() >= 1 and (np.abs(words.sum(axis=0)) < n).all()


def test_urls_against_brute_force(spark):
    rng = random.Random(6)
    labels = ["a", "b", "com", "net"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 3)))
    rules = [Rule(rng.choice(["allow", "block"]), host(), path()) for _ in range(40)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    urls = [None, "nothing", "http://", "HTTP://A.COM?x", "http://a.com#f/x"] + [f"https://{host()}{path()}?q" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    for r in judge_urls(df, rules).collect():
        rest = (urls[r["page_id"]] or "").partition("://")[2] if "://" in (urls[r["page_id"]] or "") else ""
        h = rest
        for c in "/?#":
            h = h.split(c)[0]
        p = rest[len(h) :].split("?")[0].split("#")[0]
        h = h.lower()
        fit = [x for x in rules if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)]
        best = max(fit, key=lambda x: (len(x.host), len(x.path)), default=None)
        assert (r["host"], r["path"]) == (h, p)
        assert (r["rule"], r["verdict"]) == ((best.host + best.path, best.verdict) if best else (None, "allow"))
    assert judge_urls(df.where("false"), rules).count() == 0 and {r["verdict"] for r in judge_urls(df, []).collect()} == {"allow"}


def random_hmm(k, c, seed):
    rng = np.random.default_rng(seed)
    part = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = rng.random((c, k))
    return M.Hmm(part(rng.random(k)), part(rng.random(k)), part(rng.random((k, k))), emit / emit.sum(axis=0))


def test_forward_is_exact_and_a_distribution():
    model, sizes = random_hmm(3, 4, 1), np.array([1, 9, 70, 33, 200])
    classes = np.random.default_rng(2).integers(0, 4, sizes.sum())
    got = M.forward_log10(model, classes, sizes)
    at = 0
    for n, s in zip(sizes, got, strict=True):
        a, log = None, 0.0
        for x in classes[at : at + n]:
            a = (model.start if a is None else a @ model.move) * model.emit[x]
            log, a = log + math.log10(a.sum()), a / a.sum()
        assert s == pytest.approx(log)
        at += n
    every = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    assert (10 ** M.forward_log10(model, every.ravel(), np.full(64, 3))).sum() == pytest.approx(1)


def test_baum_welch_counts_against_enumeration():
    model, words = random_hmm(2, 3, 3), np.array([0, 2, 1, 1])
    got = M.expected_counts(model, words, np.array([0]), np.array([4]), np.array([True]))
    weights = {}
    for path in np.ndindex(2, 2, 2, 2):
        p = model.start[path[0]] * model.emit[words[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[words[t], path[t]]
        weights[path] = p
    total = sum(weights.values())
    move = np.zeros((2, 2))
    for path, p in weights.items():
        for t in range(1, 4):
            move[path[t - 1], path[t]] += p / total
    assert got.move == pytest.approx(move) and got.emit.sum() == pytest.approx(4)


def test_base_scores_and_gain(spark):
    got = {r["doc_id"]: r for r in op5_lm_scoring(spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in M.tokens_of(r["text"]))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words, g = M.tokens_of(r["text"]), got[r["doc_id"]]
        assert g["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["held_out"]) == (len(words), sum(counts[w] > 0 for w in words), n, held(r["doc_id"]))
    out = [g for i, g in got.items() if held(i)]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)


def test_lm_without_training_and_with_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (2, "a " * 3000, 0)], "doc_id bigint, text string, score int")
    none = M.score_texts(docs, F.lit(False)).collect()
    assert len(none) == 4 and all(r["score"] == r["base_score"] and r["train_tokens"] == 0 for r in none)
    some = M.score_texts(docs, F.col("doc_id").isNotNull()).collect()
    assert sorted(r["n_tokens"] for r in some) == [1, 1, 3, 3001] and all(r["score"] < 0 for r in some)
    assert M.score_texts(docs.where("false"), F.lit(True)).count() == 0


def test_lm_tokens_of_odd_texts():
    import pyarrow as pa

    texts = [None, "", " ", " a\x0bB\x0cc \x1cd\x85e\xa0f\r\n", "ÀÉ x", "x\ty  z", "\n\nlast", "日本 語", "a" * 5000]
    for some in (pa.array(texts), pa.array(["skip me", *texts])[1:]):
        words, ids, sizes = M.coded(some)
        words = words.to_pylist()
        got = [[words[i] for i in x] for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [M.tokens_of(t) for t in texts]


def test_lm_scores_do_not_depend_on_the_partitions(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, two = ({r["doc_id"]: (r["base_score"], r["score"]) for r in M.score_texts(d, F.col("doc_id") % 7 != 0).collect()} for d in (docs.coalesce(1), docs.repartition(5)))
    assert set(one) == set(two) and all(one[k] == pytest.approx(two[k], abs=1e-5) for k in one)


def test_emissions_add_up_to_one():
    rng = np.random.default_rng(4)
    classes = np.array([0, 1, 2, 2, 2, 3, 3])
    counts = rng.integers(1, 9, 7).astype(float)
    expected = M.expected_of(counts, rng.integers(0, 255, (7, 8)).astype(np.uint8).view("<i8")[:, 0], 3)
    assert expected.sum(axis=1) == pytest.approx(counts)
    in_class, kinds = np.bincount(classes, weights=counts, minlength=5), np.bincount(classes, minlength=5)
    gathered = np.stack([np.bincount(classes, weights=expected[:, s], minlength=5) for s in range(3)], axis=1)
    gathered[3, 1] = 0.0
    room = in_class + 0.1 * np.where(np.arange(5) < 2, 1, kinds + 1)
    emit = rng.random((5, 3))
    of = M.Emissions(emit / emit.sum(axis=0), gathered, in_class, room, 2)
    known = of(classes, counts, np.where((classes == 3)[:, None] & (np.arange(3) == 1), 0.0, expected))
    unseen = of(np.arange(2, 5), np.zeros(3), np.zeros((3, 3)))
    assert known.sum(axis=0) + unseen.sum(axis=0) == pytest.approx(np.ones(3))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"word{i}x" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, common = text(30), "This line is common to very many documents, as notices are"
    rows = [(i, text(100) + f"\n{common}", "en") for i in range(8)]
    rows += [(20, rows[0][1].replace(common, ""), "en"), (21, "12 34", None), (22, None, "en"), (23, text(50) + " " + item + " " + text(20), "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(8)) and all(r["round_trip"] for r in got.values())
    assert [i for i in got if common in got[i]["text"]] == [7] and got[3]["n_chars"] == len(got[3]["text"])
    state = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        state = stage(spark, state.where("false"), str(tmp_path))
        assert state.count() == 0 and state.columns[:5] == docs.columns
