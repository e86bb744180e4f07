"""Operator 13 against a plain count, and its exact arithmetic."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import collocations as C


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pieces_of(text):
    found = (re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", lowered(text)))
    return [p for p in found if p]


def model(rows, least=10, longest=3, first=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            totals[lang or "und" if lang is None else lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[("und" if lang is None else lang, *words[i : i + size])] += 1
    candidates = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    inside = {}
    for (lang, *w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                key = (lang, *w[i : i + size])
                inside[key] = max(inside.get(key, 0), a)
    out = []
    for (lang, *w), a in candidates.items():
        if 100 * inside.get((lang, *w), 0) >= 50 * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, counts[(lang, *w[:k])], counts[(lang, *w[k:])], totals[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:first], 1)]
    return ranked


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "B", "über", "the", "of", "new", "york", "été", "x1", "A"]
    texts = [None, "", " \t ", "...", "new york city, new york city! NEW\tYork  City"]
    for _ in range(n):
        texts.append("".join(rng.choice([*words, "new york", "of the new"]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ". "]) for _ in range(rng.randint(1, 60))))
    texts += rng.choices(texts, k=20)
    return [(rng.choice(["en", "de", None, "und"]), t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é.\t ,\n\x0b!", max_size=25), min_size=1, max_size=5))
def test_pieces(texts):
    pieces, rows = C.split_pieces(pa.array(texts, pa.large_string()))
    assert list(zip(pieces.to_pylist(), rows.tolist(), strict=True)) == [(" ".join(p), k) for k, t in enumerate(texts) for p in pieces_of(t)]


@pytest.mark.parametrize(("block", "longest"), [(1 << 20, 3), (3, 3), (5, 4)])
def test_counts_of_a_block(monkeypatch, block, longest):
    monkeypatch.setattr(C, "BLOCK", block)
    pieces = ["a b a b a b", "a", "b a", "é é é é é", "a b a b a b"]
    weights = [3, 1, 4, 2, 5]
    want = Counter()
    for p, n in zip(pieces, weights, strict=True):
        w = p.split(" ")
        for size in range(1, longest + 1):
            for i in range(len(w) - size + 1):
                want[" ".join(w[i : i + size])] += n
    got, hashes = Counter(), {}
    for data, start, length, n, h in C.count_block(pa.array(pieces, pa.large_string()), C.np.array(weights), longest):
        for s, size, k, code in zip(start.tolist(), length.tolist(), n.tolist(), h.tolist(), strict=True):
            phrase = data[s : s + size].tobytes().decode()
            got[phrase] += k
            assert hashes.setdefault(phrase, code) == code
    assert got == want and len(set(hashes.values())) == len(hashes)


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n int, phrase string").repartition(3)


@pytest.mark.parametrize(("seed", "least", "longest", "coarse"), [(1, 10, 3, 1024), (2, 3, 3, 1024), (3, 4, 4, 2), (4, 2, 2, 3)])
def test_equals_the_plain_count(spark, monkeypatch, seed, least, longest, coarse):
    monkeypatch.setattr(C, "COARSE", coarse)
    rows = corpus(seed)
    got = C.collocations(frame(spark, rows), least=least, longest=longest)
    assert sorted(map(tuple, got.collect())) == [(lang, k, p, a, l, r, n, s) for lang, k, p, a, l, r, n, s in model(rows, least, longest)]


def test_first_rows_and_nothing(spark, monkeypatch):
    rows = corpus(5)
    want = model(rows, 2, 3, 7)
    assert sorted(map(tuple, C.collocations(frame(spark, rows), least=2, first=7).collect())) == want and len(want) >= 21
    assert C.collocations(frame(spark, rows).where("false")).count() == 0
    assert C.collocations(frame(spark, [("en", "rare words only")])).count() == 0


def test_a_text_without_marks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choice(["p", "q", "r", "st"]) for _ in range(30_000)))] + [("en", "p q")] * 300
    monkeypatch.setattr(C, "SLICE", 1000)
    assert sorted(map(tuple, C.collocations(frame(spark, rows)).collect())) == model(rows)


def test_scores_are_exact(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.randint(10, 10 ** rng.randint(2, 14))
        rows.append((a, a + rng.randint(0, 10 ** rng.randint(0, 14)), a + rng.choice([0, 1, rng.randint(0, 10**14)])))
    rows += [(10**15 - 1, 10**15 - 1, 10**15 - 1), (10**14, 10**14 + 1, 10**14)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C.floor_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(g["s"] == 1_000_000 * g["a"] ** 2 // (g["l"] * g["r"]) for g in got) and len(got) == len(rows)
