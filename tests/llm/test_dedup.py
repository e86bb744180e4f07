"""Operators 3, 4, 8 and 10 and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from corvane.llm import decontam as D
from corvane.llm import simhash as S
from corvane.llm.components import connected_components
from corvane.llm.linededup import LineRuns, drop_lines
from corvane.llm.topk import top_k


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "h", 0) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")


# --- line dedup


LONG = ["The quick brown fox jumps over the lazy dog again", "pack my box with five dozen liquor jugs, said she", "É" * 45]


def line_case(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        lines = [rng.choice([*LONG, LONG[0].upper(), "  " + LONG[1] + "\t", "short", "", f"a line of its own that is long enough, {i}"]) for _ in range(rng.randint(1, 6))]
        rows.append((rng.choice([i, i, 7, None]), "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, LONG[0] + "\n" + LONG[0])]


def line_model(rows):
    def key(line):
        line = re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k for k, line in enumerate(lines) if len(held[key(line)]) >= 5 and i != max((x for x in held[key(line)] if x is not None), default=None)]
        kept = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_model(spark, seed):
    rows = line_case(seed)
    got = drop_lines(docs(spark, rows)).select("doc_id", "line_dedup.*", "text").collect()
    assert sorted([(r[0], r[1], r[2], r[3] or "") for r in got], key=str) == line_model(rows)


def test_lines_keep_other_columns_and_empty_tables(spark):
    empty = drop_lines(docs(spark, [(1, "x")]).where("false"))
    assert empty.count() == 0 and {"fp", "component_id"} <= set(empty.columns)


def test_runs_compact_and_keep_the_first_batch(spark):
    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(100 - 10 * k - j, 1, 1 if j else k) for j in range(3)], "doc bigint, h1 bigint, h2 bigint"))
    assert len(runs.levels) > 1 and all(len(level) < 2 for level in runs.levels)
    got = {r["h2"]: r["top"] for r in runs.keepers().collect()}
    assert got == {0: 100, 1: 99, 2: 80, 3: 70, 4: 60}
    runs.release()


def test_the_anti_join_decides_which_line_stays(spark, monkeypatch):
    rows = line_case(1)
    monkeypatch.setattr(LineRuns, "runs", lambda self: [])
    got = drop_lines(docs(spark, rows)).select("doc_id", "line_dedup.*", "text").collect()
    assert sorted([(r[0], r[1], r[2], r[3] or "") for r in got], key=str) != line_model(rows)


def test_a_hash_that_holds_most_lines(spark):
    rows = [(i, "\n".join([LONG[0]] * (500 if i == 3 else 1) + [LONG[1]] * (i < 3) + ["own line number that is long enough %d" % i])) for i in range(30)]
    rows += [(40, "\n".join([LONG[2]] * 900))]
    got = drop_lines(docs(spark, rows)).select("doc_id", "line_dedup.*", "text").collect()
    assert sorted([(r[0], r[1], r[2], r[3] or "") for r in got], key=str) == line_model(rows)


def test_a_very_long_text_of_lines(spark):
    rows = [(i, "\n".join([*LONG[:2], *(f"a line that only document {i} holds, {k}" for k in range(20_000 if i == 2 else 3))])) for i in range(6)]
    got = drop_lines(docs(spark, rows)).select("doc_id", "line_dedup.*", "text").collect()
    assert sorted([(r[0], r[1], r[2], r[3] or "") for r in got], key=str) == line_model(rows)


# --- SimHash


def reference_print(text, size=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c", "ÉÄ b c d", "x " * 400, "w" * 9000])
def test_fingerprint_contract(text):
    assert S.fingerprint(text) == reference_print(text)


@pytest.mark.parametrize(("lanes", "radius", "flips", "n"), [(1, 3, 2, 50), (1, 3, 2, 400), (2, 12, 6, 150)])
def test_bit_sliced_links_against_brute_force(lanes, radius, flips, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, (n, lanes), dtype=np.uint64)
    near = base.copy()
    for row in near:
        for b in rng.integers(0, 64 * lanes, flips):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    prints = np.concatenate([base, near])[rng.permutation(2 * n)]
    for group in (np.zeros(2 * n, dtype=int), np.sort(rng.integers(0, 9, 2 * n))):
        close = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1) <= radius) & (group[:, None] == group[None])
        want = components(2 * n, [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j])
        links = S.link_forest(prints, group, np.zeros(2 * n, dtype=int), radius)
        assert components(2 * n, links.tolist()) == want and len(links) == 2 * n - len(set(want))


def test_components_of_documents_and_small_tiles(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:20]] + [(200, None), (201, ""), (202, "  "), (None, rows[0][1])]
    rows += [(300 + i, f"{rows[1][1]} tail{i}") for i in range(40)]
    got = S.simhash_components(docs(spark, rows)).collect()
    prints = sorted({reference_print(t) for _, t in rows})
    of = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    label = {p: of[k] for k, p in enumerate(prints)}
    least = {}
    for i, t in rows:
        if i is not None:
            c = label[reference_print(t)]
            least[c] = min(least.get(c, i), i)
    want = sorted([(i, least[label[reference_print(t)]]) for i, t in rows], key=str)
    assert sorted([(r["doc_id"], r["component_id"]) for r in got], key=str) == want
    tiny = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    links = S.fingerprint_links(tiny, tile=3).collect()
    index = {p - (1 << 64) if p >> 63 else p: k for k, p in enumerate(prints)}
    assert components(len(prints), [(index[r["a"]], index[r["b"]]) for r in links]) == of
    assert S.simhash_components(docs(spark, rows).where("false")).count() == 0


def test_a_hot_key_is_split_by_finer_bits(spark):
    rng = np.random.default_rng(6)
    low = int(rng.integers(0, 2**26))
    base = [int(x) << 26 | low for x in rng.integers(0, 2**38, 150)]  # all agree on the first two of five blocks
    prints = list({p ^ sum(1 << int(b) for b in rng.choice(np.arange(26, 64), k, replace=False)) for p in base for k in (0, 2, 3)})
    of = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    index = {p: k for k, p in enumerate(signed)}
    links = S.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), tile=8).collect()
    assert components(len(prints), [(index[r["a"]], index[r["b"]]) for r in links]) == of


def test_finer_keys_miss_no_pair():
    rng = random.Random(2)
    for mask in S.block_keys(S.BLOCKS, S.RADIUS):
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(200):
            apart = sum(1 << b for b in rng.sample(free, 3))
            assert any(not apart & fine for fine in S.finer_keys(mask, S.RADIUS))


def test_boilerplate_that_all_texts_share(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    common = [rng.choice(words) for _ in range(90)]
    rows = [(i, " ".join(common + [rng.choice(words) for _ in range(rng.randint(2, 30))])) for i in range(90)]
    got = S.near_components(docs(spark, rows), tile=2).collect()
    assert sorted({r["component_id"] for r in got}) == near_model(rows)


@pytest.mark.parametrize("lanes", [1, 2])
def test_large_keys_lose_no_pair(spark, lanes):
    """Texts of a key of more than ``HOT_TILES`` tiles were once compared only if a second lane agreed too."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        text = base.copy()
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    names = lambda tile: {r["doc_id"]: r["component_id"] for r in S.near_components(docs(spark, rows), lanes=lanes, tile=tile).collect()}
    assert names(2) == names(1024)


def test_keeping_groups_with_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(2, text, 1, 2, 3), (1, text, 4, 5, 6), (3, None, 7, 8, 9)], "doc_id bigint, text string, __gone int, own_key int, row int")
    kept = S.keep_first_of_groups(rows)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == [(1, text, 4, 5, 6), (3, None, 7, 8, 9)]
    assert S.keep_first_of_groups(rows.where("false")).count() == 0


def test_near_groups_at_five_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    near = base.copy()
    near[100] = near[300] = "edited"
    half = base[:200] + [rng.choice(words) for _ in range(200)]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (7, " ".join(half)), (8, " ".join(base)), (9, None), (1, "")]
    kept = S.keep_first_of_groups(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7] and "fp" in kept.columns


def near_model(rows):
    """The least id of each group of exact five-word Jaccard similarity 0.8 or more, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    close = [(i, j) for i in range(len(rows)) for j in range(i) if (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    of = components(len(rows), close)
    return sorted(min(i for (i, _), c in zip(rows, of, strict=True) if c == k) for k in set(of))


@pytest.mark.parametrize("tile", [4096, 5])
def test_near_groups_on_both_sides_of_the_threshold(spark, tile):
    rng = random.Random(11)
    words, rows = [f"w{i}" for i in range(5000)], []
    for k, share in enumerate([0.70, 0.75, 0.78, 0.79, 0.80, 0.81, 0.82, 0.84] * 6):
        n = [400, 60][k % 2]
        base = [rng.choice(words) for _ in range(n + 4)]
        common = round(n * 2 * share / (1 + share))  # shingles that a new tail leaves
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: common + 4] + [rng.choice(words) for _ in range(n - common)]))]
    chain = [rng.choice(words) for _ in range(304)]
    rows += [(200 + k, " ".join(chain[10 * k : 10 * k + 154])) for k in range(12)]  # each near to the next, not to all
    rows += [(300, "a b c d e f g h"), (301, "a b c d e f g h i"), (302, "a b c d e f g"), (303, "x x x x x x x x x x x y"), (304, "x x x x x")]
    got = S.near_components(docs(spark, rows), tile=tile)
    assert sorted({r["component_id"] for r in got.collect()}) == near_model(rows)


def test_a_repeated_id_is_judged_by_its_text(spark):
    one, two = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    rows = [(3, one), (5, one), (5, two), (7, two)]
    kept = S.keep_first_of_groups(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, one), (5, two)]


def test_connected_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(50)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + k: 100 for k in range(50)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- decontamination


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 3, 5, 12, 30, 30, 55])]
    items += [(20, None), (21, "  "), (22, items[4][1])]
    rows = [(200, None), (201, "")]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 2:
            passage = (rng.choice(items[3:7])[1]).split()
            for _ in range(rng.choice([0, 0, 1])):
                passage[rng.randrange(len(passage))] = "changed"
            text[10:10] = passage
        rows.append((i, " ".join(text).upper() if i % 3 else " ".join(text) + "."))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for item, passage in items:
        w = [D.bare(x) for x in D.words_of(passage)]
        if not w:
            continue
        k = min(5, len(w))
        counts = Counter(D.shingles_of(w, k))
        for i, text in rows:
            sh = D.shingles_of([D.bare(x) for x in D.words_of(text)], k)
            n = len(w) - k + 1
            best = max((D.weighted_similarity(Counter(sh[a : a + n]), counts) for a in range(max(1, len(sh) - n + 1))), default=0)
            if best >= 0.8:
                want[i, item] = round(best, 12)
    assert want and set(want) == set(got) and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_the_query_finds_what_a_search_without_radius_finds(spark):
    from corvane.llm.q_decontam import op3_benchmark_decontamination

    path = "/root/testdata/sf0.01"
    got = sorted(map(tuple, op3_benchmark_decontamination(spark, path).collect()))
    texts, items = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got and got == sorted(map(tuple, D.find_contamination(texts, items, radius=64).collect()))


def test_a_very_long_text_of_near_windows(spark):
    passage = [f"w{i % 37}" for i in range(40)]
    text = " ".join((passage + ["gap"]) * 700)
    items = spark.createDataFrame([(k, " ".join(passage[k:] + passage[:k])) for k in range(6)], "item_id bigint, text string")
    found = D.find_contamination(docs(spark, [(1, text), (2, "w1 w2 w3")]), items).collect()
    assert {r["doc_id"] for r in found} == {1} and any(r["item_id"] == 0 and r["start_word"] == 0 and r["similarity"] == 1.0 for r in found)


def test_clean_rows_stay(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    rows = docs(spark, [(1, "x one two three four five six seven eight nine ten y"), (2, "one two three four five only"), (3, None)])
    assert sorted(r["doc_id"] for r in D.remove_contaminated(rows, items).collect()) == [2, 3]
    assert D.remove_contaminated(rows, items.where("false")).count() == 3


def test_items_without_an_id_count(spark):
    passages = ["one two three four five six seven eight nine ten", "a b c d e f g h i j"]
    items = spark.createDataFrame([(None, passages[0]), (None, passages[1]), (4, passages[1]), (5, None)], "item_id bigint, text string")
    rows = docs(spark, [(1, f"x {passages[0]} y"), (2, f"{passages[1]} z"), (3, "clean")])
    assert [r["doc_id"] for r in D.remove_contaminated(rows, items).collect()] == [3]
    found = sorted(((r["doc_id"], r["item_id"]) for r in D.find_contamination(rows, items).collect()), key=str)
    assert found == [(1, None), (2, 4), (2, None)]


# --- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    x[50:90] = x[49]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [None] * 20), (402, [float("nan")] * 20), (403, [1e300] * 20), (404, []), (405, x[0].tolist()[:5]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df.where("vec_id < 403 or vec_id > 404"), df.where("vec_id % 25 = 0 and vec_id < 300")).collect()}
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for i in range(0, 300, 25):
        order = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(order)}
    assert got == want
    assert top_k(df.where("false"), df.where("false")).count() == 0


def test_scores_beyond_a_bigint_and_many_blocks(spark, monkeypatch):
    from corvane.llm import topk

    rng = np.random.default_rng(3)
    values = [[1e7, -1e9, 3.5], [1e9, 1e9, 1e9], [2e9, 1e9, 1e9], [1e300, 0.0, 1.0], [-1e300, 1.0, 0.0], [1e308, 0.0, 0.0], [0.1, 0.2, 0.3], [5.0, 5.0]]
    rows = [(i, v) for i, v in enumerate(values)] + [(20 + i, rng.normal(size=3).tolist()) for i in range(40)] + [(20, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    got = top_k(df, df, k=4).collect()
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if all(math.isfinite(256 * x) for x in v)]
    want = []
    for i, q in fine:
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in fine if j != i and len(c) == len(q))
        want += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(scored[:4])]
    assert sorted(map(tuple, got)) == sorted(want) and {r["query_id"] for r in got}.isdisjoint({5, 7})


def test_queries_match_their_sql(spark):
    from corvane.llm import registry

    path, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, path)
        result = con.sql(sql)
        places = [result.columns.index(c) for c in df.columns]
        want = sorted([tuple(r[p] for p in places) for r in result.fetchall()], key=str)
        assert sorted(map(tuple, df.collect()), key=str) == want, name
