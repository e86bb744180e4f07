"""Operator 12 against a plain model that builds every node."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from corvane.llm import trie
from corvane.llm.trie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, p1 int"


def model(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c in turns:
        own = [x[2:] for x in sorted(turns[c])]
        base = [x[2:] for x in sorted(turns.get(c - (abs(c) % 20) * (1 if c > 0 else -1), []))]
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(base[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in members)]
        tokens = sum((len(members[m]) - 1) * len(re.findall(r"[^ \t-\r]+", m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), tokens, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=60, most=6):
    rng = random.Random(seed)
    texts = [None, "", "hi", "hi  there\tyou", "tell me more", " a b c \n"]
    rows = []
    for c in rng.sample([*range(-25, 0), *range(n)], n):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += rng.choices(rows, k=10) + [(None, 1, "user", "left out")]
    copy = [r for r in rows if r[0] == rows[0][0]]
    return rows + [(k, *r[1:]) for k in (1000, 1001, 1020, 1040) for r in copy]


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie(frame).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_model(spark, seed):
    rows = conversations(seed)
    assert found(spark, rows) == model(rows)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOB", 40)  # so that the ids of one node come in several pieces
    long = [(5, t // 2, "user", f"turn {t % 7}") for t in range(700)]
    many = [(20 * k, t, "user", "the same") for k in range(1, 120) for t in range(2)]
    rows = long + many + [(2000, 0, "system", "other")]
    got = found(spark, rows)
    assert got == model(rows) and max(r[1] for r in got) > 600


def test_turnless_conversations_are_members_of_the_root(spark):
    alone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3][0]  # three turns come from a base that is absent
    rows = [(alone, 0, "user", "mine")]
    assert found(spark, rows) == model(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_no_conversation_gives_no_node(spark):
    assert found(spark, [(None, 0, "user", "x")]) == []


def test_every_piece_of_a_split_conversation_is_joined(spark):
    """With one row a partition, ordinals and prefixes come from piece totals alone."""
    rows = [(40, t, "user", f"{t}") for t in range(40)] + [(41, t, "user", f"{t}") for t in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert found(spark, rows) == model(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
