"""Operator 12: the prefix trie of conversations, one row a node, by smallest-member ownership.

A node is a distinct sequence of first turns; its owner is the smallest conversation among its members. Who owns a node owns
every deeper node of its own path, so each conversation owns one suffix of its path (or nothing), and two numbers a
conversation say which: the depth from which it owns, and the words before that depth. They give all sums over subtrees:

* Tokens. Over a subtree, the sum of (members - 1) x words is the words of all occurrences less the words of each node once,
  by its owner. A member thus adds the words of its path from the node on less those that it owns there.
* Leaves. Each childless node has one owner, whose path ends in it; a member that is one is a leaf below the node.

Plan: (1) turns are sorted over the cluster by conversation and turn, which gives ordinals by counts of sorted pieces; (2)
windows over these pieces, and piece totals, give each turn the hash of its prefix and the words up to it; (3) one group-by
of prefixes finds owners, a second by owner the owned suffixes; (4) one more group-by of prefixes adds up what the members
bring, together with counts of children and the digests of ends.

The owners come from a group-by and not from a window over a node's members, because the root and common first turns hold
any share of all rows: minima are taken before rows move. No conversation is worked off by one task either, however many
turns it has. The ids that end in one node are joined to text in sorted pieces and hashed as a stream in order, so the list
is never held. Turns and prefixes are told apart by 128 bits of hashes (the xor of a hash of each turn and its depth).

Cases: null ids are left out, since they name no conversation. Turns of equal number are ordered by role and text, and
repeated rows are turns of their own. Null role and text count as empty, null turn numbers come first. Other columns are not
read, so their names don't matter. A conversation may lose all turns in the rebuilding; it is then a member of the root
alone. An empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._shared import discard, saved, text_batches

#: Fixed values of the contract: conversations share the start of the one at the last multiple of STRIDE, up to HEAD - 1 turns.
STRIDE, HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "p1", "p2"]
BLOB = 1 << 20


def head_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def base_of(conv: Column) -> Column:
    return conv - conv % STRIDE


def sorted_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """piece, conv, seq, a1, a2 (hash of role and text), words: turns in the order of ``seq`` within a conversation."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    # The last column spreads equal rows of one conversation, whose order makes no difference.
    turns = turns.where("conv IS NOT NULL").withColumn("spread", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "text", "spread"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("seq"), "conv", F.xxhash64("role", "text").alias("a1"), F.xxhash64(F.lit("second"), "text", "role").alias("a2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    # The ids rise within a partition, and their upper bits are its number; the table fixes both.
    return saved(placed.select(F.shiftright("seq", 33).alias("piece"), "conv", "seq", "a1", "a2", "words"), "turns")


def _earlier(*aggregates: tuple[Column, str]) -> list[Column]:
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(a.over(before), F.lit(0).cast("long")).alias(name) for a, name in aggregates]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(piece, conv, depth, f1, f2, words of every turn of the rebuilt conversations; conv, len of every conversation)."""
    pieces = turns.groupBy("conv", "piece").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    pieces = saved(pieces.select("conv", "piece", "first", "n", *_earlier((F.sum("n"), "before"))), "pieces")
    sizes = pieces.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("base", base_of(F.col("conv"))).withColumn("h", head_turns(F.col("conv")))
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.join(of_base, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"), "n")
    convs = saved(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    known = pieces.join(convs.select("conv", "h", "taken"), "conv")
    at = turns.join(known.hint("merge"), ["conv", "piece"]).withColumn("ord", F.col("seq") - F.col("first") + F.col("before") + 1)
    own = at.where("ord > h").select("piece", "conv", (F.col("taken") + F.col("ord") - F.col("h")).alias("depth"), "a1", "a2", "words")
    # A base has the heads of at most 2 x STRIDE conversations, of HEAD - 1 turns each.
    heads = at.where(F.col("ord") < HEAD).where(F.col("conv") % STRIDE == 0).select(F.col("conv").alias("base"), F.col("ord").alias("depth"), "a1", "a2", "words")
    heads = heads.join(convs.select("conv", "base", "h"), "base").where("depth <= h").select(F.lit(-1).cast("long").alias("piece"), "conv", "depth", "a1", "a2", "words")
    every = own.unionByName(heads)
    out = every.select("piece", "conv", "depth", F.xxhash64(F.lit(1), "depth", "a1", "a2").alias("f1"), F.xxhash64(F.lit(2), "depth", "a2", "a1").alias("f2"), "words")
    return out, convs.select("conv", "len")


def occurrences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, p1, p2 (node), q1, q2 (its parent), words, upto (words down to here), last: each node of each path, root included."""
    by = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = saved(turns.select("*", F.bit_xor("f1").over(by).alias("x1"), F.bit_xor("f2").over(by).alias("x2"), F.sum("words").over(by).alias("w")), "local-prefixes")
    totals = local.groupBy("conv", "piece").agg(F.bit_xor("f1").alias("t1"), F.bit_xor("f2").alias("t2"), F.sum("words").alias("tw"))
    totals = totals.select("conv", "piece", *_earlier((F.bit_xor("t1"), "b1"), (F.bit_xor("t2"), "b2"), (F.sum("tw"), "bw")))
    totals = totals.join(convs, "conv")
    whole = local.join(totals.hint("merge"), ["conv", "piece"]).withColumn("p1", F.col("x1").bitwiseXOR(F.col("b1"))).withColumn("p2", F.col("x2").bitwiseXOR(F.col("b2")))
    below = whole.select(
        "conv", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("f1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("f2")).alias("q2"),
        "words", (F.col("w") + F.col("bw")).alias("upto"), (F.col("depth") == F.col("len")).alias("last"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("words"), zero.alias("upto"), (F.col("len") == 0).alias("last"))
    out = saved(below.unionByName(root), "occurrences")
    discard(local)
    return out


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, p1, p2, first, ids: sorted rows (depth, p1, p2, conv) as comma-joined text, in pieces of about ``BLOB`` bytes."""
    key, first, held, size = None, 0, [], 0
    out: list[tuple] = []
    waiting = 0
    for batch in batches:
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != key or size >= BLOB:
                if held:
                    out.append((*key, first, ",".join(held)))
                    waiting += size
                key, first, held, size = node, conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if waiting >= BLOB or len(out) >= 10_000:
            yield _blobs(out)
            out, waiting = [], 0
    if held:
        out.append((*key, first, ",".join(held)))
    if out:
        yield _blobs(out)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, p1, p2, digest of sorted pieces of ids; only one node's digest is open at a time."""
    key, running = None, hashlib.sha256()
    out: list[tuple] = []

    def done() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "digest"])

    for batch in batches:
        for *node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if node != key:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if len(out) >= 10_000:
            yield done()
    if key is not None:
        out.append((*key, running.hexdigest()))
    if out:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, p1, p2, digest: of the ids of ``ends`` (depth, p1, p2, conv) in numerical order, for each node."""
    text_batches(ends.sparkSession, rows=10_000)
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv"]
    blobs = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "depth long, p1 long, p2 long, first long, ids string")
    return blobs.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, p1 long, p2 long, digest string")


def prefix_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    turns = sorted_turns(rows, conv_col, turn_col, role_col, text_col)
    paths, convs = rebuilt(turns)
    occ = occurrences(paths, convs)
    discard(turns)
    nodes = occ.groupBy(*KEY).agg(
        F.min("conv").alias("owner"), F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("ended"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max(F.col("upto") - F.col("words")).alias("above"),
    )
    nodes = saved(nodes, "nodes")
    first = F.min_by(F.struct("q1", "q2", "above"), "depth")
    owned = nodes.groupBy("owner").agg(F.min("depth").alias("own"), first.alias("top"), F.max((F.col("ended") == F.col("n")).cast("long")).alias("leaf"))
    owned = owned.select(F.col("owner").alias("conv"), "own", "leaf", "top.above", (F.col("own") - 1).alias("depth"), F.col("top.q1").alias("p1"), F.col("top.q2").alias("p2"))
    # One lookup a conversation; those of a common parent are many, and adaptive execution splits them.
    parent = nodes.select(*KEY, F.col("owner").alias("parent_conv_id"))
    owned = owned.join(parent.hint("merge"), KEY, "left").select("conv", "own", "leaf", "above", "parent_conv_id")
    whole = occ.where("last").select("conv", F.col("upto").alias("whole"))
    share = whole.join(owned, "conv", "left").select("conv", "own", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("above", "whole").alias("shared"), "parent_conv_id")
    share = saved(share, "owned-suffixes")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    members = occ.join(share.hint("merge"), "conv").select(
        *KEY, "conv", F.lit(1).cast("long").alias("n"), "leaf", F.greatest(F.col("shared") - (F.col("upto") - F.col("words")), zero).alias("tokens"),
        F.when(F.col("depth") > F.col("own"), F.col("conv")).when(F.col("depth") == F.col("own"), F.col("parent_conv_id")).alias("parent"), zero.alias("child"), F.lit(None).cast("string").alias("digest"),
    )
    children = nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), none.alias("conv"), zero.alias("n"), zero.alias("leaf"), zero.alias("tokens"), none.alias("parent"), F.lit(1).cast("long").alias("child"), F.lit(None).cast("string").alias("digest"),
    )
    ends = end_digests(occ.where("last")).select(*KEY, none.alias("conv"), zero.alias("n"), zero.alias("leaf"), zero.alias("tokens"), none.alias("parent"), zero.alias("child"), "digest")
    out = members.unionByName(children).unionByName(ends).groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum("tokens").alias("saved_tokens"), F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
