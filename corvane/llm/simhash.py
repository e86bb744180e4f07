"""Operator 8: near-duplicate documents by SimHash and bit-sliced comparison.

1. Fingerprints. A text's words (ASCII lower case, split at ASCII white space) give shingles; each is hashed with XXH64,
   and a fingerprint bit is set if it is set in over half the hashes, repeats included.
2. Distinct fingerprints. Copies meet in a map-side combined minimum, so a group of a third of all rows costs one row a
   task. From here on a fingerprint stands for all its documents.
3. Candidates. 64 bits fall into ``BLOCKS`` blocks; two fingerprints within the radius agree on at least
   ``BLOCKS - RADIUS`` of them, so each choice of that many blocks is a key under which such pairs meet: none is missed.
4. Comparison. Rows of a key come sorted to a task. Its fingerprints are kept as 64 vertical bit planes, 64 fingerprints
   a word; a query is compared with a word of 64 at a time: the differing bits of each plane are added into carry-save
   bit counters, and words whose 64 counters all exceed the radius are abandoned. A key with more than ``TILE``
   fingerprints is cut into tiles, and each pair of tiles is a key of its own, so no task holds an unbounded group.
5. Links. Links of a key are reduced to a spanning forest as they are found: at most one a fingerprint, whatever the size
   of the group, and with the same components. They go through ``connected_components``.

``near_components`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Wider
fingerprints only bring candidates together, far beyond the radius of 0.8; each link is then verified on the shingles.

Cases: a null, empty or white-space text has fingerprint zero, linked like any other; fewer words than a shingle make one
shingle of them all. Very long texts are hashed whole, in slices. Repeated rows keep their rows; a null id takes part
with its text but cannot be a component's name unless all ids of it are null. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh3_128_digest, xxh64_intdigest

from corvane.llm._shared import discard, saved, temporary_tables, text_batches
from corvane.llm.components import connected_components

RADIUS = 3
BLOCKS = 5
TILE = 1024
HOT_TILES = 8
SEED = 42
SHINGLE = 5
LANES = 8
WIDE_RADIUS = 140
THRESHOLD = 0.8
_SLICE = 1 << 15
_HELD_BYTES = 8 << 20


# --- fingerprints -----------------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, in slices; nothing for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= size:
        yield np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    for k in range(0, len(a), _SLICE):
        yield np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a[k : k + _SLICE], b[k : k + _SLICE], strict=True)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set over the rows of a (rows, lanes) array: bytes of a word count 255 rows at a time."""
    ones, cuts = np.uint64(0x0101010101010101), np.arange(0, len(hashes), 255)
    out = np.empty((hashes.shape[1], 8, 8), dtype=np.int64)  # lane, byte, bit
    for k in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(k)) & ones, cuts, axis=0)
        out[:, :, k] = packed.astype("<u8").view(np.uint8).reshape(len(cuts), -1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(-1)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        total += bit_counts(hashes[:, None])
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def lanes_of(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` independent hashes of each hash, by a 64-bit finaliser."""
    x = hashes[:, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    found = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> tuple[bytes, np.ndarray]:
    """A fingerprint of 64 bits a lane of a shingle set, and the least hash of each lane (zeros for an empty set)."""
    total, least = np.zeros(64 * lanes, dtype=np.int64), np.zeros(lanes, dtype=np.uint64)
    for k in range(0, len(hashes), _SLICE):
        wide = lanes_of(hashes[k : k + _SLICE], lanes)
        total += bit_counts(wide)
        low = wide.min(axis=0)
        least = np.minimum(least, low) if k else low
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), least


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least the threshold; empty sets are equal."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= threshold * (len(both) - common)


def fingerprint_column(text: Column, size: int = 3) -> Column:
    """The fingerprint as a signed ``bigint`` of the same bits; never null."""
    text_batches()

    @arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t, size) for t in batch.to_pylist()], dtype=np.uint64).view(np.int64))

    return of(text)


# --- bit-sliced comparison --------------------------------------------------------------------------------------------


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """One plane a bit of (n, lanes) fingerprints: lane k of word w in plane p is bit p of fingerprint 64 w + k."""
    words, lanes = -(-len(prints) // 64), prints.shape[1]
    padded = np.zeros((words * 64, lanes), dtype="<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.reshape(words, 64, 64 * lanes).transpose(2, 0, 1), axis=2, bitorder="little").copy().view("<u8")[:, :, 0]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in each lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(planes: np.ndarray, prints: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query fingerprint and a word of 64 lanes: the pairs that survive, and the lanes within the radius.

    Eight planes of differing bits go through a carry-save tree to a four-bit number in each lane, which is added to the
    lane's counter; a lane that outgrows its counter is marked and stays marked.
    """
    width = max(1, radius.bit_length())
    live = np.arange(len(query))
    counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(width)]
    over = np.zeros(len(query), dtype=np.uint64)
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    own, at = prints[query], word
    for p in range(0, len(planes), 8):
        mine = own[:, p // 64]
        d = [planes[q][at] ^ (np.uint64(0) - ((mine >> np.uint64(q % 64)) & np.uint64(1))) for q in range(p, p + 8)]
        s0, c0 = _add(d[0], d[1], d[2])
        s1, c1 = _add(d[3], d[4], d[5])
        s2, c2 = _add(d[6], d[7], s0)
        t0, e0 = _add(c0, c1, c2)
        c3 = s1 & s2
        e1 = t0 & c3
        number = [s1 ^ s2, t0 ^ c3, e0 ^ e1, e0 & e1]
        carry = None
        for k in range(width):
            if k < 4 and carry is None:
                counters[k], carry = counters[k] ^ number[k], counters[k] & number[k]
            elif k < 4:
                counters[k], carry = _add(counters[k], number[k], carry)
            else:
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        for k in range(width, 4):
            over = over | number[k]
        if p % 32 == 0:
            done = over | _above(counters, radius)
            keep = done != everything
            if not keep.all():
                live, over, own, at = live[keep], over[keep], own[keep], at[keep]
                counters = [c[keep] for c in counters]
            if not len(live):
                break
    return live, ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    more = np.zeros_like(counters[0])
    same = ~more
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more = more | (same & counters[k])
            same = same & ~counters[k]
    return more


class _Forest:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        rx, ry = self.root(x), self.root(y)
        if rx != ry:
            self.parent[max(rx, ry)] = min(rx, ry)
            self.links.append((x, y))


def link_forest(prints: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, large: int = 256, step: int = 1 << 15, sets: list[np.ndarray] | None = None, threshold: float = THRESHOLD) -> np.ndarray:
    """Spanning links (index pairs) of (n, lanes) fingerprints within the radius; rows are sorted by group.

    ``side`` 0: the group is compared within itself; 1 and 2: those of side 1 with those of side 2 only. In a large group
    a query skips the words all of whose lanes are in its component already: a link there would close a circle. With
    ``sets`` a pair within the radius is a link only if the sets are similar too.
    """
    n = len(prints)
    change = np.flatnonzero(group[1:] != group[:-1]) + 1
    begins, ends = np.concatenate(([0], change)), np.concatenate((change, [n]))
    sizes = ends - begins
    end_of = np.repeat(ends, sizes)
    index = np.arange(n)
    ask = (end_of - index > 1) & (side != 2)
    forest, planes = _Forest(n), None

    def compare(some: np.ndarray, label: np.ndarray | None = None) -> None:
        first, last = (some + 1) // 64, (end_of[some] - 1) // 64
        count = last - first + 1
        query = np.repeat(some, count)
        word = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        if label is not None:  # label: component of every row of the group, from its first row on
            offset, width = label
            low, high = width
            keep = (low[word - offset[1]] != high[word - offset[1]]) | (low[word - offset[1]] != offset[0][query - offset[2]])
            query, word = query[keep], word[keep]
        for at in range(0, len(query), step):
            q, w = query[at : at + step], word[at : at + step]
            live, hit = within(planes, prints, q, w, radius)
            live, hit = live[hit != 0], hit[hit != 0]
            if not len(live):
                continue
            row, lane = np.nonzero(np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            one, other = q[live[row]], w[live[row]] * 64 + lane
            ok = (other > one) & (other < end_of[one])
            one, other = one[ok], other[ok]
            ok = (side[one] == 0) | (side[other] == 2)
            for x, y in zip(one[ok].tolist(), other[ok].tolist(), strict=True):
                if sets is None or (forest.root(x) != forest.root(y) and similar(sets[x], sets[y], threshold)):
                    forest.join(x, y)

    if ask.any():
        planes = bit_planes(prints)
        compare(np.flatnonzero(ask & (np.repeat(sizes, sizes) <= large)))
        for begin, end in zip(begins[sizes > large].tolist(), ends[sizes > large].tolist(), strict=True):
            queries = begin + np.flatnonzero(ask[begin:end])
            first_word, starts = begin // 64, np.arange(-(-end // 64) - begin // 64) * 64 + begin // 64 * 64
            cuts = np.maximum(starts - begin, 0)
            for at in range(0, len(queries), 8):
                label = np.array([forest.root(x) for x in range(begin, end)])
                words = (np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts))
                compare(queries[at : at + 8], ((label, first_word, begin), words))
    return np.array(forest.links, dtype=np.int64).reshape(-1, 2)


def star_links(nodes: pa.Array, links: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The components of links (index pairs) as links to their least nodes: keys that hold the same group repeat them."""
    found = nodes.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    names, at = found.dictionary.take(order), place[found.indices.to_numpy()][links]
    forest = _Forest(len(names))
    for x, y in at.tolist():
        forest.join(x, y)
    some = np.unique(at)
    root = np.array([forest.root(x) for x in some.tolist()], dtype=np.int64)
    return names.take(pa.array(some[some != root])), names.take(pa.array(root[some != root]))


# --- the distributed plan ---------------------------------------------------------------------------------------------


def _cut_bits(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of the bits on which a pair must agree, one for each choice of ``agree`` of the blocks that ``bits`` are cut into."""
    cuts = [round(len(bits) * k / blocks) for k in range(blocks + 1)]
    masks = [sum(1 << b for b in bits[cuts[k] : cuts[k + 1]]) for k in range(blocks)]
    return [sum(masks[k] for k in some) for some in combinations(range(blocks), agree)]


def block_keys(blocks: int, radius: int) -> list[int]:
    """Masks of the keys: bits that a pair within the radius shares whole for one of them at least."""
    return _cut_bits(list(range(64)), blocks, blocks - radius)


def finer_keys(mask: int, radius: int) -> list[int]:
    """The same for pairs that agree on ``mask``: of twice ``radius`` blocks of the other bits, half are equal."""
    return [mask | more for more in _cut_bits([b for b in range(64) if not mask >> b & 1], 2 * radius, radius)] if radius else [(1 << 64) - 1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _gathered_keys(keyed: DataFrame, tile: int, finer: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows of every key of two rows or more, with their number ``n``. Keys of more than ``HOT_TILES`` tiles are replaced by
    what ``finer`` makes of their rows, one step after another, while it has any step left."""
    out: DataFrame | None = None
    for step in [*finer, None]:
        sizes = saved(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
        most = HOT_TILES * tile
        some = keyed.join(sizes if step is None else sizes.where(F.col("n") <= most), ["choice", "bits"])
        out = some if out is None else out.unionByName(some)
        heavy = sizes.where(F.col("n") > most)
        if step is None or heavy.isEmpty():
            return out
        keyed = step(keyed.join(heavy.drop("n"), ["choice", "bits"], "left_semi"))
    return out


def _keyed_links(keyed: DataFrame, radius: int, tile: int, threshold: float = THRESHOLD, finer: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """a, b: spanning links of rows (node, fp, choice, bits) that share a key (choice, bits).

    ``fp`` is a binary of little-endian words; without that column a node is its own 64-bit fingerprint. With a column
    ``shingles`` (sorted hashes as a binary) links are verified on it. Each step of ``finer`` maps rows of the same columns to
    finer keys under which no near pair of a key is lost.
    """
    wide, exact = "fp" in keyed.columns, "shingles" in keyed.columns
    kind = keyed.schema["node"].dataType.simpleString()
    met = _gathered_keys(keyed, tile, finer)
    met = met if wide else met.withColumn("fp", F.lit(None).cast("binary"))
    carried = ("node", "fp", "choice", "bits", *(["shingles"] if exact else []))
    placed = met.withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # Tiles i <= j of a key meet under (i, j): a row of tile t goes to each pair that has t.
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(F.col("tile"), o).alias("i"), F.greatest(F.col("tile"), o).alias("j")))
    side = F.when(F.col("pair.i") == F.col("pair.j"), 0).when(F.col("tile") == F.col("pair.i"), 1).otherwise(2)
    dealt = placed.select(*carried, "tile", F.explode(pairs).alias("pair")).select(*carried, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), side.alias("side"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j", "side")
    key_columns = ("choice", "bits", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            new = np.zeros(table.num_rows, dtype=bool)
            for c in key_columns:
                values = table.column(c).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            nodes = table.column("node").combine_chunks()
            raw = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype="<u8").reshape(len(nodes), -1) if wide else nodes.to_numpy().view(np.uint64)[:, None]
            sets = [np.frombuffer(x, dtype="<u8") for x in table.column("shingles").to_pylist()] if exact else None
            found = link_forest(raw, np.cumsum(new), table.column("side").to_numpy(), radius, sets=sets, threshold=threshold)
            a, b = star_links(nodes, found)
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        held: pa.Table | None = None  # rows of the last key so far: a tile pair at most, besides one batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < 1 << 13 and held.nbytes < _HELD_BYTES:
                continue
            same = np.ones(held.num_rows, dtype=bool)
            for c in key_columns:
                values = held.column(c).to_numpy()
                same &= values == values[-1]
            cut = held.num_rows - int(same.sum())
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    return ordered.mapInArrow(compare, f"a {kind}, b {kind}")


def _masked(masks: list[tuple[int, int]]):
    """An array of (choice, bits) of a fingerprint for (choice, mask) pairs."""
    return F.array(*(F.struct(F.lit(k).alias("choice"), F.col("node").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in masks))


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct 64-bit fingerprints (column ``fp``), enough to span each component."""
    masks = block_keys(blocks, radius)

    def split(hot: DataFrame) -> DataFrame:
        fine = [finer_keys(m, radius) for m in masks]
        each = len(fine[0])
        of = F.lit(None)
        for k, some in enumerate(fine):
            of = F.when(F.col("choice") == k, _masked([(len(masks) + each * k + j, m) for j, m in enumerate(some)])).otherwise(of)
        return hot.select("node", F.explode(of).alias("key")).select("node", "key.choice", "key.bits")

    keyed = prints.select(F.col("fp").alias("node")).select("node", F.explode(_masked(list(enumerate(masks)))).alias("key"))
    return _keyed_links(keyed.select("node", "key.choice", "key.bits"), radius, tile, finer=[split])


def _named(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node) with component_id; ``nodes`` has the least doc_id of each node."""
    parts = connected_components(links)
    named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(least, "component").select("node", "component_id")
    return rows.join(classes, "node")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, node (the fingerprint's signed bits) and component_id of every row."""
    ids, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = saved(docs.select(ids.alias("doc_id"), fingerprint_column(text, size).alias("node")), "prints")
    nodes = saved(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "distinct")
    links = fingerprint_links(nodes.select(F.col("node").alias("fp")), radius)
    return _named(rows, nodes, links).select("doc_id", "node", "component_id")


def _row_key(ids: Column, text: Column) -> Column:
    """By this a row is found again: rows that repeat both id and text are one."""
    return F.xxhash64(ids, ids.isNull(), text, text.isNull())


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, lanes: int = LANES, radius: int = WIDE_RADIUS, tile: int = TILE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row_key, node and component_id of every row, for texts whose shingle sets have a Jaccard similarity of 0.8 or more.

    1. Equal shingle sets are one node, named by 128 bits of their hash.
    2. Candidates share the least hash of a lane: a pair of similarity s shares a lane's with probability s, so all
       ``lanes`` miss it with (1 - s) ** lanes, 3 in a million at 0.8. Their fingerprints of 64 bits a lane are within
       the radius: similarity s leaves a share of acos(2 s / (1 + s)) / pi of the bits different, 77 of 512 at 0.8 with
       a deviation of 8, and 96 for the smallest sets (4 shingles of 5), so 140 is five deviations off at least. A least hash
       that very many texts share, as boilerplate does, is compared whole, in tiles like any other: finer keys of least hashes
       would lose pairs in large groups that small ones keep.
    3. Components of the candidates are coarse: no link leaves one. Only texts in one of several nodes meet again, under
       their coarse component, with their shingles; a pair within the radius is linked if its exact similarity says so. The
       work of a group is quadratic in its size, bounded in memory by the tiles, and its result does not depend on its size.
    """
    ids, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    text_batches(docs.sparkSession)

    @arrow_udf("struct<node:binary,fp:binary,keys:array<bigint>>")
    def wide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.to_pylist()]
            found = [wide_fingerprint(x, lanes) for x in sets]
            names = [xxh3_128_digest(x.tobytes(), SEED) for x in sets]
            keys = np.array([k for _, k in found], dtype=np.uint64).view(np.int64).reshape(-1)
            starts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * lanes)
            yield pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array([f for f, _ in found], pa.binary()), pa.ListArray.from_arrays(starts, pa.array(keys))], names=["node", "fp", "keys"])

    @arrow_udf("binary")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(t, size).tobytes() for t in batch.to_pylist()], pa.binary())

    row_key = _row_key(ids, text)
    rows = saved(docs.select(ids.alias("doc_id"), row_key.alias("row_key"), wide(text).alias("w")).select("doc_id", "row_key", "w.node", "w.fp", "w.keys"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first")
    # Rows of a node have one set, so one fingerprint and the same least hashes.
    nodes = saved(rows.groupBy("node").agg(first, F.min("fp").alias("fp"), F.min("keys").alias("keys")).select("node", "first.doc_id", "first.row_key", "fp", "keys"), "distinct")
    coarse = connected_components(_keyed_links(nodes.select("node", "fp", F.posexplode("keys").alias("choice", "bits")), radius, tile))
    asked = coarse.join(nodes, "node").select("node", "fp", "component", F.col("row_key").alias("asked_key"))
    texts = docs.select(row_key.alias("row_key"), text.alias("text"))
    met = texts.join(asked.hint("merge"), F.col("row_key") == F.col("asked_key")).dropDuplicates(["row_key"])
    keyed = saved(met.select("node", "fp", F.lit(0).alias("choice"), F.xxhash64("component").alias("bits"), shingles(F.col("text")).alias("shingles")), "shingles")
    links = _keyed_links(keyed, radius, tile, threshold)
    return _named(rows.select("doc_id", "row_key", "node"), nodes.select("node", "doc_id"), links).select("doc_id", "row_key", "node", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not the least of their group of ``near_components``.

    Repeated rows of the least id all stay; rows with a null id stay only if no row of their group has one. The decision
    travels as the keys (id and text) of the rows to drop and meets the texts in a merge join: other texts under the same id
    are judged by themselves. Columns may have any name.
    """
    with temporary_tables() as held:
        found = near_components(docs, id_col, text_col)
    found = saved(found, "groups")
    discard(*held)
    later = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row_key").alias("own_key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("own_key"))
    kept = rows.join(later.hint("merge"), "own_key", "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
