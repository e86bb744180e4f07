"""Operator 3: benchmark decontamination.

A benchmark item of n words is compared with windows of n words of every document. Words are split at ASCII white space,
A-Z in lower case, without punctuation at their ends; shingles are five words (an item of fewer: all its words).

1. Windows that share no shingle with an item have similarity zero with it; one lookup a word and a rolling hash find the
   places that share one, and with which items. Only these items and the windows around these places are looked at further.
2. There, every window of an item's size gets a 64-bit SimHash of its shingles with their counts, from prefix sums.
3. Multi-index Hamming search: 64 bits in 8 blocks; fingerprints within ``RADIUS`` 20 differ by at most 2 bits in some
   block, so every item within the radius is among those whose byte is within 2 bits of the window's in some block. At the
   threshold of 0.8 the expected distance is 10 bits with a deviation of 3, so 20 leaves out about 1 in 3000 by the binomial
   estimate; a test finds the same hits as with a radius of 64, which leaves out none, on the tables at hand.
4. Candidates are verified by the exact weighted Jaccard similarity of the shingle counts; the best window an item stays.

Scale: a projection over whole texts, no shuffle. Items go to the tasks in blocks of at most ``ITEM_BLOCK`` items and
``ITEM_CHARS`` characters (a bounded broadcast), one pass over the documents each. A window is compared with the items that
share a shingle near it, not with all.

Cases: null, empty or white-space texts and items match nothing. A document shorter than an item is one window. Repeated
items match each under its own id, also a null one; repeated documents keep their rows. Ties go to the earliest window. Very
long texts are searched whole, in slices. An empty benchmark or table gives no hits. Other columns pass unchanged in
``remove_contaminated``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh64_intdigest

from corvane.llm._shared import saved, text_batches

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
BLOCKS = 8
ITEM_BLOCK = 2000
ITEM_CHARS = 1 << 22
CACHE_ENTRIES = 300_000
_EDGE = b".,;:!?\"'()[]{}<>|*_-"
_SLICE = 1 << 14
_HITS = "array<struct<item_id:bigint,start_word:int,n_words:int,similarity:double,distance:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64()), ("distance", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def bare(word: bytes) -> bytes:
    return word.strip(_EDGE) or word


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over sum of the larger ones."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 of each of the 64 bits of each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


class SizeClass(NamedTuple):
    """Items of one number of words, and their multi-index."""

    words: int
    shingle: int
    ids: list[int | None]
    counts: list[Counter]
    prints: np.ndarray
    blocks: np.ndarray  # items x bytes of the prints


class ItemIndex:
    """What a task needs of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float, radius: int) -> None:
        self.threshold, self.radius = threshold, radius
        by_size: dict[int, list[tuple[int | None, list[bytes]]]] = {}
        for item, text in items:
            if words := [bare(w) for w in words_of(text)]:
                by_size.setdefault(len(words), []).append((item, words))
        names = sorted({w for some in by_size.values() for _, words in some for w in words})
        self.known = {w: k + 1 for k, w in enumerate(names)}
        self.cache: dict[bytes, int] = {}
        #: Values of a block within the bits that some block of a pair within the radius must not exceed.
        self.near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= radius // BLOCKS
        self.classes: list[SizeClass] = []
        keys: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for size, some in sorted(by_size.items()):
            shingle = min(SHINGLE, size)
            counts = [Counter(shingles_of(words, shingle)) for _, words in some]
            prints = np.array([int(_packed(sum(n * _signs(np.array([xxh64_intdigest(s)], dtype=np.uint64)) for s, n in c.items()))[0]) for c in counts], dtype=np.uint64)
            for k, (_, words) in enumerate(some):
                ids = np.array([self.known[w] for w in words], dtype=np.uint64)
                for h in self._rolled(ids, shingle).tolist():
                    keys.setdefault(shingle, {}).setdefault(h, set()).add((len(self.classes), k))
            self.classes.append(SizeClass(size, shingle, [i for i, _ in some], counts, prints, prints.astype("<u8").view(np.uint8).reshape(-1, 8)))
        self.keys = {s: (np.array(sorted(k), dtype=np.uint64), k) for s, k in keys.items()}

    @staticmethod
    def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of ``size`` word ids."""
        out = np.zeros(max(0, len(ids) - size + 1), dtype=np.uint64)
        for k in range(size):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ ids[k : k + len(out)]
            out ^= out >> np.uint64(29)
        return out

    def _ids(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        try:
            return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in set(words).difference(cache):
                cache[w] = self.known.get(bare(w), 0)
            return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))

    def hits(self, text: str | None) -> list[tuple[int | None, int, int, float, int]]:
        """(item, first word, words, similarity, distance) of the best window of each item that matches."""
        words = words_of(text)
        if not words or not self.classes:
            return []
        ids = self._ids(words)
        known = np.flatnonzero(ids)
        if not len(known):
            return []
        near: dict[int, dict[int, set[int]]] = {}  # class -> place -> items that share the shingle there
        for size, (hashes, holders) in self.keys.items():
            if len(ids) < size:
                continue
            run = known[: len(known) - size + 1] if len(known) >= size else known[:0]
            run = run[known[size - 1 :] - run == size - 1]  # places where ``size`` known words follow each other
            if not len(run):
                continue
            rolled = np.zeros(len(run), dtype=np.uint64)
            for k in range(size):
                rolled = (rolled * np.uint64(0x9E3779B97F4A7C15)) ^ ids[run + k]
                rolled ^= rolled >> np.uint64(29)
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            found = hashes[at] == rolled
            for place, h in zip(run[found].tolist(), rolled[found].tolist(), strict=True):
                for c, item in holders[h]:
                    near.setdefault(c, {}).setdefault(place, set()).add(item)
        if not near:
            return []
        clean = [bare(w) for w in words]
        out: list[tuple[int | None, int, int, float, int]] = []
        for c, places in near.items():
            out += self._search(self.classes[c], clean, places)
        return sorted(out, key=lambda h: (h[0] is None, h[0] or 0, *h[1:]))

    def _search(self, one: SizeClass, words: list[bytes], places: dict[int, set[int]]) -> list[tuple[int | None, int, int, float, int]]:
        span = one.words - one.shingle + 1  # shingles of a window
        last = max(0, len(words) - one.words)
        best: dict[int, tuple[float, int, int]] = {}
        # Runs of starts of all windows that hold a shared shingle, with the items that share one in the run.
        runs: list[tuple[int, int, set[int]]] = []
        for place, items in sorted(places.items()):
            begin, end = max(place - span + 1, 0), min(place, last)
            if runs and begin <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], max(end, runs[-1][1]), runs[-1][2] | items)
            else:
                runs.append((begin, end, set(items)))
        for begin, end, items in runs:
            some = np.array(sorted(items))
            step = max(256, _SLICE // len(some))
            for a in range(begin, end + 1, step):
                self._windows(one, words, a, min(end, a + step - 1), span, some, best)
        return [(one.ids[k], start, one.words, round(s, 12), d) for k, (s, start, d) in best.items()]

    def _windows(self, one: SizeClass, words: list[bytes], a: int, b: int, span: int, items: np.ndarray, best: dict[int, tuple[float, int, int]]) -> None:
        shingles = shingles_of(words[a : b + one.words], one.shingle)
        if not shingles:
            return
        sums = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
        np.cumsum(_signs(np.array([xxh64_intdigest(s) for s in shingles], dtype=np.uint64)), axis=0, out=sums[1:])
        width = min(span, len(shingles))
        prints = _packed(sums[width:] - sums[: len(sums) - width])
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        maybe = np.zeros((len(prints), len(items)), dtype=bool)
        for k in range(BLOCKS):
            maybe |= self.near[blocks[:, k][:, None], one.blocks[items, k][None, :]]
        at, nth = np.nonzero(maybe)
        distance = np.bitwise_count(prints[at] ^ one.prints[items[nth]])
        near = distance <= self.radius
        for w, k, d in sorted(zip(at[near].tolist(), items[nth[near]].tolist(), distance[near].tolist(), strict=True), key=lambda x: (x[2], x[0])):
            if k in best and best[k][0] >= 1.0 and best[k][1] <= a + w:
                continue
            s = weighted_similarity(Counter(shingles[w : w + width]), one.counts[k])
            if s >= self.threshold and (k not in best or (s, -(a + w)) > (best[k][0], -best[k][1])):
                best[k] = (s, a + w, d)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """Benchmark items in blocks of bounded size; an item needs a text, not an id."""
    held: list[tuple[int | None, str]] = []
    chars = 0
    for row in items.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL").toLocalIterator():
        held.append((row[0], row[1]))
        chars += len(row[1])
        if len(held) >= ITEM_BLOCK or chars >= ITEM_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def hits_column(block: list[tuple[int | None, str]], docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> Column:
    """The hits of one block of items in a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    text_batches(docs.sparkSession)

    @arrow_udf(_HITS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = ItemIndex(shared.value, threshold, radius)
        names = _HIT.value_type.names
        for batch in batches:
            yield pa.array([[dict(zip(names, h, strict=True)) for h in index.hits(t)] for t in batch.to_pylist()], _HIT)

    return search(F.col(f"`{text_col}`"))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, distance of each item found in each row."""
    found: DataFrame | None = None
    for block in item_blocks(items):
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(hits_column(block, docs, text_col, threshold, radius)).alias("hit")).select("doc_id", "hit.*")
        found = rows if found is None else saved(found, "hits").unionByName(rows)
    return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start_word int, n_words int, similarity double, distance int") if found is None else found


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    for k, block in enumerate(item_blocks(items)):
        docs = saved(docs, "clean") if k else docs
        docs = docs.where(F.size(hits_column(block, docs, text_col, threshold, radius)) == 0)
    return docs
