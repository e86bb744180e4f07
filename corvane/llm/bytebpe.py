"""Operator 11: byte-level BPE by a rank file, with a two-tier lookup.

Tier one: a minimal perfect hash (``mph``) finds the distinct pre-tokens of a block in the vocabulary, all at once, and each
is compared with the key of its slot. Tier two: what is not in the vocabulary starts as a linked list of bytes; a heap holds
the neighbours whose joined bytes have a rank, by (rank, place); entries whose parts have changed since are skipped. So a
pre-token of n bytes costs O(n log n). Decoding takes the bytes of all ids of a batch at once.

Ids are those of the tiktoken library for the same ranks and pattern, without special tokens: a special token's string is
ordinary text.

Scale: both are projections (no shuffle). Each Python worker reads the rank file (a few MB, fixed) from ``path``, which must
exist on every node. Texts are worked off in blocks of ``BLOCK`` pre-tokens, a very long text in several; merged pre-tokens
are kept in a table of bounded size, which changes speed only.

Cases: a null or empty text gives an empty id list, a null or empty id list no bytes. Other columns and repeated rows pass
unchanged, since a result depends on its own row only. Ids that are null or outside the vocabulary add nothing. The decoded
column is binary, since an id list can be cut inside a character. A rank file without all 256 bytes, with a repeated key or
a repeated rank is an error.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.llm._shared import text_batches
from corvane.llm.bpe import PATTERN, PATTERN_LATIN
from corvane.llm.mph import PerfectHash

BLOCK = 200_000
LONG_TEXT = 1 << 20
CACHE_ENTRIES = 150_000
CACHE_LENGTH = 48
ID_BITS, PLACE_BITS = 31, 32
PLACES = (1 << PLACE_BITS) - 1
_BEYOND_LATIN = re.compile("[^\x00-\xff]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    rows = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
    if len(ranks) != len(rows) or len(set(ranks.values())) != len(ranks):
        raise ValueError(f"{path}: a token or a rank repeats")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: a byte has no rank")
    return ranks


class RankCodec:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        self.ranks = read_ranks(path)
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        order = np.empty(len(keys), dtype=np.int64)
        order[self.hash.slots(keys)] = np.arange(len(keys))
        self.key_at = pa.array([keys[k] for k in order], pa.binary())
        self.ids_at = [array("i", [self.ranks[keys[k]]]).tobytes() for k in order]
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = _pairs(self.ranks)
        self.byte_pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The library's pattern has a faster equal for texts within Latin-1; any other pattern is used as it is.
        own = pattern is not None and pattern != _library_pattern()
        self.any_text = regex.compile(pattern if own else PATTERN)
        self.latin = self.any_text if own else re.compile(PATTERN_LATIN)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary."""
        pairs, push, pop = self.pairs, heapq.heappush, heapq.heappop
        ids = [self.byte_ids[b] for b in raw]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank of each part joined with the one after it, -1 where the vocabulary has no such string. A heap entry is
        # (rank, place) in one number; it is stale once the rank at its place is another.
        first = self.byte_pairs
        ranks = [first[left << 8 | right] for left, right in zip(raw, raw[1:])]
        ranks.append(-1)
        heap = [rank << PLACE_BITS | i for i, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, new = entry & PLACES, entry >> PLACE_BITS
            if ranks[i] != new:
                continue
            j = after[i]
            ids[i], ids[j], ranks[j] = new, -1, -1
            after[i] = k = after[j]
            ranks[i] = -1
            if k < n:
                before[k] = i
                ranks[i] = rank = pairs.get(new << ID_BITS | ids[k], -1)
                if rank >= 0:
                    push(heap, rank << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                ranks[h] = rank = pairs.get(ids[h] << ID_BITS | new, -1)
                if rank >= 0:
                    push(heap, rank << PLACE_BITS | h)
        return [i for i in ids if i >= 0]

    def _missed(self, piece: str) -> bytes:
        """Ids of a pre-token that the perfect hash doesn't know, as little-endian int32 bytes."""
        ids = self.recent.get(piece)
        if ids is None:
            ids = self.older.get(piece) or array("i", self.merge(piece.encode())).tobytes()
            if len(piece) <= CACHE_LENGTH:
                if len(self.recent) >= CACHE_ENTRIES:
                    self.older, self.recent = self.recent, {}
                self.recent[piece] = ids
        return ids

    def _resolved(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after the other, and how many each has."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = self.hash.slots(distinct)
        known = (slots >= 0) & pc.equal(coded.dictionary.cast(pa.large_binary()).cast(pa.binary()), self.key_at.take(pa.array(np.maximum(slots, 0)))).to_numpy(zero_copy_only=False)
        parts = [self.ids_at[s] if k else self._missed(p) for p, s, k in zip(distinct, slots.tolist(), known.tolist(), strict=True)]
        flat = np.frombuffer(b"".join(parts), dtype="<i4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[at]
        begins = np.cumsum(each) - each
        return flat[np.repeat(starts[at] - begins, each) + np.arange(int(each.sum()))], each

    def _pieces(self, text: str) -> Iterator[list[str]]:
        pattern = self.any_text if _BEYOND_LATIN.search(text) else self.latin
        if len(text) <= LONG_TEXT:
            yield [m for m in pattern.findall(text) if m]
            return
        found = pattern.finditer(text)
        while some := [m.group() for m in islice(found, BLOCK)]:
            yield [m for m in some if m]

    def encode_texts(self, texts: list[str | None]) -> pa.ListArray:
        """An id list (never null) for each text."""
        lengths, out = np.zeros(len(texts), dtype=np.int64), [np.empty(0, dtype="<i4")]
        pieces: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if pieces:
                ids, sizes = self._resolved(pieces)
                out.append(ids)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                last = 0
                for row, n in owners:
                    lengths[row] += ends[last + n] - ends[last]
                    last += n
                pieces.clear()
                owners.clear()

        for row, text in enumerate(texts):
            for some in self._pieces(text or ""):
                pieces.extend(some)
                owners.append((row, len(some)))
                if len(pieces) >= BLOCK:
                    flush()
        flush()
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out), pa.int32()))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text])[0].as_py()


def _library_pattern() -> str | None:
    try:
        import public_tokenizers
    except ImportError:
        return None
    return public_tokenizers.PATTERN


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) in one number -> rank, of each two tokens that make a token."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left << ID_BITS | right] = rank
    return out


class RankStrings:
    """The bytes of each id: all that decoding needs."""

    def __init__(self, path: str) -> None:
        found = _by_id(read_ranks(path))
        self.none = len(found)  # the place of an id that stands for nothing
        self.strings = pa.array([*found, b""], pa.large_binary())

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The bytes (never null) of each id list."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        taken = self.strings.take(pa.array(np.where((flat >= 0) & (flat < self.none), flat, self.none)))
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(taken.buffers()[1], dtype="<i8", count=len(flat) + 1)[np.concatenate([[0], np.cumsum(sizes)])]
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2]])
        return whole.cast(pa.binary())


@lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str | None = None) -> RankCodec:
    """One codec for each rank file, pattern and worker."""
    return RankCodec(path, pattern)


@lru_cache(maxsize=4)
def rank_strings(path: str) -> RankStrings:
    return RankStrings(path)


def encode_ranks(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", pattern: str | None = None) -> DataFrame:
    """``docs`` with an id list for each row's whole text; replaces a column named like ``ids_col``."""
    text_batches(docs.sparkSession)

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = rank_codec(path, pattern)
        for batch in batches:
            yield codec.encode_texts(batch.to_pylist())

    return docs.withColumn(ids_col, encode(F.col(f"`{text_col}`")))


def decode_ranks(docs: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes (binary) of each row's id list; replaces a column named like ``bytes_col``."""
    text_batches(docs.sparkSession)

    @arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        strings = rank_strings(path)
        for batch in batches:
            yield strings.decode_lists(batch)

    return docs.withColumn(bytes_col, decode(_ids(docs, ids_col)))


def _ids(docs: DataFrame, ids_col: str) -> Column:
    return F.col(f"`{ids_col}`").cast("array<int>")
