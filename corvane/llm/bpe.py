"""Operator 1: byte-level BPE encoding and decoding.

Encoding follows the published algorithm: the bytes of a pre-token form a doubly linked list of symbols, a priority
queue holds the mergeable neighbours by (merge rank, place), and entries whose symbols have changed since are stale and
skipped. It costs O(n log n) a pre-token, however long. Decoding concatenates the bytes of the vocabulary's strings.

Scale: both are projections (no shuffle); the vocabulary (a few MB, fixed) is read by each Python worker from ``path``,
which must exist on every node. Merged pre-tokens are kept in a table of bounded size, which changes speed only.

Cases: a null or empty text gives an empty id list, and that gives an empty text. Other columns and repeated rows pass
unchanged, since a result depends on its own row only. Ids outside the vocabulary add nothing to a decoded text. A
special token's string in a text becomes the special id, as the library does. Broken UTF-8 from a cut id list decodes to
U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.llm._shared import text_batches

CACHE_ENTRIES = 100_000
CACHE_LENGTH = 48

#: The byte-level pre-tokenisation, for any text, and the same for texts within Latin-1 letters.
_TAIL = r"|[{s}]+(?![^{s}])|[{s}]+"
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^{s}\p{L}\p{N}]+".replace("{s}", _WHITE) + _TAIL.replace("{s}", _WHITE)
_LETTER, _NUMBER, _WHITE_1 = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
PATTERN_LATIN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_WHITE_1}{_LETTER}{_NUMBER}]+" + _TAIL.replace("{s}", _WHITE_1)
)
_BEYOND_LATIN = re.compile("[^\x00-\xff]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Merged(dict):
    """pre-token -> its ids as little-endian int32 bytes; filled as needed. When it is full its entries become the older half,
    from which pre-tokens that are still in use come back; so it holds twice ``CACHE_ENTRIES`` at most."""

    def __init__(self, codec: "BytePairCodec") -> None:
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.codec.merge(piece.encode())).tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _bytes_of(vocab: dict[str, int], special: dict[str, int]) -> list[bytes]:
    """The bytes that each id stands for."""
    of_symbol = {c: b for b, c in byte_symbols().items()}
    out = [b""] * (1 + max([*vocab.values(), *special.values()], default=-1))
    for s, i in vocab.items():
        out[i] = bytes(of_symbol[c] for c in s) if all(c in of_symbol for c in s) else s.encode()
    for s, i in special.items():
        out[i] = s.encode()
    return out


@lru_cache(maxsize=4)
def strings(path: str) -> list[bytes]:
    """The bytes of each id of a tokenizer file: all that decoding needs."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    return _bytes_of(spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]})


def decoded(ids: list[int], strings: list[bytes]) -> str:
    n = len(strings)
    return b"".join([strings[i] if 0 <= i < n else b"" for i in ids]).decode("utf-8", "replace")


class BytePairCodec:
    """Encoder over a tokenizer file (``model.vocab``, ``model.merges``, ``added_tokens``)."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.start = [vocab[symbols[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merged = _Merged(self)
        self.any_text, self.latin = regex.compile(PATTERN), re.compile(PATTERN_LATIN)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        pairs, ids = self.pairs, [self.start[b] for b in raw]
        n = len(ids)
        after, before, queue = [*range(1, n), -1], list(range(-1, n - 1)), []
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := pairs.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [i for i in ids if i >= 0]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian int32 bytes."""
        if not text:
            return b""
        parts = self.splitter.split(text) if self.splitter else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<i4").tobytes())
            elif part:
                find = (self.any_text if _BEYOND_LATIN.search(part) else self.latin).findall
                out.append(b"".join(map(self.merged.__getitem__, find(part))))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), dtype="<i4").tolist()


@lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    """One codec for each tokenizer file and worker."""
    return BytePairCodec(path)


def encode_column(text: Column | str, path: str) -> Column:
    """The ids (``array<int>``, never null) of a text column."""
    text_batches()

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = codec(path)
        for batch in batches:
            rows = [one.encode_bytes(t or "") for t in batch.to_pylist()]
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))

    return encode(text)


def decode_column(ids: Column | str, path: str) -> Column:
    """The text (never null) of an id column."""
    text_batches()

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = strings(path)
        for batch in batches:
            yield pa.array([decoded(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else [], known) for ids in batch], pa.string())

    return decode(ids)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with an id list for each row's whole text; replaces a column named like ``ids_col``."""
    return docs.withColumn(ids_col, encode_column(F.col(f"`{text_col}`"), path))


def bpe_decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's id list; replaces a column named like ``text_col``."""
    return docs.withColumn(text_col, decode_column(F.col(f"`{ids_col}`"), path))
