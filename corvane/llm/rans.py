"""Operator 9: token ids written as entropy-coded blocks, and read back.

Ids are coded with a static range asymmetric numeral system (rANS): one frequency table, counted over all documents, is
shared by all blocks. A block holds whole consecutive documents and is coded alone, with up to ``LANES`` interleaved
states, so blocks decode in parallel. Every ``CHECKPOINT`` steps a block notes its states and place in the stream, with
a CRC-32 of the ids since the last note, so that a reader can start, or check, within a block.

A file set is a Parquet table ``blocks`` (one self-describing binary payload a row, layout in ``pack_block``) in ascending
order of document id: range partition ``part``, then ``block`` within it, each with its offset in the part. Spark's
committer writes it, so it works on any file system and a lost executor's attempt leaves nothing.

Scale: texts are read once, where they lie, and become ids, which go to the shared folder with each task's id counts. Ids
are then range-partitioned by document id (the only shuffle), sorted, coded block by block and written. Reading shuffles
nothing. The frequency table has at most one entry an id of the vocabulary, and part offsets one row a partition; only
those meet on the driver. A task holds one Arrow batch and one block (``BLOCK_IDS`` ids, or one document if that has more).

Cases: null and empty texts have the end id alone. Repeated and null document ids stay separate rows, a null id first; among
equal ids the order is by the first ids of the text, then a hash of it, which also deals them over partitions. An empty
table gives an empty file set and no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._shared import discard, saved, scratch_path, text_batches

LANES = 1024
BLOCK_IDS = 1 << 18
CHECKPOINT = 64
LOW = np.uint64(1 << 31)
MAGIC = b"CVR1"
CACHE_ENTRIES = 500_000
SLICE_CHARS = 1 << 23
GATHER_WORDS = 1 << 18
COUNT_TASKS = 64
_MARK = "\x02"

#: A text of these characters alone is lower-cased, cut at white space and looked up; any other goes to the library whole.
_BEYOND_SIMPLE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]|<\\|")
#: Marks between a letter or digit and white space are a piece of their own, so a space before them changes no id.
_TAIL = r"([a-z0-9à-öø-ÿ])([.,;:!?]+(?:\s|$))"


# --- tokenising -------------------------------------------------------------------------------------------------------

_ODD_BYTES = np.array([b < 0x20 and b not in b"\t\n\r" or b == 0x7F or b > 0xC3 for b in range(256)])


def all_simple(texts: list[str]) -> bool:
    """Whether no text has what ``_BEYOND_SIMPLE`` finds, by bytes of all texts at once."""
    joined = "\n".join(texts)
    raw = np.frombuffer(joined.encode(), dtype=np.uint8)
    if _ODD_BYTES[raw].any() or "<|" in joined:
        return False
    second = raw[np.flatnonzero(raw[:-1] == 0xC2) + 1]
    return not ((second <= 0xA0) | (second == 0xAD)).any()


class WordTokenizer:
    """The library's tokenizer with a bounded table of words; only words not seen lately go through the library."""

    def __init__(self, path: str, by_word: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one of many on its node
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(size, dtype=bool)
            self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        mark = self.library.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.by_word = by_word
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in got]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each has."""
        if self.by_word and all_simple(texts):
            return self._looked_up(texts)
        plain = [self.by_word and not _BEYOND_SIMPLE.search(t) for t in texts]
        sizes, parts = np.zeros(len(texts), dtype=np.int64), []
        ids, n = self._looked_up([t for t, p in zip(texts, plain, strict=True) if p])
        sizes[plain] = n
        begins = iter((np.cumsum(n) - n).tolist())
        others = iter(self._packed([t for t, p in zip(texts, plain, strict=True) if not p]))
        for k, p in enumerate(plain):
            if p:
                begin = next(begins)
                parts.append(ids[begin : begin + sizes[k]])
            else:
                parts.append(np.frombuffer(next(others), dtype=self.dtype))
                sizes[k] = len(parts[-1])
        return np.concatenate(parts) if parts else ids, sizes

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned integers of ``dtype``."""
        ids, sizes = self.encode_texts(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of the texts are looked up once, and their ids copied to every place."""
        spaced = pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.string()), _TAIL, r"\1 \2")
        lists = pc.ascii_split_whitespace(spaced)
        offsets = lists.offsets.to_numpy()
        found = lists.flatten().dictionary_encode()
        rows = self._ids_of(found.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(rows), dtype=self.dtype)
        length = np.fromiter(map(len, rows), dtype=np.int32, count=len(rows)) // np.int32(self.dtype.itemsize)
        first = np.cumsum(length, dtype=np.int32) - length
        word = found.indices.to_numpy(zero_copy_only=False)
        n = length[word]
        upto = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        ids = np.empty(upto[-1], dtype=self.dtype)
        for a in range(0, len(word), GATHER_WORDS):
            some, many = word[a : a + GATHER_WORDS], n[a : a + GATHER_WORDS]
            ends = np.cumsum(many, dtype=np.int32)
            at = np.repeat(first[some] - (ends - many), many)
            at += np.arange(len(at), dtype=np.int32)
            ids[upto[a] : upto[a] + len(at)] = flat[at]
        return ids, upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        rows = list(map(self.words.get, words))
        unknown = [k for k, r in enumerate(rows) if r is None]
        if not unknown:
            return rows
        if len(self.words) + len(unknown) > CACHE_ENTRIES:  # words that are still in use come back from the older half
            self.words, self.older = {"": b""}, self.words
        learnt, older = self.words, self.older
        fresh = [words[k] for k in unknown]
        if older:
            back = {w: ids for w in fresh if (ids := older.get(w)) is not None}
            learnt.update(back)
            fresh = [w for w in fresh if w not in back]
        alone = [w for w in fresh if w.isalpha()]
        other = [w for w in fresh if not w.isalpha()]
        for cut, some in ((self._by_ends, alone), (self._by_marks, other)):
            for k in range(0, len(some), 1024):
                learnt.update(zip(some[k : k + 1024], cut(some[k : k + 1024]), strict=True))
        for k in unknown:
            rows[k] = learnt[words[k]]
        return rows

    def _by_ends(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: all in one text, cut at the ids that end a word."""
        if self.ends is None:
            return self._packed(words)
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return self._cut(ids, [0, *cuts.tolist()], cuts.tolist()) if len(cuts) == len(words) else self._packed(words)

    def _by_marks(self, words: list[str]) -> list[bytes]:
        """Ids of any words: all in one text, with a mark between them that no simple text holds."""
        if self.mark is None:
            return self._packed(words)
        ids = np.array(self.library.encode_batch_fast([f" {_MARK} ".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        marks = np.flatnonzero(ids == self.mark)
        return self._cut(ids, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]) if len(marks) == len(words) - 1 else self._packed(words)

    def _cut(self, ids: np.ndarray, begins: list[int], ends: list[int]) -> list[bytes]:
        raw, width = ids.tobytes(), self.dtype.itemsize
        return [raw[width * a : width * b] for a, b in zip(begins, ends, strict=False)]


@lru_cache(maxsize=2)
def tokenizer(path: str, by_word: bool) -> WordTokenizer:
    return WordTokenizer(path, by_word)


# --- coding one block -------------------------------------------------------------------------------------------------


class FrequencyTable:
    """Frequencies scaled to a power of two, every counted id having one slot at least."""

    def __init__(self, counts: np.ndarray) -> None:
        present = np.flatnonzero(counts)
        self.bits = max(16, int(len(counts)).bit_length() + 4)
        total = 1 << self.bits
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(present):
            share = counts[present].astype(np.float64) / float(counts.sum()) * (total - len(present))
            scaled = 1 + np.floor(share).astype(np.int64)
            scaled[np.argmax(scaled)] += total - scaled.sum()
            freq[present] = scaled
        self.freq = freq.astype(np.uint64)
        ends = np.cumsum(freq)
        self.first = (ends - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(counts), dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """A payload of one block of ids (at least one)."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 256)))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, ids[-1], dtype=np.int64)
    padded[:n] = ids
    rows = padded.reshape(steps, lanes)
    freqs, firsts = table.freq[rows], table.first[rows]
    bits, up, half = np.uint64(table.bits), np.uint64(63 - table.bits), np.uint64(32)
    state = np.full(lanes, LOW, dtype=np.uint64)
    stream: list[np.ndarray] = []
    notes: list[tuple[np.ndarray, int]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        freq = freqs[t]
        full = state >= freq << up
        if full.any():
            words = state[full].astype("<u4")
            stream.append(words)
            written += len(words)
            np.right_shift(state, half, out=state, where=full)
        quotient = state // freq
        state = (quotient << bits) + (state - quotient * freq) + firsts[t]
        if t % CHECKPOINT == 0:
            notes.append((state.copy(), written))
    notes.reverse()
    words = b"".join(w.tobytes() for w in reversed(stream))
    return pack_block(n, lanes, [(s, written - w) for s, w in notes], [zlib.crc32(ids[a : a + CHECKPOINT * lanes].astype("<u4").tobytes()) for a in range(0, n, CHECKPOINT * lanes)], words)


def pack_block(n: int, lanes: int, notes: list[tuple[np.ndarray, int]], sums: list[int], words: bytes) -> bytes:
    """Layout: magic, ids, lanes, checkpoints, bytes of stream (4 x u4 after the magic), then for each checkpoint its
    place in the stream (u4), CRC-32 (u4) and states (lanes x u8), then the stream; a CRC-32 of all that ends it."""
    head = MAGIC + struct.pack("<4I", n, lanes, len(notes), len(words))
    body = b"".join(struct.pack("<2I", at, crc) + state.astype("<u8").tobytes() for (state, at), crc in zip(notes, sums, strict=True))
    payload = head + body + words
    return payload + struct.pack("<I", zlib.crc32(payload))


def decode_block(payload: bytes, table: FrequencyTable, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of checkpoints ``first`` to ``last`` (all by default) of a block; a damaged block raises ``ValueError``."""
    if payload[:4] != MAGIC or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged block: its checksum differs")
    n, lanes, count, size = struct.unpack_from("<4I", payload, 4)
    each = 8 + 8 * lanes
    words = np.frombuffer(payload, dtype="<u4", count=size // 4, offset=20 + count * each).astype(np.uint64)
    last = count if last is None else min(last, count)
    if first >= last:
        return np.empty(0, dtype=np.uint32)
    at, _ = struct.unpack_from("<2I", payload, 20 + first * each)
    state = np.frombuffer(payload, dtype="<u8", count=lanes, offset=28 + first * each).copy()
    steps = -(-n // lanes)
    begin, end = first * CHECKPOINT, min(steps, last * CHECKPOINT)
    out = np.empty((max(0, end - begin), lanes), dtype=np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for t in range(begin, end):
        slot = state & mask
        ids = table.slots[slot]
        out[t - begin] = ids
        state = table.freq[ids] * (state >> bits) + slot - table.first[ids]
        low = state < LOW
        k = int(low.sum())
        if k:
            state[low] = (state[low] << np.uint64(32)) | words[at : at + k]
            at += k
    ids = out.reshape(-1)[: max(0, min(n, end * lanes) - begin * lanes)]
    for k in range(first, last):
        piece = ids[(k - first) * CHECKPOINT * lanes : (k - first + 1) * CHECKPOINT * lanes]
        if zlib.crc32(piece.astype("<u4").tobytes()) != struct.unpack_from("<2I", payload, 20 + k * each)[1]:
            raise ValueError(f"damaged block: the checksum of checkpoint {k} differs")
    return ids


# --- files ------------------------------------------------------------------------------------------------------------

_IDS = "doc_id bigint, head binary, tie bigint, ids binary, counts binary"
_BLOCKS = "part int, block int, part_offset bigint, n_ids bigint, doc_ids binary, has_id binary, sizes binary, payload binary"


def _binaries(raw: bytes, ends: np.ndarray) -> pa.Array:
    """A binary array of the pieces of ``raw`` that end where told."""
    offsets = np.concatenate(([0], ends)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _tokenise(path: str, end_id: int, by_word: bool):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizer(path, by_word)
        names = ["doc_id", "head", "tie", "ids", "counts"]
        counts = np.zeros(one.library.get_vocab_size(with_added_tokens=True), dtype=np.int64)

        def rows(docs: list[pa.RecordBatch], texts: list[str]) -> pa.RecordBatch:
            ids, sizes = one.encode_texts(texts)
            ends = np.cumsum(sizes + 1)
            out = np.full(len(ids) + len(texts), end_id, dtype=one.dtype)
            inner = np.ones(len(out), dtype=bool)
            inner[ends - 1] = False
            out[inner] = ids
            counts[:] += np.bincount(out, minlength=len(counts))
            binary = _binaries(out.tobytes(), ends * one.dtype.itemsize)
            keys = pa.Table.from_batches(docs).combine_chunks()
            columns = [keys.column(0).combine_chunks(), pc.binary_slice(binary, 0, 8), keys.column(1).combine_chunks(), binary, pa.nulls(len(texts), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        keys: list[pa.RecordBatch] = []
        held: list[str] = []
        size = 0
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            begin = 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= SLICE_CHARS or k + 1 == len(texts):
                    keys.append(batch.slice(begin, k + 1 - begin).select([0, 1]))
                    held += texts[begin : k + 1]
                    begin = k + 1
                    if size >= SLICE_CHARS:
                        yield rows(keys, held)
                        keys, held, size = [], [], 0
        if held:
            yield rows(keys, held)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    return tokenise


def count_ids(ids: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id: the counts that tokenising noted, summed in a bounded number of tasks, then over those."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_buffer(), dtype="<i8")
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["id", "n"])

    noted = ids.select("counts").where("counts IS NOT NULL").coalesce(COUNT_TASKS)
    rows = noted.mapInArrow(local, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def _code(shared, dtype: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block, offset = FrequencyTable(shared.value), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=dtype)
            sizes = np.array([len(x) for x in held], dtype="<i8") // np.dtype(dtype).itemsize
            values = [part, block, offset, len(ids), np.array([d or 0 for d in docs], dtype="<i8").tobytes(), bytes(d is not None for d in docs), sizes.tobytes(), encode_block(ids, table)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "block", "part_offset", "n_ids", "doc_ids", "has_id", "sizes", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                held.append(ids)
                size += len(ids) // np.dtype(dtype).itemsize
                if size >= BLOCK_IDS:
                    yield row()
                    block, offset, size = block + 1, offset + size, 0
                    docs.clear()
                    held.clear()
        if docs:
            yield row()

    return code


def write_ids(docs: DataFrame, path: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, partitions: int | None = None, by_word: bool = True) -> tuple[str, FrequencyTable]:
    """Tokenises whole texts, appends ``end_id``, and writes the file set ``out``; returns its place and its table.

    ``by_word`` is for tokenizers that lower-case and split at white space first; others need ``by_word=False``.
    """
    spark = docs.sparkSession
    text_batches(spark)
    out = out or scratch_path(spark, "rans")
    one = tokenizer(path, by_word)
    dtype, size = one.dtype.str, one.library.get_vocab_size(with_added_tokens=True)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ids = saved(rows.mapInArrow(_tokenise(path, end_id, by_word), _IDS), "rans-ids")
    counts = count_ids(ids, size)
    keys = ["doc_id", "head", "tie"]
    dealt = ids.where("ids IS NOT NULL").select(*keys, "ids").repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "ids")
    coded = dealt.select("doc_id", "ids").mapInArrow(_code(spark.sparkContext.broadcast(counts), dtype), _BLOCKS)
    coded.write.option("compression", "none").parquet(f"{out}/blocks")
    discard(ids)
    spark.createDataFrame([(bytearray(counts.astype("<i8").tobytes()),)], "counts binary").write.parquet(f"{out}/table")
    return out, FrequencyTable(counts)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (``array<int>``) of every document of a file set."""
    return _read(spark, out, digest=False)


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian u4 ids), decoded from every block of a file set."""
    return _read(spark, out, digest=True)


def _read(spark: SparkSession, out: str, digest: bool) -> DataFrame:
    blocks = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks")
    counts = np.frombuffer(spark.read.parquet(f"{out}/table").first()["counts"], dtype="<i8")
    # One number a range partition: where its first block begins.
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    begins = dict(zip((p for p, _ in sums), np.cumsum([0, *(n for _, n in sums)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((counts, begins))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, begins = shared.value
        table = FrequencyTable(counts)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"], table).astype("<u4")
                sizes = np.frombuffer(row["sizes"], dtype="<i8")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                has = np.frombuffer(row["has_id"], dtype=np.uint8) == 0
                docs = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=has)
                columns = [docs, pa.array(starts + begins[row["part"]] + row["part_offset"])]
                if digest:
                    raw = memoryview(ids.tobytes())
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns += [pa.array(sizes), pa.array(sums, pa.int64())]
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] if digest else ["doc_id", "start", "ids"]
    return blocks.select("part", "part_offset", "doc_ids", "has_id", "sizes", "payload").mapInArrow(decode, "doc_id bigint, start bigint, " + ("n_tokens bigint, ids_crc32 bigint" if digest else "ids array<int>"))
