"""Operator 13: phrase collocations, by language.

1. Pieces. Texts are lower-cased (A-Z) and split at sentence marks on their bytes; words are joined by one space. Identical
   pieces of a language become one row with a multiplicity.
2. Counts. A task numbers the words of a block of pieces and adds up weighted n-grams of 1 to ``longest`` words as numbers;
   each distinct n-gram of a block becomes text once. What goes to a hash bucket goes as one compressed row, sorted; many
   buckets are dealt in two steps, so that rows stay large. A bucket is counted by duckdb, out of core: within ``DUCKDB_MB``, beyond that in a folder of its own task, which goes with it.
3. Parts. An n-gram occurs no oftener than its parts, so the counts of ``least`` or more hold every candidate and every part
   of one. A candidate asks for the counts of both sides of each cut; the requests are shuffled to where the counts lie, and
   the answers back to the candidate.

Scale: text is shuffled once, as distinct pieces; n-grams once, added up before they move, so a common word costs one row a
block. Lookups are sort-merge joins, which adaptive execution splits at a common part. The first rows of a language are found
in ``SALTS`` parts first. Nothing is broadcast or sampled. One piece without marks is one row, however long; its n-grams are
taken in blocks.

Cases: a null or empty text has no piece; a null language is ``und`` (and one with a text of that name). Repeated rows count
as often as they occur. Pieces without words count for nothing, and a language without candidates gives no rows. Columns
other than the language and the text are not read. An empty table gives no rows. Counts are exact up to 10^15.
"""

from __future__ import annotations

import itertools
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._shared import saved, text_batches

#: Fixed values of the contract: marks between pieces, white space between words, and the limits.
MARKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
LEAST, LONGEST, FIRST, PERCENT, UNIT = 10, 3, 2000, 50, 1_000_000

SLICE = 4 << 20  # bytes of text that are split at a time
BLOCK = 1 << 20  # words that are numbered at a time
CODE_BITS = 21
BUCKETS = 2  # for each shuffle partition
COARSE = 1024  # buckets that a task splits its n-grams into at most
DUCKDB_MB = 256
SALTS = 64

_MARK, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[list(MARKS)] = True
_BLANK[list(BLANKS)] = True


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (large_string, no nulls), and where each ends."""
    ends = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends[1:] - ends[0]


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype("<i8")
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every piece that has a word, with one space between words, and the row that it is of."""
    raw, ends = _bytes(texts)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    mark, blank = _MARK[low], _BLANK[low]
    starts = np.zeros(len(low) + 1, dtype=bool)
    starts[np.concatenate([[0], ends])] = True  # here a text starts
    after_break = starts[:-1].copy()
    after_break[1:] |= (mark | blank)[:-1]
    keep = ~(mark | (blank & after_break))  # of a run of blanks the first, and none at the start of a piece
    kept = np.concatenate([[0], np.cumsum(keep)])
    # A piece ends before a mark, or where its text ends; an end of text comes before a mark at the same place.
    cuts = np.flatnonzero(mark)
    order = np.argsort(np.concatenate([2 * cuts + 1, 2 * ends]), kind="stable")
    bounds = kept[np.concatenate([cuts, ends])[order]]
    rows = np.concatenate([np.searchsorted(ends, cuts, side="right"), np.arange(len(ends))])[order]
    data = np.where(blank, 32, low)[keep].astype(np.uint8)
    some = np.diff(bounds, prepend=0) > 0
    # At most one blank is left at the end of a piece.
    trailing = bounds[some] - 1
    trailing = trailing[data[trailing] == 32]
    stay = np.ones(len(data), dtype=bool)
    stay[trailing] = False
    bounds = np.concatenate([[0], np.cumsum(stay)])[bounds]
    pieces = _strings(data[stay], bounds)
    full = np.diff(bounds, prepend=0) > 0
    return pieces.filter(pa.array(full)), rows[full]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``SLICE`` bytes of text (the second column)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + SLICE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, piece, n: the distinct pieces of a slice."""
    for batch in batches:
        for some in _slices(batch):
            langs = pc.fill_null(some.column(0), "und").dictionary_encode()
            pieces, rows = split_pieces(pc.fill_null(some.column(1), "").cast(pa.large_string()))
            if not len(pieces):
                continue
            coded = pieces.dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            key, n = np.unique(lang * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            which, piece = np.divmod(key, len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(which)).cast(pa.string()), coded.dictionary.take(pa.array(piece)).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "piece", "n"])


def weighed_pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, piece, n of every distinct piece."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_weighed, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def count_block(pieces: pa.Array, weights: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, lengths, weights, hashes) of the distinct n-grams of pieces, in blocks of ``BLOCK`` words."""
    data, ends = _bytes(pieces)
    # A word ends at a blank or at the end of its piece.
    blanks = np.flatnonzero(data == 32)
    word_end = np.sort(np.concatenate([blanks, ends]), kind="stable")
    last = np.searchsorted(word_end, ends, side="left")  # the number of each piece's last word
    begins_piece = np.zeros(len(word_end), dtype=bool)
    begins_piece[0] = True
    begins_piece[last[:-1] + 1] = True
    word_start = np.concatenate([[0], word_end[:-1]]) + ~begins_piece
    sizes = np.diff(last, prepend=-1)
    left = np.repeat(last, sizes) - np.arange(len(word_end))  # words that follow in the piece
    weight = np.repeat(weights, sizes)
    words = _strings(data[data != 32], np.cumsum(word_end - word_start))
    for at in range(0, len(word_end), BLOCK):
        some = words.slice(at, BLOCK + longest - 1).dictionary_encode()
        order = pc.sort_indices(some.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[some.indices.to_numpy(zero_copy_only=False)]
        known = some.dictionary.take(pa.array(order)).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        begins = np.arange(min(BLOCK, len(word_end) - at))
        ids, seen = np.zeros(len(begins), dtype=np.int64), np.zeros(1, dtype=np.uint64)
        parts = []
        for size in range(1, longest + 1):
            fit = left[at + begins] >= size - 1
            begins, ids = begins[fit], ids[fit]
            if not len(begins):
                break
            key = ids << CODE_BITS | codes[begins + size - 1]
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
            heads = np.flatnonzero(new)
            example = begins[order[heads]]
            seen = _mixed(seen[ids[order[heads]]] ^ hashes[codes[example + size - 1]])
            parts.append((word_start[at + example], word_end[at + example + size - 1], np.add.reduceat(weight[at + begins[order]], heads), seen))
            ids = np.empty(len(key), dtype=np.int64)
            ids[order] = np.cumsum(new) - 1
        start, end, n, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield data, start, end - start, n, h


ROW = "bucket int, salt int, langs array<string>, counts array<int>, phrases binary, lengths binary, weights binary"
_ROW = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("langs", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("phrases", pa.binary()), ("lengths", pa.binary()), ("weights", pa.binary())])


class _Packer:
    """N-grams of several languages as one compressed row a bucket."""

    def __init__(self, buckets: int, salt: int = 0) -> None:
        self.buckets, self.salt = buckets, salt
        self.held: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, lang: str, data: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> None:
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=self.buckets))])
        self.held.append((lang, data, start[order], length[order], n[order], cut))

    def rows(self, first: int = 0) -> Iterator[pa.RecordBatch]:
        """The rows, with buckets numbered from ``first``."""
        press = zstandard.ZstdCompressor(level=1).compress
        sizes = sum(np.diff(cut) for *_, cut in self.held) if self.held else np.zeros(0)
        out, size = [], 0
        for b in np.flatnonzero(sizes).tolist():
            some = [(lang, data, start[cut[b] : cut[b + 1]], length[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]]) for lang, data, start, length, n, cut in self.held if cut[b + 1] > cut[b]]
            lengths = np.concatenate([x[3] for x in some]).astype("<i4")
            phrases = press(np.concatenate([_gathered(x[1], x[2], x[3]) for x in some]).tobytes())
            out.append((first + b, self.salt, [x[0] for x in some], [len(x[3]) for x in some], phrases, press(lengths.tobytes()), press(np.concatenate([x[4] for x in some]).astype("<i8").tobytes())))
            size += len(phrases)
            if size >= SLICE:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)
        self.held = []


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _grams(buckets: int, longest: int, salts: int):
    """Pieces (lang, piece, n) to rows of n-grams by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 2 * SLICE:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        packer = _Packer(buckets, TaskContext.get().partitionId() % salts)
        for lang in pc.unique(table.column(0)).to_pylist():
            rows = table.filter(pc.equal(table.column(0), lang))
            pieces = pa.concat_arrays(rows.column(1).chunks).cast(pa.large_string())
            weights = rows.column(2).to_numpy()
            seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
            for data, start, length, n, h in count_block(pieces, weights, longest):
                packer.add(lang, data, start, length, n, (_mixed(h ^ seed) % np.uint64(buckets)).astype(np.int64))
            total = (weights * (pc.count_substring(pieces, " ").to_numpy(zero_copy_only=False) + 1)).sum()
            one = (_mixed(np.array([seed], dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
            packer.add(lang, np.empty(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([total]), one)
            if sum(len(x[2]) for x in packer.held) >= 2 * BLOCK:
                yield from packer.rows()
        yield from packer.rows()

    return run


def _finer(fine: int):
    """Rows of coarse buckets to rows of ``fine`` buckets for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for some in _singly(batch) for row in some.to_pylist())
        for coarse, own in itertools.groupby(rows, key=lambda row: row["bucket"]):
            packer, size = _Packer(fine), 0
            for row in own:
                lengths, data, weights = _unpacked(row)
                starts, at = np.cumsum(lengths) - lengths, 0
                for lang, count in zip(row["langs"], row["counts"], strict=True):
                    some = slice(at, at + count)
                    at += count
                    seed = xxhash.xxh3_64_intdigest(lang)
                    bucket = np.fromiter((xxhash.xxh3_64_intdigest(data[s : s + n], seed) % fine for s, n in zip(starts[some].tolist(), lengths[some].tolist(), strict=True)), np.int64, count)
                    packer.add(lang, data, starts[some], lengths[some], weights[some], bucket)
                size += len(lengths)
                if size >= 2 * BLOCK:
                    yield from packer.rows(coarse * fine)
                    size = 0
            yield from packer.rows(coarse * fine)

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, bytes and weights of the n-grams of a row."""
    open_ = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(open_(row["lengths"]), dtype="<i4").astype(np.int64), np.frombuffer(open_(row["phrases"]), dtype=np.uint8), np.frombuffer(open_(row["weights"]), dtype="<i8")


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _opened(row: dict) -> pa.RecordBatch:
    """The n-grams of one row of a bucket."""
    lengths, data, weights = _unpacked(row)
    phrases = _strings(data, np.cumsum(lengths))
    lang = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(row["langs"]), dtype=np.int32), row["counts"])), pa.array(row["langs"], pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, phrases, pa.array(weights)], names=["lang", "phrase", "n"])


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for some in _singly(batch) for row in some.to_pylist())
        for _, own in itertools.groupby(rows, key=lambda row: row["bucket"]):
            folder = tempfile.mkdtemp(prefix="corvane-count-")  # this task's own; nothing else reads it
            try:
                yield from count(own, folder)
            finally:
                shutil.rmtree(folder, ignore_errors=True)

    def count(own: Iterator[dict], folder: str) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.large_string()), ("n", pa.int64())])
        with duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": folder, "preserve_insertion_order": False}) as con:
            con.register("grams", pa.RecordBatchReader.from_batches(schema, map(_opened, own)))
            # The empty phrase carries the number of words.
            found = con.sql(f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS f FROM grams GROUP BY lang, phrase HAVING sum(n) >= {least} OR phrase = ''")
            for batch in found.to_arrow_reader(20_000):
                yield batch.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))

    return run


def _singly(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, 1) for k in range(batch.num_rows))


def frequent_phrases(pieces: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, f, words of every phrase of 1 to ``longest`` words that occurs ``least`` times, and as the empty phrase the
    number of words of each language; written to the shared folder."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * parts
    # Each block of a task makes a row a bucket, so beyond COARSE buckets the rows would be small: they are split in two steps.
    fine = -(-buckets // COARSE)
    coarse = -(-buckets // fine)
    salts = max(1, parts // coarse) if fine > 1 else 1
    grams = pieces.mapInArrow(_grams(coarse, longest, salts), ROW)
    if fine > 1:
        grams = grams.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket").mapInArrow(_finer(fine), ROW)
    counted = grams.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_counted(least), "lang string, phrase string, f long")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return saved(counted.withColumn("words", words.cast("int")), "phrase-counts")


def _first_words(phrase: str, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)), exact: the products have up to 37 digits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    top = ((a * a).cast("decimal(31,0)") * F.lit(UNIT).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (left * right).cast("decimal(31,0)"))


def scored_candidates(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate, by its lowest-scoring cut."""
    asked = []
    for k in range(1, longest):
        sides = (_first_words("phrase", k), F.substring(F.col("phrase"), F.length(_first_words("phrase", k)) + 2, F.length("phrase")))
        asked += [F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))) for side, part in enumerate(sides)]
    candidates = counts.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), "words")
    requests = candidates.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(*asked))).alias("q")).select("lang", "phrase", "a", "q.*")
    held = counts.where(F.col("words").between(1, longest - 1)).select("lang", F.col("phrase").alias("part"), "f")
    answers = requests.join(held.hint("merge"), ["lang", "part"])
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"f{k}_{s}") for k in range(1, longest) for s in (0, 1)]
    met = answers.groupBy("lang", "phrase", "a").agg(*sides)
    cuts = [F.when(F.col(f"f{k}_0").isNotNull(), F.struct(floor_score(F.col("a"), F.col(f"f{k}_0"), F.col(f"f{k}_1")).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}_0").alias("l"), F.col(f"f{k}_1").alias("r"))) for k in range(1, longest)]
    lowest = met.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def largest_containing(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, longer: the count of the commonest longer candidate that holds the words of a phrase of two or more."""
    words = F.split("phrase", " ")
    runs = F.transform(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1), lambda i: F.array_join(F.slice(words, i, F.col("n")), " "))
    sizes = counts.where("words > 2").select("lang", "phrase", "f", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    return sizes.select("lang", F.explode(runs).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def first_of_each(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each lang by ``order``, ranked from 1: first within parts of a lang, so none is gathered whole."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language."""
    if not 2 <= longest:
        raise ValueError("phrases have two words or more")
    counts = frequent_phrases(weighed_pieces(docs, lang_col, text_col), least, longest)
    scored = scored_candidates(counts, longest)
    within = largest_containing(counts, longest)
    free = scored.join(within.hint("merge"), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    top = first_of_each(free.drop("longer"), first, F.desc("score"), F.desc("a"), F.col("phrase"))
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
