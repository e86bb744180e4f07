"""Operator 5: language-model scoring with a hidden Markov model.

Tokens are words (ASCII white space splits, A-Z in lower case) and an end token a text. Hidden states emit word classes:
each of the ``OWN`` most frequent words is a class, other words share ``SHARED`` classes by a hash of their endings. Within a
shared class every word has a share for each state, from its expected counts there (``Emissions``), and words not seen have
one place. So every text has a likelihood.

Training. Baum-Welch starts from class rates that a seeded generator disturbs, so from no sample, and makes ``PASSES`` passes
over all training texts; texts are cut into segments of ``SEGMENT`` tokens. Each task adds up the expected counts of its
blocks and those sums meet in the shuffle. A last pass over all training texts gathers, for every word, how it is spread
over the states: a table of one row a word, which grows with the corpus as the word counts do and stays distributed.
Its spreads are sums of posteriors rounded to 255 parts (integers), so it does not depend on the order of addition; the other sums
differ by rounding alone. Scoring is the exact scaled forward recursion over whole texts.

Scale: texts are read once and become blocks of about ``BLOCK_BYTES`` of text, coded by the block's own dictionary.
Dictionaries, not tokens, are shuffled: entries are summed by word, joined with the word table by word, and gathered again
by block; the blocks themselves are written bucketed by block and stay where they are. A word occurs once a block, so a
very frequent word makes no hot key. Only class totals and parameters (``STATES`` x classes) reach the driver; no vocabulary
does, except the ``OWN`` most frequent words.

Cases: a null, empty or white-space text has the end token alone. Repeated rows count and are scored each; a null id passes
through and its text trains if the caller's ``train`` column says so (null: it does not). Without training tokens each
token's base is 0.1 / 0.1, and the score is the base score. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import discard, saved, scratch_path, summed, text_batches

STATES = 8
OWN = 4096
SHARED = 1024
SEGMENT = 128
PASSES = 4
BLOCK_BYTES = 1 << 23
BATCH_SEGMENTS = 1024
END = b" "  # no word holds a space
PRIOR = 20.0
DRAWN = 0.2  # how far a word's spread over the states is drawn to its class's
LEVELS = 255  # a token's posterior of a state is counted in so many parts


# --- tokens and blocks ------------------------------------------------------------------------------------------------


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of the texts, the number of every token in that list, and how many tokens each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    found = lists.flatten().dictionary_encode()
    words, word = found.dictionary.cast(pa.binary()), found.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(words).to_numpy() > 0)[word]  # white space at an end of a text gives an empty piece
    upto = np.concatenate(([0], np.cumsum(real)))
    sizes = np.diff(upto[offsets - offsets[0]])
    ends = np.cumsum(sizes + 1)
    ids = np.full(int(ends[-1]) if len(ends) else 0, len(words), dtype=np.int32)
    inner = np.ones(len(ids), dtype=bool)
    inner[ends - 1] = False
    ids[inner] = word[real]
    return pa.concat_arrays([words, pa.array([END], pa.binary())]), ids, sizes + 1


_BLOCK = "block bigint, doc_ids binary, has_id binary, train binary, sizes binary, ids binary, words array<binary>, counts array<int>"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    held: list[pa.RecordBatch] = []

    def row() -> pa.RecordBatch:
        docs, texts, trains = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
        words, ids, sizes = coded(texts)
        train = pc.fill_null(trains, False).to_numpy(zero_copy_only=False)
        counts = np.bincount(ids[np.repeat(train, sizes)], minlength=len(words)).astype(np.int32)
        binaries = [pc.fill_null(docs, 0).to_numpy().astype("<i8"), docs.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), train.astype(np.uint8), sizes.astype("<i8"), ids.astype("<i4")]
        columns = [pa.array([part << 32 | seq], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in binaries)]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts))]
        return pa.RecordBatch.from_arrays(columns, names=_BLOCK_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        upto = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        begin = 0
        while upto[-1] >= BLOCK_BYTES:
            end = int(np.searchsorted(upto, BLOCK_BYTES)) + 1
            held.append(batch.slice(begin, end - begin))
            yield row()
            upto -= upto[end - 1]
            seq, begin = seq + 1, end
            held.clear()
            if end == batch.num_rows:
                break
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
        size = int(upto[-1])
    if held:
        yield row()


class Blocks:
    """Blocks of whole documents, coded by their own dictionaries: a table bucketed by block in the shared folder."""

    def __init__(self, docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> None:
        spark = docs.sparkSession
        text_batches(spark)
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), train.alias("train"))
        self.spark, self.name, self.path = spark, f"corvane_lm_{uuid.uuid4().hex}", scratch_path(spark, "lm-blocks")
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.mapInArrow(_pack, _BLOCK).write.bucketBy(buckets, "block").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    def files(self) -> DataFrame:
        """The blocks as plain files: one task for some of them, whatever the buckets."""
        return self.spark.read.schema(_BLOCK).parquet(self.path)

    def bucketed(self) -> DataFrame:
        """The blocks by bucket, for a join by block that leaves them in place. The plan keeps the files, not the name."""
        return self.spark.table(self.name)

    def release(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")


def word_counts(blocks: DataFrame) -> DataFrame:
    """word, c: occurrences in training texts of every word that has any."""
    entries = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.counts").cast("long").alias("c"))
    return saved(entries.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


# --- the model --------------------------------------------------------------------------------------------------------


def tail_classes(words: pa.Array) -> np.ndarray:
    """The shared class of each word (a binary array): a hash of its last three bytes without marks."""
    bare = pc.ascii_rtrim(words.cast(pa.string()), ".,;:!?")
    _, ends, data = bare.buffers()
    at = np.frombuffer(ends, dtype="<i4")[bare.offset : bare.offset + len(bare) + 1].astype(np.int64)
    raw = np.append(np.frombuffer(data or b"", dtype=np.uint8), np.uint8(0))
    length, code = np.diff(at), np.zeros(len(bare), dtype=np.uint32)
    for k in (1, 2, 3):
        code = code * np.uint32(257) + np.where(length >= k, raw[np.maximum(at[1:] - k, 0)].astype(np.uint32) + np.uint32(1), np.uint32(0))
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32) % SHARED


class WordClasses:
    """Classes of words: own classes of frequent words first, then shared ones."""

    def __init__(self, own: list[bytes]) -> None:
        self.own = pa.array(own, pa.binary())
        self.size = len(own) + SHARED

    def __call__(self, words: pa.Array) -> np.ndarray:
        mine = pc.fill_null(pc.index_in(words, value_set=self.own), -1).to_numpy()
        return np.where(mine < 0, tail_classes(words) + len(self.own), mine)


class Hmm(NamedTuple):
    start: np.ndarray  # of a document
    resume: np.ndarray  # of a later segment, in training only
    move: np.ndarray
    emit: np.ndarray  # classes x states


def first_guess(rates: np.ndarray, states: int, seed: int) -> Hmm:
    """Sticky states with class rates that are disturbed strongly, so that states part within a few passes."""
    rng = np.random.default_rng(seed)
    emit = rates[:, None] * (0.05 + rng.exponential(size=(len(rates), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Hmm(even, even, move, emit / emit.sum(axis=0))


def segments_of(sizes: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and whether it opens a document, of each segment of documents that follow each other."""
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // length)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(starts, parts) + nth * length
    size = np.minimum(length, np.repeat(starts + sizes, parts) - begin)
    return begin, size, nth == 0


def posteriors(model: Hmm, classes: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Forward-backward over segments, ``BATCH_SEGMENTS`` abreast: the tokens' places, their state posteriors, and the
    expected starts, resumes and moves of each batch."""
    k = model.move.shape[0]
    order = np.argsort(-size, kind="stable")
    ones = np.ones(k)
    for at in range(0, len(order), BATCH_SEGMENTS):
        some = order[at : at + BATCH_SEGMENTS]
        length = size[some]
        steps = int(length[0])
        alive = np.searchsorted(-length, -np.arange(steps), side="left")  # segments longer than t
        where = np.minimum(begin[some][None, :] + np.arange(steps)[:, None], len(classes) - 1)
        emitted = model.emit[classes[where]]
        alpha = np.zeros((steps, len(some), k))
        back = np.zeros((steps, len(some), k))
        scale = np.ones((steps, len(some), 1))
        a = np.where(first[some][:, None], model.start, model.resume)
        for t in range(steps):
            n = alive[t]
            a = a[:n] if t == 0 else a[:n] @ model.move
            a *= emitted[t, :n]
            scale[t, :n, 0] = 1.0 / (a @ ones)
            a *= scale[t, :n]
            alpha[t, :n] = a
        beta = np.ones((len(some), k))
        onward = np.ascontiguousarray(model.move.T)
        emitted *= scale
        for t in range(steps - 1, 0, -1):
            n = alive[t]
            np.multiply(emitted[t, :n], beta[:n], out=back[t, :n])
            emitted[t, :n] = beta[:n]  # no longer needed: keeps the backward values
            beta[:n] = back[t, :n] @ onward
        emitted[0] = beta
        moves = (alpha[:-1].reshape(-1, k).T @ back[1:].reshape(-1, k)) * model.move if steps > 1 else np.zeros((k, k))
        alpha *= emitted
        opens = first[some]
        active = np.arange(steps)[:, None] < length[None, :]
        yield where[active], alpha[active], alpha[0, opens].sum(axis=0), alpha[0, ~opens].sum(axis=0), moves


def expected_counts(model: Hmm, classes: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray) -> Hmm:
    """Expected counts of starts, moves and emissions over segments."""
    k, c = model.move.shape[0], model.emit.shape[0]
    start, resume, move, emit = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for where, gamma, opened, resumed, moved in posteriors(model, classes, begin, size, first):
        start += opened
        resume += resumed
        move += moved
        flat = classes[where]
        for s in range(k):
            emit[:, s] += np.bincount(flat, weights=gamma[:, s], minlength=c)
    return Hmm(start, resume, move, emit)


def reestimated(counts: Hmm, rates: np.ndarray) -> Hmm:
    """Parameters from expected counts, each state's emissions drawn to the overall rates by ``PRIOR`` tokens."""
    share = lambda x: (x + 1.0) / (x + 1.0).sum(axis=-1, keepdims=True)
    emit = counts.emit + PRIOR * rates[:, None]
    return Hmm(share(counts.start), share(counts.resume), share(counts.move), emit / emit.sum(axis=0))


def forward_log10(model: Hmm, classes: np.ndarray, sizes: np.ndarray, chunk: int = 32) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion, all sequences abreast."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, length = starts[order], sizes[order]
    logs = np.zeros(len(order))
    a = np.tile(model.start, (len(order), 1))
    alive = len(order)
    for at in range(0, int(length[0]) if len(order) else 0, chunk):
        alive = int(np.searchsorted(-length, -at, side="left"))
        where = np.minimum(starts[:alive, None] + np.arange(at, at + chunk)[None, :], len(classes) - 1)
        emitted = model.emit[classes[where.T]]
        ends = np.searchsorted(-length[:alive], -np.arange(at, min(at + chunk, int(length[0]))), side="left")
        for t, n in enumerate(ends.tolist()):
            if at or t:
                a[:n] = a[:n] @ model.move
            a[:n] *= emitted[t, :n]
            if t % 8 == 7 or t == len(ends) - 1:
                total = a[:alive].sum(axis=1)
                logs[:alive] += np.log10(total)
                a[:alive] /= total[:, None]
    out = np.empty(len(order))
    out[order] = logs + np.log10(np.maximum(a.sum(axis=1), 1e-300)) if len(order) else logs
    return out


# --- over the cluster -------------------------------------------------------------------------------------------------


def _array(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def class_blocks(blocks: DataFrame, own: list[bytes]) -> DataFrame:
    """sizes, classes (binaries) of the training documents of each block: what a Baum-Welch pass reads."""
    shared = blocks.sparkSession.sparkContext.broadcast(own)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordClasses(shared.value)
        for batch in batches:
            for train, sizes, ids, words in zip(*batch.columns, strict=True):
                keep, length = _array(train, np.uint8) == 1, _array(sizes, "<i8")
                classes = of(words.values)[_array(ids, "<i4")[np.repeat(keep, length)]]
                if len(classes):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (length[keep].astype("<i4"), classes.astype("<u2"))], names=["sizes", "classes"])

    return saved(blocks.select("train", "sizes", "ids", "words").mapInArrow(classed, "sizes binary, classes binary"), "lm-classes")


def _summed_counts(rows: DataFrame, model: Hmm) -> Hmm:
    """Expected counts of all training texts, from the table of ``class_blocks``."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))
    k, c = model.move.shape[0], model.emit.shape[0]
    size = 2 * k + k * k + c * k

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        one, total = Hmm(*shared.value), np.zeros(size)
        for batch in batches:
            for sizes, classes in zip(*batch.columns, strict=True):
                segments = segments_of(_array(sizes, "<i4").astype(np.int64))
                total += np.concatenate([x.ravel() for x in expected_counts(one, _array(classes, "<u2"), *segments)])
        return total

    start, resume, move, emit = np.split(summed(rows, local, size), np.cumsum([k, k, k * k]))
    return Hmm(start, resume, move.reshape(k, k), emit.reshape(c, k))


def class_totals(counts: DataFrame, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and distinct words of each class."""
    shared = counts.sparkSession.sparkContext.broadcast(own)
    size = len(own) + SHARED

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        of, total = WordClasses(shared.value), np.zeros((2, size))
        for batch in batches:
            at = of(batch.column(0))
            total[0] += np.bincount(at, weights=batch.column(1).to_numpy(), minlength=size)
            total[1] += np.bincount(at, minlength=size)
        return total.ravel()

    n, v = summed(counts.select("word", "c"), local, 2 * size).reshape(2, size)
    return n, v


def train_hmm(rows: DataFrame, rates: np.ndarray, states: int = STATES, passes: int = PASSES, seed: int = 5) -> Hmm:
    """Baum-Welch over all training texts, from the table of ``class_blocks``."""
    model = first_guess(rates, states, seed)
    for _ in range(passes):
        model = reestimated(_summed_counts(rows, model), rates)
    return model


def word_spreads(blocks: DataFrame, model: Hmm, own: list[bytes]) -> DataFrame:
    """word, c, spread of every word of the training texts: its count, and its share of each state in ``LEVELS`` parts, as bytes
    of one integer (state 0 lowest). Written to the shared folder."""
    shared = blocks.sparkSession.sparkContext.broadcast((tuple(model), own))
    states = model.move.shape[0]
    if states > 8:
        raise ValueError("at most 8 states fit a spread")
    names = [f"g{s}" for s in range(states)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, own = shared.value
        one, of = Hmm(*values), WordClasses(own)
        for batch in batches:
            for train, sizes, ids, words in zip(*batch.columns, strict=True):
                keep, length = _array(train, np.uint8) == 1, _array(sizes, "<i8")
                mine, listed = _array(ids, "<i4")[np.repeat(keep, length)], words.values
                if not len(mine):
                    continue
                totals = np.zeros((states, len(listed)))
                classes = of(listed)[mine]
                for where, gamma, *_ in posteriors(one, classes, *segments_of(length[keep])):
                    flat, parts = mine[where], np.rint(gamma * LEVELS)
                    for s in range(states):
                        totals[s] += np.bincount(flat, weights=parts[:, s], minlength=len(listed))
                n = np.bincount(mine, minlength=len(listed))
                some = np.flatnonzero(n)
                columns = [listed.take(pa.array(some)), pa.array(n[some]), *(pa.array(totals[s][some].astype(np.int64)) for s in range(states))]
                for a in range(0, len(some), 1 << 15):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 1 << 15) for x in columns], names=["word", "c", *names])

    rows = blocks.select("train", "sizes", "ids", "words").mapInArrow(local, "word binary, c bigint, " + ", ".join(f"{g} bigint" for g in names))
    total = rows.groupBy("word").agg(F.sum("c").alias("c"), *(F.sum(g).alias(g) for g in names))
    whole = sum((F.col(g) for g in names), F.lit(0))
    parts = [F.shiftleft(F.round(F.col(g) * LEVELS / F.greatest(whole, F.lit(1))).cast("long"), 8 * s) for s, g in enumerate(names)]
    packed = parts[0]
    for part in parts[1:]:
        packed = packed.bitwiseOR(part)
    return saved(total.select("word", "c", packed.alias("spread")), "lm-words")


def expected_of(counts: np.ndarray, spreads: np.ndarray, states: int) -> np.ndarray:
    """Expected counts (words x states) from word counts and packed spreads."""
    shares = spreads.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :states].astype(np.float64)
    return counts[:, None] * shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)


class Emissions(NamedTuple):
    """The final emission of any word: its class's, times its share of the class in each state.

    A class that has a share r of its tokens in a state gives a word of c tokens, of which g are in the state,
    (1 - ``DRAWN``) g + ``DRAWN`` c r + 0.1 r there, and as much as a word of c = 0 to all words not seen; so a state's shares add
    up to one, and where r is the same for all words they are the add-0.1 shares.
    """

    emit: np.ndarray  # classes x states
    gathered: np.ndarray  # expected counts of each class in each state, summed from the word table
    in_class: np.ndarray
    room: np.ndarray  # what the add-0.1 counts of each class add up to
    own: int

    def __call__(self, classes: np.ndarray, counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
        rate = self.gathered / np.maximum(self.in_class, 1e-300)[:, None]
        whole = np.where(rate > 0, rate * self.room[:, None], 1.0)[classes]
        part = (1 - DRAWN) * expected + (DRAWN * counts + 0.1)[:, None] * rate[classes]
        share = np.where(rate[classes] > 0, part / whole, ((counts + 0.1) / self.room[classes])[:, None])
        return self.emit[classes] * np.where((classes < self.own)[:, None], 1.0, share)


def final_emissions(words: DataFrame, own: list[bytes], in_class: np.ndarray, kinds: np.ndarray, rates: np.ndarray, states: int) -> Emissions:
    """Emissions from the word table."""
    shared = words.sparkSession.sparkContext.broadcast(own)
    size = len(own) + SHARED

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        of, total = WordClasses(shared.value), np.zeros((states, size))
        for batch in batches:
            at, expected = of(batch.column(0)), expected_of(batch.column(1).to_numpy(), batch.column(2).to_numpy(), states)
            for s in range(states):
                total[s] += np.bincount(at, weights=expected[:, s], minlength=size)
        return total.ravel()

    gathered = np.ascontiguousarray(summed(words.select("word", "c", "spread"), local, size * states).reshape(states, size).T)
    emit = gathered + PRIOR * rates[:, None]
    room = in_class + 0.1 * np.where(np.arange(size) < len(own), 1, kinds + 1)
    return Emissions(emit / emit.sum(axis=0), gathered, in_class, room, len(own))


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score of every row; learns where ``train`` is true."""
    spark = docs.sparkSession
    blocks = Blocks(docs, train, id_col, text_col)
    files = blocks.files()
    counts = word_counts(files)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    own = [bytes(r["word"]) for r in counts.orderBy(F.desc("c"), "word").limit(OWN).collect()]
    own = own if END in own else [*own[: OWN - 1], END]
    norm = np.log10(n + 0.1 * (v + 1))
    in_class, kinds = class_totals(counts, own)
    discard(counts)
    rates = (in_class + 0.1) / (in_class + 0.1).sum()
    model = first_guess(rates, states, 5)
    if n:
        classes = class_blocks(files, own)
        model = train_hmm(classes, rates, states, passes)
        discard(classes)
    words = word_spreads(files, model, own)
    emissions = final_emissions(words, own, in_class, kinds, rates, states)
    shared = spark.sparkContext.broadcast((tuple(model), tuple(emissions), own))
    entries = files.select("block", F.posexplode("words").alias("pos", "word"))
    known = entries.join(words.hint("shuffle_hash"), "word").groupBy("block").agg(F.collect_list(F.struct("pos", "c", "spread")).alias("found"))
    met = blocks.bucketed().join(known.hint("shuffle_hash"), "block", "left")
    blocks.release()
    rows = met.select("doc_ids", "has_id", "train", "sizes", "ids", "words", F.col("found.pos").alias("pos"), F.col("found.c").alias("c"), F.col("found.spread").alias("spread"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, emission, own = shared.value
        one, emits, of = Hmm(*values), Emissions(*emission), WordClasses(own)
        for batch in batches:
            for doc_ids, has_id, train, sizes, ids, words, pos, c, spread in zip(*batch.columns, strict=True):
                names = words.values
                seen, expected = np.zeros(len(names)), np.zeros((len(names), states))
                if pos.is_valid:
                    at, count = pos.values.to_numpy(zero_copy_only=False), c.values.to_numpy(zero_copy_only=False)
                    seen[at] = count
                    expected[at] = expected_of(count, spread.values.to_numpy(zero_copy_only=False), states)
                flat, length = _array(ids, "<i4"), _array(sizes, "<i8")
                cuts = np.cumsum(length) - length
                base = np.add.reduceat(np.log10(seen + 0.1)[flat], cuts) - length * norm
                full = base
                if n:
                    full = forward_log10(one._replace(emit=emits(of(names), seen, expected)), flat, length)
                missing = _array(has_id, np.uint8) == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_array(doc_ids, "<i8"), mask=missing), pa.array(_array(train, np.uint8) == 1), pa.array(length), pa.array(np.add.reduceat((seen > 0).astype(np.int64)[flat], cuts)), pa.array(np.full(len(length), n, dtype=np.int64)), pa.array(base), pa.array(full)],
                    names=["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return rows.mapInArrow(score, "doc_id bigint, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
