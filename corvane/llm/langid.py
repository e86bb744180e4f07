"""Operator 7: language identification by error-correcting output codes.

Each language has a binary codeword; each bit has a binary classifier over hashed character n-grams, which says on which
side of the bit a text's language lies. Its weights are log odds of the n-grams on the two sides, from counts over all
training texts. Decoding sums, for each language, the losses of all bits against its codeword, each bit weighted by how
well it did on the training counts; the nearest codeword wins, and a text whose two nearest are too close is ambiguous.

Training is one pass over the texts: tasks add up n-gram counts by language and hand them on before they hold more than
``HELD`` languages; counts meet by language and piece of the buckets, and stay a table. Folds over that table give the
weights: sums of bits x buckets and of languages x bits reach the driver, whatever the input, and weights go back as a
broadcast of bits x buckets. Scoring is a projection over whole texts, in slices.

Cases: a text that is null, empty or without a letter (``str.isalpha``) is ``und`` with score 0. Rates are smoothed alike for
all languages, so an n-gram that none has says nothing: a text of such n-grams only gets the language with the most
training n-grams (ties: the first in text order), as does any tie of losses, and is ambiguous. Rows without a language don't
train. Without any training row every text is ``und``; with one language, every text with a letter is that one. Repeated rows
count and are judged each. Other columns are not read, or pass in ``keep_known``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.llm._shared import discard, saved, summed, text_batches

BUCKETS = 1 << 15
PIECES = 8
GRAMS = (1, 2, 3)
HELD = 64
SMOOTHING = 0.01
UNKNOWN = "und"
AMBIGUOUS_MARGIN = 0.02
_SLICE = 1 << 20
_PLAIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_PLAIN_LETTER.search(text)) or any(map(str.isalpha, text))


def codewords(languages: int) -> np.ndarray:
    """A +-1 matrix of languages x bits: exhaustive for up to 6 languages, else spread pseudo-random words."""
    if languages <= 1:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 6:
        columns = [c for c in product((1, -1), repeat=languages) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.int8).T
    rng, bits = np.random.default_rng(languages), 15 * int(np.ceil(np.log2(languages)))
    if languages > 512:  # so many bits that random words are far apart without a search
        return rng.choice(np.array([1, -1], dtype=np.int8), size=(languages, bits))
    best, width = None, -1
    for _ in range(50):
        words = rng.choice(np.array([1, -1], dtype=np.int8), size=(languages, bits))
        apart = (bits - words.astype(int) @ words.T.astype(int)) // 2 + bits * np.eye(languages, dtype=int)
        split = (np.abs(words.sum(axis=0)) < languages).all()
        if split and apart.min() > width:
            best, width = words, apart.min()
    return best


def gram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket of every byte n-gram of a text in lower case, slice by slice."""
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    mask = np.uint32(buckets - 1)
    longest = max(GRAMS)
    for at in range(0, len(raw), _SLICE):
        part = raw[at : at + _SLICE + longest - 1].astype(np.uint32)
        for n in GRAMS:
            code = np.full(max(0, min(len(part) - n + 1, _SLICE)), n, dtype=np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ part[k : k + len(code)]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield (code ^ (code >> np.uint32(13))) & mask


class LanguageModel(NamedTuple):
    languages: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, float32
    trust: np.ndarray  # bits

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds of a text's n-grams for each bit."""
        total, n = np.zeros(self.words.shape[1]), 0
        for found in gram_buckets(text, len(self.weights)):
            if len(found) < len(self.weights) // 8:
                total += self.weights[found].sum(axis=0, dtype=np.float64)
            else:
                total += np.bincount(found, minlength=len(self.weights)) @ self.weights
            n += len(found)
        return total / max(1, n)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = np.clip(self.margins(text), -4, 4)
        loss = np.log1p(np.exp(-4 * self.words * margins)) @ self.trust
        best = int(np.argmin(loss))
        share = np.exp(loss.min() - loss)
        score = float(1 / share.sum())
        second = np.partition(loss, 1)[1]
        return self.languages[best], score, bool((second - loss[best]) / max(loss.max(), 1e-12) < AMBIGUOUS_MARGIN)


def language_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece, counts (binary of bigints), total of every language and piece of the buckets, in the shared folder."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).dropna()
    kind, names = "lang string, piece int, counts binary, total bigint", ["lang", "piece", "counts", "total"]

    def handed(totals: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.int32()), pa.array([v.astype("<i8").tobytes() for v in totals.values()], pa.binary()), pa.array([int(v.sum()) for v in totals.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        pieces = lambda: handed({(lang, k): part for lang, total in totals.items() for k, part in enumerate(np.split(total, PIECES))})
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in totals:
                    if len(totals) == HELD:
                        yield pieces()
                        totals.clear()
                    totals[lang] = np.zeros(BUCKETS, dtype=np.int64)
                for found in gram_buckets(text):
                    totals[lang] += np.bincount(found, minlength=BUCKETS)
        if totals:
            yield pieces()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for lang, piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(raw.as_buffer(), dtype="<i8")
                if (lang, piece) != key:
                    if key is not None:
                        yield handed({key: total})
                    key, total = (lang, piece), part
                else:
                    total = total + part
        if key is not None:
            yield handed({key: total})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.mapInArrow(count, kind).repartition(parts, "lang", "piece").sortWithinPartitions("lang", "piece")
    return saved(met.mapInArrow(add, kind), "lang-counts")


def train_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the languages of ``docs``, from all its rows that have a text and a language; a language counts alike
    however much text it has."""
    counts = language_counts(docs, text_col, lang_col)
    found = counts.groupBy("lang").agg(F.sum("total").alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in found]
    words = codewords(len(languages))
    if not languages:
        return LanguageModel([], words, np.zeros((BUCKETS, 1), dtype=np.float32), np.ones(1))
    bits, width = words.shape[1], BUCKETS // PIECES
    places = {r["lang"]: (k, max(1, r["n"])) for k, r in enumerate(found)}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((places, words))
    rows = counts.select("lang", "piece", "counts")

    def rates(batch: pa.RecordBatch, places: dict) -> Iterator[tuple[int, slice, np.ndarray]]:
        for lang, piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            k, n = places[lang]
            yield k, slice(piece * width, (piece + 1) * width), (1 - SMOOTHING) * np.frombuffer(raw.as_buffer(), dtype="<i8") / n + SMOOTHING / BUCKETS

    def sides(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        places, words = shared.value
        total = np.zeros((2, bits, BUCKETS))
        for batch in batches:
            for k, at, rate in rates(batch, places):
                for b in range(bits):
                    total[int(words[k, b] < 0), b, at] += rate
        return total.ravel()

    above, below = summed(rows, sides, 2 * bits * BUCKETS).reshape(2, bits, BUCKETS)
    mean = lambda total, members: np.maximum(total / np.maximum(members, 1)[:, None], 1e-12)
    weights = (np.log(mean(above, (words > 0).sum(axis=0))) - np.log(mean(below, (words < 0).sum(axis=0)))).T
    weights[np.abs(weights) < 1e-9] = 0.0
    given = spark.sparkContext.broadcast(weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        (places, words), weights = shared.value, given.value
        total = np.zeros(words.shape)
        for batch in batches:
            for k, at, rate in rates(batch, places):
                total[k] += rate @ weights[at]
        return total.ravel()

    # How far each bit's classifier puts the languages on their own sides.
    margin = summed(rows, margins, words.size).reshape(words.shape) * words
    discard(counts)
    trust = np.clip(margin.min(axis=0), 1e-3, None)
    return LanguageModel(languages, words, weights.astype(np.float32), trust / trust.sum() * bits)


def language_column(model: LanguageModel, docs: DataFrame, text_col: str = "text") -> Column:
    """struct<lang_pred string, score double, ambiguous boolean> of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    text_batches(docs.sparkSession)

    @arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = LanguageModel(*shared.value)
        for batch in batches:
            rows = [one.decode(t) for t in batch.to_pylist()]
            lang, score, unsure = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["lang_pred", "score", "ambiguous"])

    return predict(F.col(f"`{text_col}`"))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), language_column(model, docs, text_col).alias("found")).select("doc_id", "found.*")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is unknown (``und``)."""
    found = language_column(model, docs, text_col)
    return docs.where(found.getField("lang_pred") != UNKNOWN)
