"""Operator 2: quality classifier.

Statistics of a whole text (``text_statistics``) are standardised and mapped to random Fourier features, which approximate
a Gaussian kernel. Ridge scores solve the normal equations, whose sums (features x features) each task adds up for its
partition, so one small matrix a task meets in the shuffle, in a few binary rows, whatever the input. Scores are calibrated by isotonic
regression over a fixed grid of score bins, again from partition sums, with pool-adjacent-violators on the driver.

Scale: texts are read once and become ``len(STATISTICS)`` doubles; labels meet those, not the texts. The seed, kernel width
and ridge are parameters; nothing is sampled or capped.

Cases: a null text counts as empty; an empty or white-space text gets the score of its statistics, which are zeros. Labels
that are null or neither 0 nor 1 are not learnt from; several labels of one document count each. Without labels, or with labels of one kind
only, every score is that kind's rate (0.5 without any). Repeated rows are scored each. Very long texts are read whole.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.llm._shared import saved, summed, text_batches

FEATURES = 192
WIDTH = 6.0
RIDGE = 1.0
SEED = 20
BINS = 512

STATISTICS = [
    "log_chars", "log_words", "word_length", "upper", "lower", "digit", "space", "punctuation", "other", "line_length",
    "distinct_words", "distinct_lines", "top_word", "exclaim", "bar", "bracket", "ends_clean", "capital_words", "long_words",
    "word_entropy", "symbol_words", "line_words",
]
_UPPER, _LOWER = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿ]+")
_DIGIT, _SPACE, _PUNCT = re.compile(r"\d+"), re.compile(r"\s+"), re.compile(r"[.,;:!?'\"()-]+")


def _amount(pattern: re.Pattern[str], text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def text_statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for one text; zeros if it has no word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, k = len(text), len(words)
    lines = [line for line in text.split("\n") if line]
    counts = Counter(words)
    ascii_text = text.isascii()
    upper, lower, digit, space, punct = (_amount(p, text) for p in (_UPPER, _LOWER, _DIGIT, _SPACE, _PUNCT))
    letters = sum(map(len, words))
    return [
        math.log1p(n), math.log1p(k), letters / k, upper / n, lower / n, digit / n, space / n, punct / n,
        (n - upper - lower - digit - space - punct) / n * (2.0 if ascii_text else 1.0),
        math.log1p(n / max(1, len(lines))), len(counts) / k, len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / k, text.count("!") / k, (text.count("|") + text.count("\t")) / k,
        sum(map(text.count, "{}[]<>=\\/#@$%^&*_~+")) / k, float(text.rstrip()[-1:] in ".!?"),
        sum(w[:1].isupper() for w in counts) / len(counts), sum(len(w) > 20 for w in counts) / len(counts),
        -sum(c / k * math.log(c / k) for c in counts.values()) / math.log(k + 1),
        sum(not any(map(str.isalnum, w)) * c for w, c in counts.items()) / k, math.log1p(k / max(1, len(lines))),
    ]


def statistics_column(text: Column) -> Column:
    text_batches()

    @arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([text_statistics(t) for t in batch.to_pylist()], pa.list_(pa.float64()))

    return of(text)


class FourierMap(NamedTuple):
    """cos(standardised x . directions + phase), and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.directions + self.phase), np.ones((len(x), 1))])


def fourier_map(mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> FourierMap:
    rng = np.random.default_rng(seed)
    return FourierMap(mean, scale, rng.normal(size=(len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features))


class QualityModel(NamedTuple):
    to_features: FourierMap | None
    weights: np.ndarray
    edges: np.ndarray  # raw scores at which the calibrated score is given
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.to_features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.to_features is None:
            return np.full(len(x), self.levels[0])
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0, 1)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column(1).to_numpy(zero_copy_only=False).astype(float)


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sums of the vector ``of(x, y)`` (``size`` long) over all rows."""
    width = len(STATISTICS)

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += of(*_rows(batch.slice(at, 4096), width))
        return total

    return summed(rows, local, size)


def train_quality(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> QualityModel:
    """A model from rows of (stats ``array<double>``, label 0 or 1)."""
    rows = rows.select("stats", F.col("label").cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col("stats").isNotNull())
    k = len(STATISTICS)
    m = _summed(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)]), 2 + 2 * k)
    n, positive = m[0], m[1]
    if n == 0 or positive in (0, n):
        return QualityModel(None, np.zeros(0), np.zeros(1), np.array([0.5 if n == 0 else positive / n]))
    mean = m[2 : 2 + k] / n
    scale = np.sqrt(np.maximum(m[2 + k :] / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    to = fourier_map(mean, scale, features, width, seed)
    d = features + 1
    # Both labels weigh alike, so the rarer one is not drowned.
    weight = np.array([n / (2 * (n - positive)), n / (2 * positive)])

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f, w = to(x), weight[y.astype(int)]
        return np.concatenate([(f.T @ (f * w[:, None])).ravel(), f.T @ (w * y)])

    sums = _summed(rows, normal, d * d + d)
    gram = sums[: d * d].reshape(d, d)
    weights = np.linalg.solve(gram + ridge * np.eye(d), sums[d * d :])
    raw = QualityModel(to, weights, np.zeros(1), np.zeros(1))
    grid = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(grid, raw.raw(x)) - 1, 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    bins = _summed(rows, binned, 2 * BINS)
    count, good = bins[:BINS], bins[BINS:]
    full = count > 0
    levels = pool_adjacent(good[full] / count[full], count[full])
    return QualityModel(to, weights, ((grid[1:] + grid[:-1]) / 2)[full], levels)


def score_quality(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``rows`` with a column score from their column stats."""
    shared = rows.sparkSession.sparkContext.broadcast((tuple(model.to_features) if model.to_features else None, *model[1:]))
    width = len(STATISTICS)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to, *rest = shared.value
        one = QualityModel(FourierMap(*to) if to else None, *rest)
        for batch in batches:
            yield pa.array(one.score(batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))

    return rows.withColumn("score", score("stats"))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats of every row, written to the shared folder so that texts are read once."""
    return saved(docs.select(F.col(f"`{id_col}`").alias("doc_id"), statistics_column(F.col(f"`{text_col}`")).alias("stats")), "stats")
