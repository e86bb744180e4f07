"""Operator 10: exact top-k inner products by columnar branch and bound.

Components are quantised to integers, so scores are exact. Candidates of a batch lie in a vertical layout (dimension by
row), dimensions in order of falling variance. A query adds up its scores block of dimensions by block; after each block
a candidate can gain at most |query rest| x |candidate rest| (Cauchy-Schwarz on the remaining mass), so those that cannot
reach the k-th score so far are dropped and the survivors compacted. A bound equal to that score survives, which keeps
ties whole.

Scale: candidates are scanned where they lie, each task returns k rows a query, so the shuffle is tasks x queries x k rows, cut
to k before it by a window that Spark limits on the map side. Queries go to the tasks in blocks of at most ``QUERY_BLOCK``
rows and ``QUERY_BYTES`` (a bounded broadcast, which holds vectors of any sizes). With more than one block the quantised
candidates are written once and scanned again for each, and each block's rows are written before the next block starts;
comparing all queries with all rows is the cost in any case, and every scan has all tasks at work.

Cases: vectors that are null, empty, or hold null or non-finite components (also after the factor), or whose size differs from
the query's, take no part; a row without an id neither. Sums are exact at any size: in doubles below 2^52, else in Python
integers; a score beyond a bigint is given as the nearest bigint, after ranking by the exact value. Repeated ids are
candidates each (a query's own id is left out whole); ties go to the smaller id. Rows of one id with different vectors are
queries each, with one vector a single query. Other columns are not read. No rows or no queries: no results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._shared import discard, saved

QUERY_BLOCK = 4096
QUERY_BYTES = 1 << 23
DIMS = 16
ROWS = 4096
SCALE = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v: floor(scale * x) of each usable vector, as integers in an ``array<double>``."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    some = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    # x * scale - x * scale is zero unless the product is infinite or no number.
    wide = some.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: x * scale).alias("v"))
    fine = wide.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # floor() gives a bigint, which large doubles exceed; these have no fraction.
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(F.when(F.abs(x) < float(1 << 53), x).otherwise(0.0)).cast("double")).otherwise(x)
    return fine.select("id", F.transform("v", whole).alias("v"))


class BlockSearch:
    """Best k candidates so far of each query, over candidate blocks that are added one after another."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, exact: bool) -> None:
        # Integers are exact in doubles below 2^53; beyond that, Python integers take over.
        kind = np.float64 if exact else object
        self.ids, self.k, self.kind = ids, k, kind
        with np.errstate(all="ignore"):
            order = np.argsort(-queries.var(axis=0), kind="stable")
        self.order, self.queries = order, self._numbers(queries[:, order])
        d = queries.shape[1]
        self.cuts = [(a, min(d, a + DIMS)) for a in range(0, d, DIMS)]
        self.rest = self._rests(self.queries)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=kind), np.empty(0, dtype=np.int64)) for _ in ids]

    def _numbers(self, rows: np.ndarray) -> np.ndarray:
        return rows if self.kind is np.float64 else np.frompyfunc(int, 1, 1)(rows).astype(object)

    def _rests(self, rows: np.ndarray) -> list[np.ndarray]:
        """Length of each row beyond each block, rounded up (infinite if a double can't hold it)."""
        with np.errstate(over="ignore"):
            squares = rows.astype(np.float64) ** 2
            return [np.sqrt(squares[:, b:].sum(axis=1)) * (1 + 1e-9) for _, b in self.cuts]

    def _reach(self, partial: np.ndarray, rest: np.ndarray, floor) -> np.ndarray:
        """Which candidates may still come to the k-th score; doubles carry a margin for their rounding."""
        if self.kind is np.float64:
            return partial + rest + 1e-6 >= floor
        sure = np.array([math.inf if r != r or r > 1e300 else r for r in rest.tolist()])
        return np.array([r == math.inf or p + (int(r) + 1) >= floor for p, r in zip(partial.tolist(), sure.tolist(), strict=True)], dtype=bool)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        rows = self._numbers(rows[:, self.order])
        rests, columns = self._rests(rows), np.ascontiguousarray(rows.T)
        a, b = self.cuts[0]
        first = self.queries[:, a:b] @ columns[a:b] if self.kind is not object else np.dot(self.queries[:, a:b], columns[a:b])
        for q in range(len(self.ids)):
            scores, names = self.best[q]
            floor = scores[-1] if len(scores) == self.k else None
            alive, partial = np.flatnonzero(ids != self.ids[q]), None
            for block, (a, b) in enumerate(self.cuts):
                gain = first[q][alive] if block == 0 else self.queries[q, a:b] @ columns[a:b, alive]
                partial = gain if partial is None else partial + gain
                if floor is not None:
                    with np.errstate(all="ignore"):
                        keep = self._reach(partial, self.rest[block][q] * rests[block][alive], floor)
                    if not keep.all():
                        alive, partial = alive[keep], partial[keep]
                    if not len(alive):
                        break
            if len(alive):
                scores, names = np.concatenate([scores, partial]), np.concatenate([names, ids[alive]])
                if len(scores) > 4 * self.k and self.kind is np.float64:
                    near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                    scores, names = scores[near], names[near]
                if self.kind is np.float64:
                    top = np.lexsort((names, -scores))[: self.k]
                else:
                    top = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], names[i]))[: self.k])
                self.best[q] = scores[top], names[top]


def _matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given size, and which they are."""
    lengths = np.diff(column.offsets.to_numpy())
    fit = lengths == size
    flat = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size), fit


_LONG = (1 << 63) - 1
_FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint, above string"


def _scan(shared, k: int, exact: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {size: (numbers, BlockSearch(ids, rows, k, exact)) for size, (numbers, ids, rows) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                for size, (_, search) in searches.items():
                    vectors, fit = _matrix(some.column(1), size)
                    if len(vectors):
                        search.add(some.column(0).to_numpy()[fit], vectors)
        for numbers, search in searches.values():
            for number, query, (scores, names) in zip(numbers, search.ids.tolist(), search.best, strict=True):
                if n := len(scores):
                    values = [int(x) for x in scores]
                    near = pa.array([max(-_LONG - 1, min(_LONG, x)) for x in values], pa.int64())
                    # Scores that a bigint can't hold are told apart by sign and digits in an order of text.
                    above = pa.array([None if -_LONG <= x <= _LONG else _sortable(x) for x in values], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([number] * n), pa.array([query] * n), pa.array(names), near, above], names=[x.split()[0] for x in _FOUND.split(", ")])

    return scan


def _sortable(x: int) -> str:
    """Text in the order of integers of the same sign: the number of digits, then the digits (their complement below zero)."""
    digits = f"{abs(x):d}"
    text = f"{len(digits):06d}{digits}"
    return text if x >= 0 else "".join(str(9 - int(c)) for c in text)


def _query_blocks(asked: DataFrame) -> Iterator[dict[int, tuple[list[int], np.ndarray, np.ndarray]]]:
    """Blocks of queries by vector size: numbers, ids and vectors."""
    held: dict[int, tuple[list[int], list[int], list[list[float]]]] = {}
    rows = total = nth = 0
    pack = lambda: {size: (numbers, np.array(ids), np.array(block, dtype=np.float64).reshape(len(ids), size)) for size, (numbers, ids, block) in held.items()}
    for row in asked.toLocalIterator():
        numbers, ids, block = held.setdefault(len(row["v"]), ([], [], []))
        numbers.append(nth)
        ids.append(row["id"])
        block.append(row["v"])
        rows, total, nth = rows + 1, total + 8 * len(row["v"]), nth + 1
        if rows >= QUERY_BLOCK or total >= QUERY_BYTES:
            yield pack()
            held.clear()
            rows = total = 0
    if held:
        yield pack()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors``, itself left out."""
    rows, asked = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale).distinct()
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    mine = asked.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()
    exact = largest[0] is None or mine[0] is None or largest[0] * mine[0] * largest[1] < 1 << 52
    spark = vectors.sparkSession
    found: list[DataFrame] = []
    blocks = _query_blocks(asked)
    block = next(blocks, None)
    stored = None
    while block is not None:
        after = next(blocks, None)
        if after is not None and stored is None:
            stored = rows = saved(rows, "vectors")
        part = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), k, exact), _FOUND)
        found.append(saved(part, "topk") if after is not None or found else part)
        block = after
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if stored is not None:
        discard(stored)
    every = found[0] if len(found) == 1 else spark.read.schema(_FOUND).parquet(*(df._scratch for df in found))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last("above"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
