"""A stored vector index: blocks of near vectors with a centre and a radius, and a manifest that gates opening.

Building assigns each vector to the nearest of ``PIVOTS`` pivots (the vectors whose positions have the least hashes), sorts
by pivot and nearness over the cluster, and packs runs of up to ``BLOCK`` vectors into one row. For any vector v of a block,
q.v <= q.c + |q| r, so a search skips a block for every question whose k-th best score so far is above that bound. Skipping
is exact; how much it skips depends on how the vectors cluster.

The manifest has the dimension, the number of vectors, the name of the model and a digest of (position, text hash), and an
index is opened only for the same model and, where given, the same texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import retrieve as R

PIVOTS, BLOCK = 64, 1024
_BLOCKS = "n int, positions binary, matrix binary, centre binary, radius double"


class VectorIndex(NamedTuple):
    blocks: DataFrame
    dimension: int
    count: int
    model: str


def _digest(texts: DataFrame) -> tuple[int, int]:
    """Of a table (position, text_sha256): its rows, and the xor of their hashes."""
    row = texts.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("position", "text_sha256")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def build_vectors(vectors: DataFrame, path: str, model: str) -> VectorIndex:
    """Writes the index of ``vectors`` (position, text_sha256, vector) and opens it. Null vectors are left out; vectors of several
    sizes, or with elements that are null or not finite, are an error."""
    spark = vectors.sparkSession
    rows = vectors.select("position", "text_sha256", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sizes = rows.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count_if(~fine).alias("odd")).first()
    if sizes["odd"] or sizes["least"] != sizes["most"]:
        raise ValueError("vectors must be finite and of one size")
    dimension = sizes["most"] or 0
    chosen = rows.orderBy(F.xxhash64("position"), "position").limit(PIVOTS).select("vector").collect()  # PIVOTS vectors
    pivots = spark.sparkContext.broadcast(np.array([r["vector"] for r in chosen], dtype=np.float64).reshape(len(chosen), dimension))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension)
            score = matrix @ pivots.value.T
            best = score.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(-score[np.arange(len(best)), best])], names=["position", "vector", "pivot", "far"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["pivot", "far", "position"]
    near = rows.select("position", "vector").mapInArrow(placed, "position bigint, vector array<double>, pivot int, far double") if dimension else rows.select("position", "vector", F.lit(0).alias("pivot"), F.lit(0.0).alias("far"))
    near.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("position", "vector", "pivot").mapInArrow(_packed, _BLOCKS).write.parquet(f"{path}/blocks")
    n, digest = _digest(rows)
    spark.createDataFrame([(dimension, n, model, digest)], "dimension int, count bigint, model string, digest bigint").write.parquet(f"{path}/manifest")
    return open_vectors(spark, path, model)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (position, vector, pivot) as blocks of one pivot."""
    held: list[np.ndarray] = []
    positions: list[int] = []
    own = None

    def block() -> pa.RecordBatch:
        matrix = np.array(held)
        centre = matrix.mean(axis=0)
        radius = float(np.sqrt(((matrix - centre) ** 2).sum(axis=1)).max())
        values = [len(held), np.array(positions, dtype="<i8").tobytes(), matrix.astype("<f8").tobytes(), centre.astype("<f8").tobytes(), radius]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        held.clear()
        positions.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["n", "positions", "matrix", "centre", "radius"])

    for batch in batches:
        for position, vector, pivot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if held and (pivot != own or len(held) == BLOCK):
                yield block()
            own = pivot
            held.append(vector.values.to_numpy(zero_copy_only=False))
            positions.append(position)
    if held:
        yield block()


def open_vectors(spark: SparkSession, path: str, model: str, texts: DataFrame | None = None) -> VectorIndex:
    """The index at ``path``; raises unless it was built with ``model``, holds every vector that it names and, if ``texts``
    (position, text_sha256) is given, was built from these."""
    row = spark.read.parquet(f"{path}/manifest").first()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    if row["model"] != model:
        raise ValueError(f"the index was built with model {row['model']}, not {model}")
    held = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if held != row["count"]:
        raise ValueError(f"the index holds {held} of {row['count']} vectors")
    if texts is not None and _digest(texts) != (row["count"], row["digest"]):
        raise ValueError("the index was built from other texts")
    return VectorIndex(blocks, row["dimension"], row["count"], model)


def search(index: VectorIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """``retrieve.dense_search`` over a stored index. Questions of another size find nothing."""
    R.require(k, "top_k")
    spark = queries.sparkSession
    every: DataFrame | None = None
    for ids, asked in R._query_blocks(queries):
        if asked.shape[1] == index.dimension:
            found = index.blocks.mapInArrow(_best_of(spark.sparkContext.broadcast((ids, asked)), k), "query_id bigint, position bigint, score double")
            every = found if every is None else every.unionByName(found)
    if every is None:
        every = spark.createDataFrame([], "query_id bigint, position bigint, score double")
    return R.top_k(every, k, F.desc(F.round("score", 6)), F.col("position")).select("query_id", "rank", "score", "position")


def _best_of(shared, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        norms = np.sqrt((asked**2).sum(axis=1))
        top = np.full((len(ids), k), -np.inf)
        for batch in batches:
            for row in batch.to_pylist():
                # Scores are ranked on six decimals, so whatever may round to the k-th best goes on.
                floor = top[:, -1] - 2e-6
                open_ = np.flatnonzero(asked @ np.frombuffer(row["centre"], dtype="<f8") + norms * row["radius"] + 1e-9 >= floor)
                if not len(open_):
                    continue
                scores = asked[open_] @ np.frombuffer(row["matrix"], dtype="<f8").reshape(row["n"], -1).T
                query, place = np.nonzero(scores >= floor[open_][:, None])
                if len(query):
                    positions = np.frombuffer(row["positions"], dtype="<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(ids[open_[query]]), pa.array(positions[place]), pa.array(scores[query, place])], names=["query_id", "position", "score"])
                top[open_] = -np.sort(-np.concatenate([top[open_], scores], axis=1), axis=1)[:, :k]

    return scan
