"""The stored vector index against plain dense search, and the gate of its manifest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import retrieve as R
from corvane.operators import vectors as V

VECTORS = "position bigint, text_sha256 string, vector array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, f"sha{i}", v) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("block", [1024, 7])
def test_search_equals_a_scan_of_all_vectors(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "PIVOTS", 5)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8)) * 4
    x = (centres[rng.integers(5, size=400)] + rng.normal(size=(400, 8)) * 0.3).round(2)
    vectors = table(spark, [*((i, v.tolist()) for i, v in enumerate(x)), (900, None), *((1000 + i, x[3].tolist()) for i in range(9))])
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[::23] + 0.1)] + [(500, None), (501, [1.0])], "query_id bigint, vector array<float>")
    index = V.build_vectors(vectors, str(tmp_path / "v"), "m")
    assert (index.count, index.dimension) == (409, 8)
    row = lambda df: sorted((r["query_id"], r["rank"], r["position"], round(r["score"], 6)) for r in df.collect())
    assert row(V.search(index, asked, 6)) == row(R.dense_search(vectors, asked.where("query_id <> 501"), 6))


def test_blocks_out_of_reach_are_skipped(tmp_path):
    """A block whose bound is below the k-th best score is not multiplied."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    def block(centre, first):
        m = centre + rng.normal(size=(20, 4)) * 0.01
        batch = pa.RecordBatch.from_arrays([pa.array(range(first, first + 20)), pa.array(m.tolist(), pa.list_(pa.float64())), pa.array([0] * 20, pa.int32())], names=["position", "vector", "pivot"])
        return next(V._packed(iter([batch])))

    near, far = block(np.array([5.0, 0, 0, 0]), 0), block(np.array([0, 5.0, 0, 0]), 100)

    class Shared:
        value = (np.array([1]), np.array([[1.0, 0, 0, 0]]))

    got = [p for b in V._best_of(Shared, 3)(iter([near, far])) for p in b.column(1).to_pylist()]
    assert got and max(got) < 100


def test_the_manifest_gates_opening(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors = table(spark, [(i, [float(i), 1.0]) for i in range(30)])
    V.build_vectors(vectors, path, "model-a")
    texts = vectors.select("position", "text_sha256")
    assert V.open_vectors(spark, path, "model-a", texts).count == 30
    with pytest.raises(ValueError, match="model"):
        V.open_vectors(spark, path, "model-b")
    with pytest.raises(ValueError, match="other texts"):
        V.open_vectors(spark, path, "model-a", texts.withColumn("text_sha256", F.lit("x")))
    spark.read.parquet(f"{path}/manifest").withColumn("count", F.lit(31).cast("bigint")).write.parquet(f"{path}2/manifest")
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{path}2/blocks")
    with pytest.raises(ValueError, match="30 of 31"):
        V.open_vectors(spark, f"{path}2", "model-a")


@pytest.mark.parametrize("rows", [[(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0, float("nan")])], [(1, [1.0, None])]])
def test_odd_vectors_are_refused(spark, tmp_path, rows):
    with pytest.raises(ValueError, match="finite and of one size"):
        V.build_vectors(table(spark, rows), str(tmp_path / "v"), "m")


def test_an_empty_index(spark, tmp_path):
    index = V.build_vectors(table(spark, [(1, [1.0])]).where("false"), str(tmp_path / "v"), "m")
    assert index.count == 0 and V.search(index, spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<float>")).count() == 0
