"""Fingerprints, validation and comparison of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import text_sha256


def row_digests(df: DataFrame, order: list[str], *columns: str) -> DataFrame:
    """The order columns and a SHA-256 of each row's canonical JSON."""
    row = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.select(*order, text_sha256(row).alias("digest"))


def snapshot_digest(df: DataFrame, order: list[str], *columns: str, buckets: int = 256) -> DataFrame:
    """One row, ``n_rows`` and ``digest``: equal only for equal sets of rows, whatever the partitioning.

    A tree of digests: rows hash alone, then sorted within ``buckets`` by their hash, then the buckets in order; so no task
    holds more than a bucket's row digests.
    """
    rows = row_digests(df, [], *dict.fromkeys([*order, *columns])).withColumn("bucket", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    middle = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("d"))
    return middle.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def checks(*found: tuple[str, DataFrame, Column, int]) -> DataFrame:
    """name, expected, actual, ok for (name, table, aggregate, expected value)."""
    out: DataFrame | None = None
    for name, df, aggregate, expected in found:
        row = df.agg(aggregate.cast("long").alias("actual")).select(F.lit(name).alias("name"), F.lit(expected).cast("long").alias("expected"), "actual", (F.col("actual") == expected).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def tree_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths whose (size, sha256) differ or that only one side has."""
    e, a = (d.select("path", F.struct("size", "sha256").alias(n)) for d, n in ((expected, "e"), (actual, "a")))
    return e.join(a, "path", "full_outer").where(~F.col("e").eqNullSafe(F.col("a"))).select("path", F.when(F.col("e").isNull(), "extra").when(F.col("a").isNull(), "missing").otherwise("changed").alias("problem"))


def symbol_drift(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Positions whose sidecar record is missing, extra, or of another text."""
    c = chunks.select("position", text_sha256(F.col("text")).alias("now"))
    r = records.select("position", F.col("text_sha256").alias("then"))
    return c.join(r, "position", "full_outer").where(~F.col("now").eqNullSafe(F.col("then"))).select("position")
