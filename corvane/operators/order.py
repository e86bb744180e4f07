"""Corpus order: positions of rows in a total order, found by all tasks together.

Rows are range-partitioned and sorted by their order; a row's position is its place in its partition and the rows of all
partitions before. Only one count a partition is gathered, so no task sees all rows, as it would in a window without keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import scratch


def with_positions(df: DataFrame, *order: str, name: str = "position", first: int = 0) -> DataFrame:
    """``df`` with ``name``: the place of each row, from ``first`` on, by the columns ``order`` (nulls first).

    Rows that are equal in ``order`` have places next to each other in any order, so it should name a key. A column called
    ``name`` is replaced, unless it is in ``order``. The table is written once to the shared folder, since the limits of
    ranges are sampled and must be the same for the counts and the rows.
    """
    if not order:
        raise ValueError("positions need an order")
    spark = df.sparkSession
    kept = [c for c in df.columns if c != name]
    by = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The last column of the ranges spreads rows that are equal in the order; within a partition it doesn't matter.
    spread = df.withColumn("__spread", F.monotonically_increasing_id())
    placed = spread.repartitionByRange(parts, *by, "__spread").sortWithinPartitions(*by).select(*(F.col(f"`{c}`") for c in kept), F.monotonically_increasing_id().alias("__place"))
    rows = scratch.written(placed, "ordered").withColumn("__part", F.shiftright("__place", 33))
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # one row a partition: a bounded broadcast
    position = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + first
    return rows.join(F.broadcast(offsets), "__part").select(*(F.col(f"`{c}`") for c in kept), position.alias(name))
