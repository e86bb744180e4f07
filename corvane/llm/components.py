"""Connected components of a link table, by repeated minima and pointer jumping on DataFrames.

Labels start as the node itself. A round gives each node the least label among itself and its neighbours, then the label
of that label; rounds go on until none changes. A component of diameter d takes about log d rounds. Only nodes that have
links take part. Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.

Tables are written in files of about ``ROWS`` rows, however many partitions the session shuffles into.

A node with very many links (the centre of a star) is no hot spot: its links are summed to a minimum before the shuffle,
and joins on it are inner or left joins of two shuffled sides, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import discard, saved

ROWS = 200_000


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (least node reachable) for every node of ``links``; null ends are dropped, self-links allowed."""
    pairs = links.select(F.col(f"`{left}`").alias("a"), F.col(f"`{right}`").alias("b")).dropna()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), "links")
    parts = both.count() // ROWS + 1
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node").coalesce(parts), "labels")
    done, last = False, labels
    while not done:
        reached = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(reached.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        nearer = saved(nearer.coalesce(parts), "near")
        jumped = nearer.join(nearer.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        new = saved(jumped.select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")).coalesce(parts), "labels")
        discard(last, nearer)
        done, labels, last = new.where("label <> old").isEmpty(), new.select("node", "label"), new
    discard(both)
    return labels.withColumnRenamed("label", "component")
