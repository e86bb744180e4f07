"""Operator 4 (native): corpus-wide line deduplication over levelled sorted runs of line hashes.

Lines become 128-bit hashes of their keys.

1. Counting. Lines are summed by hash before they move; hashes with fewer lines than ``min_docs`` cannot matter. The
   lines of the others are counted by distinct document, which leaves the frequent hashes.
2. Keeping. Lines of frequent hashes come in batches of documents, the largest document ids first. ``LineRuns`` holds, as
   a log-structured merge tree does, sorted runs of the hashes that earlier batches hold, in levels, as tables bucketed and
   sorted by hash. A batch's hashes merge-anti-join every run; those in none of them are held by no larger document, so the
   batch's largest document keeps them, and they become the batch's own run. When a level has ``FANOUT`` runs, they are
   compacted into one of the next level. A run with as many buckets as there are shuffle partitions is joined where it
   lies; one with fewer is read as plain files and its hashes are shuffled. Spark sorts a run again for each join.
3. A line of a frequent hash stays only where (hash, document) is in a run; the positions of the others meet their texts.

Everything is DataFrame and SQL functions. Scale: texts are read twice and shuffled once, in a join that sorts and spills.
Hashes that hold more than a ``HEAVY``-th of all lines, of which there can be at most ``HEAVY``, are the only thing broadcast;
without them no key of the shuffle that looks for frequent hashes has more lines than that share. Runs have one row a
hash, and the last joins go by (hash, document) and by document, so a line that every document holds makes no hot key.

Cases: a null or empty text is one empty line. Rows of one document id count as one document; each keeps its own row.
A null id is a document of its own, smaller than any other. Keys shorter than ``min_chars`` code points never go. Very
long texts are split whole. Ids are numbers or dates. Other columns pass unchanged in ``drop_lines`` even if named like an
internal column. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._shared import LOWER, SPACE, UPPER, delete_path, discard, saved, scratch_path

BATCHES = 4
FANOUT = 3
HEAVY = 10_000
BUCKET_ROWS = 100_000
MIN_CHARS = 40
MIN_DOCS = 5
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(bare) == F.length(bare)  # ASCII alone: the fast function does the same
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_count(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, text_hash, pos, h1, h2 of every line whose key is long enough."""
    text = F.col(f"`{text_col}`")
    lines = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(text)).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, top): the hashes seen so far, and the document that keeps each."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, rows: int | None = None) -> None:
        """``rows``: how many lines will be added at most, if that is known; a bucket then holds ``BUCKET_ROWS`` or more."""
        self.spark, self.fanout = spark, fanout
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.buckets = parts if rows is None else min(parts, rows // BUCKET_ROWS + 1)
        self.levels: list[list[str]] = []
        self.root = scratch_path(spark, "runs")

    def _write(self, rows: DataFrame) -> str:
        name = f"corvane_run_{uuid.uuid4().hex}"
        dealt = rows.select(*HASH, "top").repartition(self.buckets, *HASH).sortWithinPartitions(*HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def runs(self) -> list[DataFrame]:
        """Every run as a bucketed table."""
        return [self.spark.table(name) for name in self._names()]

    def _every(self, names: list[str]) -> DataFrame:
        """The rows of some runs. They are read as plain files: a union of bucketed tables claims their partitioning but
        doesn't have it when it runs on columnar batches (Spark 4.1), so what follows would leave keys apart."""
        return self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*(f"{self.root}/{name}" for name in names))

    def add(self, batch: DataFrame) -> None:
        """Adds lines (columns doc, h1, h2) of documents that are smaller than those of all earlier batches."""
        fresh = batch.groupBy(*HASH).agg(F.max("doc").alias("top"))
        for run in self.runs():
            fresh = fresh.join(run.select(*HASH), HASH, "left_anti")
        self._place(0, self._write(fresh))

    def _place(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._write(self._every(full)))
            for n in full:
                self.spark.sql(f"DROP TABLE {n}")
                delete_path(self.spark, f"{self.root}/{n}")

    def keepers(self) -> DataFrame:
        """h1, h2, top over all batches: one row a hash."""
        return self._every(self._names())

    def release(self) -> None:
        """Takes the runs out of the session's catalog and deletes their files."""
        for name in self._names():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []
        delete_path(self.spark, self.root)


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``lines`` whose hash is in at least ``min_docs`` documents, written to the shared folder."""
    counted = saved(lines.groupBy(*HASH).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "line-counts")
    most = lines.count() // heavy
    top = F.broadcast(counted.where(F.col("n") > most).select(*HASH))  # at most ``heavy`` rows
    rest = counted.where(F.col("n") <= most).select(*HASH)
    some = lines.join(top, HASH, "left_semi").withColumn("heavy", F.lit(True))
    some = some.unionByName(lines.join(top, HASH, "left_anti").join(rest, HASH, "left_semi").withColumn("heavy", F.lit(False)))
    some = saved(some, "repeated-lines")
    # Hashes of enough lines but too few documents go: the heavy ones again by a broadcast, so no shuffle gathers a heavy hash.
    once = some.select("doc", *HASH).groupBy("doc", *HASH).agg(F.lit(1).alias("one"))
    rare = saved(once.groupBy(*HASH).agg(F.count("*").alias("docs")).where(F.col("docs") < min_docs).select(*HASH), "rare-lines")
    rare_top = F.broadcast(rare.join(top, HASH, "left_semi"))
    out = some.where("heavy").join(rare_top, HASH, "left_anti").unionByName(some.where("NOT heavy").join(rare, HASH, "left_anti"))
    out = saved(out.drop("heavy"), "frequent-lines")
    discard(counted, some, rare)
    return out


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc, text_hash, drops (positions from 0 of the lines to drop) of the documents that lose any."""
    spark = docs.sparkSession
    lines = saved(line_hashes(docs, id_col, text_col, min_chars), "lines")
    frequent = frequent_lines(lines, min_docs)
    discard(lines)
    # Where a batch ends changes no result, so approximate cuts do; they are a handful of numbers.
    cuts = frequent.agg(F.percentile_approx("doc", [k / batches for k in range(batches - 1, 0, -1)], 1000).alias("cuts")).first()["cuts"] or []
    runs = LineRuns(spark, rows=frequent.count())
    upper = None
    for cut in [*dict.fromkeys(cuts), None]:
        some = F.lit(True) if upper is None else F.coalesce(F.col("doc") <= upper, F.lit(True))
        some = some if cut is None else some & (F.col("doc") > cut)
        runs.add(frequent.where(some))
        upper = cut
    kept = runs.keepers().select(*HASH, F.col("top").alias("doc"))
    doomed = frequent.join(kept, [*HASH, "doc"], "left_anti")
    out = saved(doomed.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("drops")), "line-drops")
    runs.release()
    discard(frequent)
    return out


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", info_col: str = "line_dedup", **limits: int) -> DataFrame:
    """``docs`` with the kept text, and a struct ``info_col`` of n_lines and n_dropped; a column of that name is replaced."""
    names = [c for c in docs.columns if c != info_col]
    drops = dropped_positions(docs, id_col, text_col, **limits)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("own_hash"))
    met = rows.join(drops.hint("merge"), F.col("own_id").eqNullSafe(F.col("doc")) & (F.col("own_hash") == F.col("text_hash")), "left")
    text = F.col("row").getField(text_col)
    split = met.select("row", "drops", F.when(F.col("drops").isNotNull(), _lines(text)).alias("lines"))
    # ``lines`` is read twice below, which keeps Spark from splitting the text again for each line.
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    joined = F.when(F.col("drops").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    info = F.struct(_line_count(text).alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"))
    return split.select(*((joined if c == text_col else F.col("row").getField(c)).alias(c) for c in names), info.alias(info_col))
