"""Stored text indexes: postings, terms and corpus statistics, written once and read by every batch of questions.

Postings are (bucket, term, position, tf, names, grams_n), in a folder for each bucket of terms and sorted by term within
it. A batch asks for the buckets of its own terms by name, so the folders of all others are never listed or read; the terms
table, in the same buckets, has document frequencies. ``names`` and ``grams_n`` are how many tokens of each kind the chunk
has, so that one index serves every set of n-gram sizes.

A batch that would add up very many pairs of a question and a posting prunes exactly, as max-score evaluation does. The rare
terms of a question are added up first; the k-th best of these sums is a floor. Common terms that can't reach it all together
are light: no chunk with light terms alone is among the first k, and only chunks that may still pass the floor look up their
light terms, by (term, position). So the longest postings are read, but neither multiplied by the questions that hold them
nor summed up. Results are the same either way.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import retrieve as R
from corvane.operators import scratch

SIZES = (2, 3)
#: The kinds of tokens that a chunk's length is made of.
KINDS = ("names", *(f"grams_{n}" for n in SIZES))
#: Postings a bucket has on average, and the least and most buckets.
BUCKET_POSTINGS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 8, 4096
#: A term that more than one in so many chunks hold is common.
COMMON = 25
#: Below so many pairs of a question and a posting, adding all of them up takes less than finding out which matter.
FEW_PAIRS = 50_000_000
#: Scores are ranked on nine decimals, so this many units decide nothing.
TOLERANCE = 4 * (R.SCORE_UNIT // 10**9)


class TextIndex(NamedTuple):
    postings: DataFrame
    terms: DataFrame
    n_docs: int
    buckets: int
    tokens: dict[str, int]

    def average(self, sizes: tuple[int, ...]) -> float:
        """Tokens a chunk, 1.0 where there are none."""
        total = self.tokens["names"] + sum(self.tokens[f"grams_{n}"] for n in sizes)
        return total / self.n_docs if self.n_docs and total else 1.0


def _length(sizes: tuple[int, ...]) -> Column:
    return functools.reduce(lambda a, b: a + b, (F.col(f"grams_{n}") for n in sizes), F.col("names"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def sized_postings(rows: DataFrame) -> DataFrame:
    """position, term, tf, names, grams_n of token rows (position, term; of the n-gram sizes ``SIZES``)."""
    run = F.when(F.col("term").rlike(f"^{T.JAPANESE_RUN}$"), F.length("term"))
    counted = rows.groupBy("position", "term").agg(F.count("*").alias("tf")).withColumn("run", run)
    kinds = {"names": F.col("run").isNull()} | {f"grams_{n}": F.col("run") == n for n in SIZES}
    of_chunk = Window.partitionBy("position")
    return counted.select("position", "term", "tf", *(F.coalesce(F.sum(F.when(is_one, F.col("tf"))).over(of_chunk), F.lit(0)).alias(kind) for kind, is_one in kinds.items()))


def write_postings(sized: DataFrame, path: str, buckets: int) -> None:
    """Postings below ``path``, in a folder for each bucket. Ranges go by position too, so a term that every chunk holds is
    written by several tasks."""
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["bucket", "term", "position"]
    placed = sized.withColumn("bucket", _bucket(F.col("term"), buckets))
    placed.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"position bigint, term string, tf bigint, {' bigint, '.join(KINDS)} bigint, bucket int").parquet(path)


def term_table(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))


def build_index(chunks: DataFrame, rows: DataFrame, path: str, buckets: int | None = None) -> TextIndex:
    """Writes the index of the token rows of ``chunks``, and opens it."""
    spark = chunks.sparkSession
    sized_postings(rows).write.parquet(f"{path}/counted")
    sized = spark.read.parquet(f"{path}/counted")
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, sized.count() // BUCKET_POSTINGS))
    write_postings(sized, f"{path}/postings", buckets)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    terms = term_table(sized.withColumn("bucket", _bucket(F.col("term"), buckets)))
    terms.repartition(parts, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    run = F.col("term").rlike(f"^{T.JAPANESE_RUN}$")
    sums = sized.agg(*(F.coalesce(F.sum(F.when(~run if kind == "names" else run & (F.length("term") == int(kind[6:])), F.col("tf"))), F.lit(0)).alias(kind) for kind in KINDS))
    chunks.agg(F.count("*").alias("n_docs")).join(sums).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/statistics")
    scratch.delete(spark, f"{path}/counted")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    row = spark.read.parquet(f"{path}/statistics").first().asDict()
    postings = read_postings(spark, f"{path}/postings")
    terms = spark.read.schema("term string, df bigint, max_tf bigint, bucket int").parquet(f"{path}/terms")
    return TextIndex(postings, terms, row.pop("n_docs"), row.pop("buckets"), row)


class Facts(NamedTuple):
    """Of rows with a bucket, in one job: how many there are, their buckets (a number each), and the sum of ``df``."""

    n: int
    buckets: list[int]
    pairs: int


def facts_of(rows: DataFrame) -> Facts:
    pairs = F.coalesce(F.sum("df"), F.lit(0)) if "df" in rows.columns else F.lit(0)
    found = rows.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("bucket")).alias("buckets"), pairs.alias("pairs")).first()
    return Facts(found["n"], found["buckets"], found["pairs"])


def in_buckets(stored: DataFrame, index: TextIndex, wanted: DataFrame | Facts) -> DataFrame:
    """The part of a stored table that lies in the buckets of ``wanted``."""
    buckets = (wanted if isinstance(wanted, Facts) else facts_of(wanted)).buckets
    return stored if len(buckets) == index.buckets else stored.where(F.col("bucket").isin(buckets))


def _small(rows: DataFrame, facts: Facts) -> DataFrame:
    """``rows`` marked for broadcast if they were counted to be few, as ``retrieve.small`` does."""
    return F.broadcast(rows) if facts.n <= R.TERM_LIMIT else rows


def asked_terms(index: TextIndex, queries: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """query_id, bucket, term, df, max_tf of each distinct token of a query that the index holds; written once."""
    asked = R.query_terms(queries, sizes).select("query_id", "term", _bucket(F.col("term"), index.buckets).alias("bucket"))
    return known_terms(index, scratch.written(asked, "asked"))


def known_terms(index: TextIndex, asked: DataFrame) -> DataFrame:
    facts = facts_of(asked)
    return scratch.written(in_buckets(index.terms, index, facts).join(_small(asked, facts), ["bucket", "term"]), "weighed")


def _parts(index: TextIndex, weighed: DataFrame, sizes: tuple[int, ...], k1: float, b: float, facts: Facts | None = None) -> DataFrame:
    """query_id, position, unit: what each posting of a query's terms adds to a score, in ``SCORE_UNIT``-ths."""
    facts = facts or facts_of(weighed)
    hits = in_buckets(index.postings, index, facts).join(_small(weighed, facts), ["bucket", "term"])
    return hits.select("query_id", "position", _unit(index, sizes, k1, b).alias("unit"))


def _unit(index: TextIndex, sizes: tuple[int, ...], k1: float, b: float) -> Column:
    part = _idf(index) * R.saturation(F.col("tf"), _length(sizes), F.lit(index.average(sizes)), k1, b)
    return F.round(part * F.lit(float(R.SCORE_UNIT))).cast("long")


def _idf(index: TextIndex) -> Column:
    return R.inverse_frequency(F.lit(index.n_docs), F.col("df"))


def _scores(units: DataFrame) -> DataFrame:
    return units.groupBy("query_id", "position").agg((F.sum("unit") / F.lit(float(R.SCORE_UNIT))).alias("score"))


def indexed_scores(index: TextIndex, queries: DataFrame, sizes: tuple[int, ...] = SIZES, k1: float = R.K1, b: float = R.B) -> DataFrame:
    """query_id, position, score of every chunk that shares a token with a query."""
    return _scores(_parts(index, asked_terms(index, queries, sizes), sizes, k1, b))


def contenders(index: TextIndex, queries: DataFrame, k: int, sizes: tuple[int, ...] = SIZES, k1: float = R.K1, b: float = R.B) -> DataFrame:
    """query_id, position, score of chunks among which the first ``k`` of every query are; their scores are whole."""
    weighed = asked_terms(index, queries, sizes).withColumn("rare", F.col("df") * COMMON <= index.n_docs)
    facts = facts_of(weighed)
    if facts.pairs < FEW_PAIRS:
        return _scores(_parts(index, weighed, sizes, k1, b, facts))
    partial = scratch.written(_summed(_parts(index, weighed.where("rare"), sizes, k1, b)), "rare-sums")
    # The most that a term can add is that of a chunk as short as can be with the term's largest count. The light terms of a
    # query are those of the least such bounds that all together stay below the floor.
    most = F.ceil(_idf(index) * R.saturation(F.col("max_tf"), F.lit(0.0), F.lit(1.0), k1, b) * F.lit(float(R.SCORE_UNIT))) + 1
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    common = weighed.where("NOT rare").withColumn("most", most).withColumn("upto", upto).join(_floors(partial, k), "query_id", "left")
    common = scratch.written(common.withColumn("light", F.coalesce(F.col("upto") + TOLERANCE < F.col("floor"), F.lit(False))).drop("floor", "upto"), "common-terms")
    heavy, light = common.where("NOT light"), common.where("light")
    whole = partial.unionByName(_parts(index, heavy.drop("most", "light"), sizes, k1, b)) if not heavy.isEmpty() else partial
    summed = scratch.written(_summed(whole), "sums")
    bounds = light.groupBy("query_id").agg(F.sum("most").alias("slack")).join(_floors(summed, k), "query_id")
    met = summed.join(R.small(bounds), "query_id", "left")
    near = met.where(F.col("slack").isNull() | (F.col("unit") + F.col("slack") + TOLERANCE >= F.col("floor"))).select("query_id", "position", "unit")
    near = scratch.written(near, "contenders")
    more = lookups(index, near, light.drop("most", "light")).select("query_id", "position", _unit(index, sizes, k1, b).alias("unit"))
    return _scores(near.unionByName(more))


def _summed(units: DataFrame) -> DataFrame:
    return units.groupBy("query_id", "position").agg(F.sum("unit").alias("unit"))


def _floors(sums: DataFrame, k: int) -> DataFrame:
    """query_id, floor: the k-th largest sum of each query that has so many."""
    return R.top_k(sums, k, F.desc("unit"), F.col("position")).where(F.col("rank") == k).select("query_id", F.col("unit").alias("floor"))


def lookups(index: TextIndex, candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of each candidate (query_id, position) for the terms (query_id, bucket, term, ...) of its query."""
    wanted = candidates.select("query_id", "position").join(R.small(terms), "query_id")
    some = R.small(terms.select("bucket", "term").distinct())
    stored = in_buckets(index.postings, index, terms).join(some, ["bucket", "term"], "left_semi")
    return stored.join(wanted, ["bucket", "term", "position"])


def indexed_bm25(index: TextIndex, queries: DataFrame, k: int = 5, sizes: tuple[int, ...] = SIZES, k1: float = R.K1, b: float = R.B) -> DataFrame:
    """BM25 over a stored index, with the ranking of ``retrieve.bm25`` and ``retrieve.field_bm25``."""
    return R.top_k(contenders(index, queries, R.require(k, "top_k"), sizes, k1, b), k, F.desc(F.round("score", 9)), F.col("position"))


def indexed_symbols(index: TextIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """``retrieve.symbol_search`` over the stored index of the field ``identifiers``."""
    asked = R.symbol_terms(queries).withColumn("bucket", _bucket(F.col("term"), index.buckets))
    asked = scratch.written(asked, "symbols")
    facts = facts_of(asked)
    return R.symbol_ranking(in_buckets(index.postings, index, facts).join(_small(asked, facts), ["bucket", "term"]), k)


def indexed_overlap(index: TextIndex, candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``fusion.rerank`` by the share of the query's distinct tokens that a candidate has, from the postings of these tokens."""
    asked = R.query_terms(queries, (2,)).select("query_id", "term", _bucket(F.col("term"), index.buckets).alias("bucket"))
    asked = scratch.written(asked, "asked")
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    pairs = candidates.select("query_id", "position", F.col("rank").alias("original_rank"), F.col("score").alias("retrieval_score"))
    pairs = scratch.written(pairs, "pairs")
    found = lookups(index, pairs, asked).groupBy("query_id", "position").agg(F.count("*").alias("held"))
    scored = pairs.join(found, ["query_id", "position"], "left").join(R.small(sizes), "query_id", "left")
    scored = scored.withColumn("score", F.coalesce(F.col("held") / F.col("n"), F.lit(0.0))).drop("held", "n")
    ranked = R.top_k(scored, k, F.desc(F.round("score", 9)), F.col("original_rank"), F.col("position"))
    return ranked.withColumn("rank_change", F.col("original_rank") - F.col("rank"))


# --- indexes of a session ---------------------------------------------------------------------------------------------

_built: dict[tuple[str, str, str], str] = {}


#: So many files are looked at one by one; more by the tasks that read them.
FEW_FILES = 256


def state_of(table: DataFrame) -> str:
    """A digest of the files of a table: names, sizes and times. Raises for a table that is not of files, since nothing tells
    its states apart."""
    sc = table.sparkSession.sparkContext
    names = sorted(table.inputFiles())
    if 0 < len(names) <= FEW_FILES:
        digest = hashlib.sha256()
        for name in names:
            at = sc._jvm.org.apache.hadoop.fs.Path(name)
            status = at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at)
            digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
        return digest.hexdigest()
    meta = F.col("_metadata")
    try:
        files = table.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("at"))
    except AnalysisException as e:
        raise ValueError("a session index needs a table that is read from files") from e
    each = files.distinct().select(F.xxhash64("path", "size", "at").alias("a"), F.xxhash64(F.lit("second"), "at", "size", "path").alias("b"))
    row = each.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("b"), F.lit(0)).alias("b")).first()
    return f"{row['n']}-{row['a']}-{row['b']}"


def session_index(source: DataFrame, name: str, chunks: DataFrame, rows: Callable[[], DataFrame]) -> TextIndex:
    """The index ``name`` of ``chunks``, built when it is first asked for, and again once the files of ``source`` change. It lies
    in this session's scratch folder and goes with it."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, name, state_of(source))
    if key not in _built:
        path = scratch.path(spark, "index")
        build_index(chunks, rows(), path)
        _built[key] = path
    return open_index(spark, _built[key])
