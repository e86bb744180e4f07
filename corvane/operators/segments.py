"""A text index that follows its chunks: only what changed is tokenised.

The index at a path is a row of segments of postings, as ``index`` writes them. An update compares the fingerprints of all
chunks with those of the last version: new and changed chunks become one segment of level 0, and what a segment holds of
changed and removed chunks is dead. When a level has ``FANOUT`` segments, they are merged into one of the next level without
their dead postings. So a posting is rewritten once a level, and its text is read again only when it changes.

A version is a small file that names its segments and tables; it is created whole or not at all, and only if no other writer
has created that version meanwhile. Older versions stay readable until ``forget`` deletes what no kept version names.

Reading leaves dead postings out by an anti join, and counts document frequencies of the asked terms from live postings, so
scores are those of a full build.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import index as N
from corvane.operators import scratch

FANOUT = 4
BUCKETS = 64
_DOCUMENTS = f"position bigint, fingerprint string, segment string, {' bigint, '.join(N.KINDS)} bigint"
_DEAD = "position bigint, segment string"


class Change(NamedTuple):
    """What an update did: the version now, chunks tokenised, chunks dead, segments merged away."""

    version: int
    fresh: int
    dead: int
    merged: int


def fingerprint() -> Column:
    """Of what a chunk is searched by."""
    return T.text_sha256(T.searchable_text(F.col("page_title"), F.col("section_title"), F.col("text")))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Creates a version; raises if another writer has."""
    at, fs = _fs(spark, f"{path}/versions/{version}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        raise RuntimeError(f"version {version} of the index at {path} was written meanwhile") from e
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def _live(spark: SparkSession, path: str, manifest: dict, some: list[str] | None = None) -> DataFrame:
    """The postings of some segments (all by default) that are not dead, with their segment."""
    every: DataFrame | None = None
    for s in manifest["segments"]:
        if some is None or s["id"] in some:
            rows = N.read_postings(spark, f"{path}/segments/{s['id']}").withColumn("segment", F.lit(s["id"]))
            every = rows if every is None else every.unionByName(rows)
    if every is None:
        return spark.createDataFrame([], f"position bigint, term string, tf bigint, {' bigint, '.join(N.KINDS)} bigint, bucket int, segment string")
    return every.join(_table(spark, path, manifest["dead"], _DEAD), ["position", "segment"], "left_anti")


def _table(spark: SparkSession, path: str, name: str | None, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}") if name else spark.createDataFrame([], schema)


def _written(df: DataFrame, path: str, kind: str) -> str:
    name = f"{kind}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def update(chunks: DataFrame, path: str, rows_of: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, fanout: int = FANOUT) -> Change:
    """Brings the index at ``path`` to ``chunks`` (positions are keys, and stay a chunk's own); ``rows_of`` makes token rows
    (position, term) of the chunks that it is given. Nothing is written if nothing changed."""
    spark = chunks.sparkSession
    known = versions(spark, path)
    version = known[-1] if known else 0
    old = _manifest(spark, path, version) if known else {"segments": [], "documents": None, "dead": None, "buckets": buckets}
    before = _table(spark, path, old["documents"], _DOCUMENTS)
    now = chunks.select("position", fingerprint().alias("now"))
    met = scratch.written(before.join(now, "position", "full_outer"), "compared")
    changed = met.where(~F.col("now").eqNullSafe(F.col("fingerprint")))
    fresh = changed.where("now IS NOT NULL").select("position", F.col("now").alias("fingerprint"))
    gone = changed.where("fingerprint IS NOT NULL").select("position", "segment")
    n_fresh, n_gone = fresh.count(), gone.count()
    if known and not n_fresh and not n_gone:
        return Change(version, 0, 0, 0)
    segments = [dict(s) for s in old["segments"]]
    documents = met.where(F.col("now").eqNullSafe(F.col("fingerprint"))).select("position", "fingerprint", "segment", *N.KINDS)
    if n_fresh:
        name = uuid.uuid4().hex
        sized = scratch.written(N.sized_postings(rows_of(chunks.join(fresh.select("position"), "position", "left_semi"))), "sized")
        N.write_postings(sized, f"{path}/segments/{name}", old["buckets"])
        segments.append({"id": name, "level": 0})
        sizes = sized.groupBy("position").agg(*(F.max(k).alias(k) for k in N.KINDS))
        added = fresh.join(sizes, "position", "left").select("position", "fingerprint", F.lit(name).alias("segment"), *(F.coalesce(k, F.lit(0)).alias(k) for k in N.KINDS))
        documents = documents.unionByName(added)
    dead = _table(spark, path, old["dead"], _DEAD).unionByName(gone)
    manifest = {"segments": segments, "dead": _written(dead, path, "dead"), "buckets": old["buckets"]}
    merged: dict[str, str] = {}
    level = 0
    while level <= max((s["level"] for s in segments), default=-1):
        full = [s["id"] for s in segments if s["level"] == level]
        if len(full) >= fanout:
            name = uuid.uuid4().hex
            N.write_postings(_live(spark, path, manifest, full).drop("segment", "bucket"), f"{path}/segments/{name}", old["buckets"])
            segments = [s for s in segments if s["id"] not in full] + [{"id": name, "level": level + 1}]
            merged = {k: name if v in full else v for k, v in merged.items()} | dict.fromkeys(full, name)
            # Nothing in the new segment is dead.
            dead = _table(spark, path, manifest["dead"], _DEAD).where(~F.col("segment").isin(full))
            manifest |= {"segments": segments, "dead": _written(dead, path, "dead")}
        level += 1
    if merged:
        renamed = F.create_map(*(F.lit(x) for pair in merged.items() for x in pair))
        documents = documents.withColumn("segment", F.coalesce(F.try_element_at(renamed, F.col("segment")), F.col("segment")))
    manifest["documents"] = _written(documents, path, "documents")
    sums = _table(spark, path, manifest["documents"], _DOCUMENTS).agg(F.count("*").alias("n_docs"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in N.KINDS)).first().asDict()
    _commit(spark, path, version + 1, manifest | {"sums": sums})
    return Change(version + 1, n_fresh, n_gone, len(merged))


def open_segments(spark: SparkSession, path: str, version: int | None = None) -> N.TextIndex:
    """A version (the last by default) as an index that every search of ``index`` takes."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"there is no index at {path}")
    manifest = _manifest(spark, path, known[-1] if version is None else version)
    sums = dict(manifest["sums"])
    postings = _live(spark, path, manifest).drop("segment")
    return N.TextIndex(postings, N.term_table(postings), sums.pop("n_docs"), manifest["buckets"], sums)


def forget(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions but the last ``keep`` and what only they name; returns how many tables and segments went."""
    known = versions(spark, path)
    kept = [_manifest(spark, path, v) for v in known[-keep:]]
    wanted = {s["id"] for m in kept for s in m["segments"]} | {m[k] for m in kept for k in ("documents", "dead")}
    for v in known[:-keep]:
        scratch.delete(spark, f"{path}/versions/{v}.json")
    n = 0
    for folder in (path, f"{path}/segments"):
        at, fs = _fs(spark, folder)
        for s in fs.listStatus(at) if fs.exists(at) else []:
            name = s.getPath().getName()
            if name not in wanted and name not in ("versions", "segments"):
                scratch.delete(spark, f"{folder}/{name}")
                n += 1
    return n
