"""Sinks: versioned publication with a pointer, manifests, sidecars and deterministic archives."""

from __future__ import annotations

import io
import json
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a temporary sibling that is renamed over the old file, so the old or the new text is there at any time (on
    file systems whose renames replace at once, as HDFS does; the local one deletes just before)."""
    fs, path_of = _fs(spark, path)
    temporary = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(path_of(temporary), True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    how = sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(path_of(temporary), path_of(path), how)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, path_of = _fs(spark, path)
    if not fs.exists(path_of(path)):
        return None
    stream = fs.open(path_of(path))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def write_version(root: str, tables: dict[str, DataFrame], manifest: dict | None = None) -> str:
    """Writes all tables and their manifest below a fresh version of ``root``, which nothing points to yet."""
    if not tables:
        raise ValueError("nothing to publish")
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{version}/{name}").count()
        if not counts[name]:
            raise ValueError(f"refusing to publish an empty table: {name}")
    _write_text(spark, f"{root}/{version}/manifest.json", json.dumps({"version": version, "rows": counts, **(manifest or {})}, sort_keys=True, ensure_ascii=False))
    return version


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version the current one."""
    _write_text(spark, f"{root}/CURRENT", version)


def publish(root: str, tables: dict[str, DataFrame], manifest: dict | None = None) -> str:
    """Writes all tables below a fresh version, then switches ``root/CURRENT`` to it: all or none become visible.

    For one writer a root; ``journal.publish_all`` is for several writers, or several roots at once."""
    version = write_version(root, tables, manifest)
    switch(next(iter(tables.values())).sparkSession, root, version)
    return version


def current(spark: SparkSession, root: str) -> str | None:
    return _read_text(spark, f"{root}/CURRENT")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current(spark, root)
    if version is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{version}/{name}")


def manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(_read_text(spark, f"{root}/{current(spark, root)}/manifest.json"))


def recover(spark: SparkSession, root: str, min_age_seconds: float = 86_400) -> list[str]:
    """Removes versions that are not current and have not changed for ``min_age_seconds``; returns their names.

    Younger ones may still be written by another session, or read since before the last switch. Without a pointer nothing
    tells which version counts, so that is an error and nothing is removed; ``restore`` names one.
    """
    fs, path_of = _fs(spark, root)
    now = current(spark, root)
    if now is None:
        raise ValueError(f"{root} has no pointer to a version; nothing was removed")
    latest = time.time() - min_age_seconds
    gone = []
    for status in fs.listStatus(path_of(root)):
        name = status.getPath().getName()
        if not status.isDirectory() or name == now:
            continue
        times = [status.getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(status.getPath()))]
        if max(times) / 1000 <= latest:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone


def complete_versions(spark: SparkSession, root: str) -> list[str]:
    """Versions that were written to the end (they have a manifest), oldest first."""
    fs, path_of = _fs(spark, root)
    found = [s for s in fs.listStatus(path_of(root)) if s.isDirectory() and fs.exists(path_of(f"{root}/{s.getPath().getName()}/manifest.json"))]
    return [s.getPath().getName() for s in sorted(found, key=lambda s: s.getModificationTime())]


def restore(spark: SparkSession, root: str, version: str) -> None:
    """Makes a complete version the current one, as after the loss of the pointer."""
    if version not in complete_versions(spark, root):
        raise ValueError(f"{version} is no complete version in {root}")
    switch(spark, root, version)


def sidecar_summary(records: DataFrame) -> DataFrame:
    """One row: chunks, identifier occurrences and distinct identifiers of a symbol sidecar."""
    sizes = records.agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum(F.size("identifiers")), F.lit(0)).alias("identifier_occurrence_count"))
    distinct = records.select(F.explode("identifiers").alias("i")).distinct().agg(F.count("*").alias("unique_identifier_count"))
    return sizes.join(distinct)


def corpus_manifest(chunks: DataFrame) -> DataFrame:
    """One row: chunks, pages, sections, categories and characters of a corpus."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct(F.substring_index("source_url", "#", 1)).alias("n_pages"), F.countDistinct("source_url", "section_title").alias("n_sections"), F.countDistinct("category").alias("n_categories"), F.sum(F.length("text")).alias("n_chars"))


def reusable(stored: dict, **fingerprints: str) -> bool:
    """A prepared artifact may be reused only if every fingerprint is as stored."""
    return all(stored.get(k) == v for k, v in fingerprints.items())


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """An evaluation report as JSON with sorted keys, replaced as a whole; a value that is no JSON (NaN) raises."""
    _write_text(spark, path, json.dumps(report, sort_keys=True, ensure_ascii=False, indent=2, allow_nan=False) + "\n")


def read_report(spark: SparkSession, path: str) -> dict | None:
    text = _read_text(spark, path)
    return None if text is None else json.loads(text)


def deterministic_zip(files: dict[str, bytes]) -> bytes:
    """An archive of the same bytes for the same files: sorted names, one fixed time and mode."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = 0o100644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, files[name])
    return out.getvalue()
