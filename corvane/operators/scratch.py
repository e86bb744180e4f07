"""Tables that operators write once and read several times, in the folder that all nodes share.

One folder a session, ``<spark.checkpoint.dir>/corvane-base/<application>-<random>``. It goes when the driver's Python ends
in an orderly way, or with ``drop``; a local session without the setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; an error on a cluster without it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path of this session."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{root(spark)}/corvane-base/{app}-{uuid.uuid4().hex}"
        atexit.register(_at_exit, spark)
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, at: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, whatever reads it and whichever executor is lost."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop(spark: SparkSession) -> None:
    """Deletes every table of this session."""
    if folder := _folders.pop(spark.sparkContext.applicationId, None):
        delete(spark, folder)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        drop(spark)
