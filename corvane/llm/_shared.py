"""Helpers that the training-data operators share: scratch tables and text normalisation.

Scratch tables lie in one folder a session, ``<spark.checkpoint.dir>/corvane/<application>-<random>``, so sessions that share
the root never touch each other's. Operators delete the tables that their result no longer reads with ``discard``; the
rest goes with ``drop_scratch``, which also runs when the Python driver ends in an orderly way.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: The white space of the text contracts, and ASCII letters for lower-casing.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_folders: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local session, whose tasks all run on this machine; a cluster would
    have another such folder on every node, so there it is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = tempfile.mkdtemp(prefix="corvane-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This session's own folder."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{scratch_root(spark)}/corvane/{app}-{uuid.uuid4().hex}"
        atexit.register(_at_exit, spark)
    return _folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    Files in the shared folder outlive any executor, so a lost one costs only its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextlib.contextmanager
def temporary_tables() -> Iterator[list[DataFrame]]:
    """The list of the tables that ``saved`` writes within, for ``discard`` once the result that reads them is written too."""
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes.pop()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` returned, once nothing is left that reads them."""
    for df in tables:
        if path := df.__dict__.get("_scratch"):
            delete_path(df.sparkSession, path)
            del df._scratch


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every table of this session; call it when no result still reads one."""
    if folder := _folders.pop(spark.sparkContext.applicationId, None):
        delete_path(spark, folder)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before; its folder then stays for the cluster to clear
        drop_scratch(spark)


def text_batches(spark: SparkSession | None = None, rows: int = 1000, size: int = 1 << 24) -> None:
    """Lets Spark hand Python at most ``rows`` texts or ``size`` bytes at a time (one text at least): a task's memory follows
    the batch, not the partition.

    Plans read the settings when they run, after the operator has returned, so they stay for the session; they are lowered,
    never raised.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, most)


def summed(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, pieces: int = 16) -> np.ndarray:
    """The sum over all tasks of the vector (``size`` doubles) that ``of`` makes of a task's batches.

    A task emits its vector in ``pieces`` binary rows, whatever its input; each piece is added up by a task of its own, in
    order of the tasks, so the driver gets one vector, and the same one again for the same partitions.
    """

    def row(piece: int, task: int, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([task], pa.int32()), pa.array([part.astype("<f8").tobytes()], pa.binary())], names=["piece", "task", "v"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of(batches)
        if total.any():
            for k, part in enumerate(np.array_split(total, pieces)):
                yield row(k, TaskContext.get().partitionId(), part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(raw.as_buffer(), dtype="<f8")
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield row(k, 0, part)

    kind = "piece int, task int, v binary"
    met = rows.mapInArrow(local, kind).repartition(pieces, "piece").sortWithinPartitions("piece", "task").mapInArrow(add, kind)
    got = {r["piece"]: np.frombuffer(r["v"], dtype="<f8") for r in met.collect()}
    return np.concatenate([got[k] for k in range(pieces)]) if got else np.zeros(size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
