"""Publication over several roots at once, with a journal: all roots switch to their new versions, or none does.

1. ``OPEN`` is created in the journal's folder, if it isn't there: it names the publication, and the version that each root has.
2. Every root gets its new version, which nothing points to yet.
3. The roots are looked at again; one that has moved on meanwhile ends the publication.
4. ``<publication>.committed`` is created, which names the new versions. From here on the publication counts.
5. Every root's pointer is switched, and ``OPEN`` is deleted.

Whatever stops it, ``recover_all`` ends it: without the file of step 4 no pointer was touched, and ``OPEN`` goes; with it, the
pointers are switched (again). A writer that finds ``OPEN`` is refused until then. The folder must be on a file system that
creates a file exclusively, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from corvane.operators import publish as P


def _create(spark: SparkSession, path: str, content: dict) -> bool:
    """Creates a file; False if it is there already."""
    fs, path_of = P._fs(spark, path)
    try:
        out = fs.create(path_of(path), False)
    except Py4JJavaError:
        if fs.exists(path_of(path)):
            return False
        raise
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> dict | None:
    text = P._read_text(spark, path)
    try:
        return None if text is None else json.loads(text)
    except json.JSONDecodeError:
        return {}  # its writer stopped in the middle


def _delete(spark: SparkSession, path: str) -> None:
    fs, path_of = P._fs(spark, path)
    fs.delete(path_of(path), False)


def publish_all(journal: str, roots: dict[str, dict[str, DataFrame]], manifest: dict | None = None, expected: dict[str, str | None] | None = None, step: Callable[[str], None] = lambda name: None) -> dict[str, str]:
    """The new version of every root (path -> tables by name).

    ``expected``: the versions that the tables were made from, by default those that the roots have now; a root with another
    one raises ``RuntimeError``, and nothing is switched. ``step`` is told each step that is done.
    """
    if not roots:
        raise ValueError("nothing to publish")
    spark = next(iter(next(iter(roots.values())).values())).sparkSession
    name = uuid.uuid4().hex
    was = {r: P.current(spark, r) for r in roots} | (expected or {})
    if not _create(spark, f"{journal}/OPEN", {"publication": name, "was": was}):
        raise RuntimeError(f"another publication is open in {journal}; recover_all ends one that was stopped")
    step("opened")
    try:
        versions = {}
        for root, tables in roots.items():
            versions[root] = P.write_version(root, tables, manifest)
            step("written")
        if moved := [r for r in roots if P.current(spark, r) != was[r]]:
            raise RuntimeError("published by another writer meanwhile: " + ", ".join(sorted(moved)))
    except (RuntimeError, ValueError):
        _delete(spark, f"{journal}/OPEN")
        raise
    _create(spark, f"{journal}/{name}.committed", versions)
    step("committed")
    for root, version in versions.items():
        P.switch(spark, root, version)
        step("switched")
    _delete(spark, f"{journal}/OPEN")
    return versions


def recover_all(spark: SparkSession, journal: str) -> str | None:
    """Ends a publication that was stopped: ``forward`` (it counts), ``back`` (it doesn't), or None if none is open.

    Only for publications whose writer is gone. Versions that nothing points to go with ``publish.recover``.
    """
    opened = _read(spark, f"{journal}/OPEN")
    if opened is None:
        return None
    # A half-written OPEN names no publication, and its writer came no further.
    versions = _read(spark, f"{journal}/{opened.get('publication')}.committed")
    for root, version in (versions or {}).items():
        P.restore(spark, root, version)
    _delete(spark, f"{journal}/OPEN")
    return "forward" if versions else "back"
