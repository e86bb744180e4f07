"""A mutable archive over HTTPS, held to a lock: what was accepted once is what later runs may read."""

from __future__ import annotations

import hashlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.publish import read_report, write_report
from corvane.sources.crawl import Transport, fetch


def locked_archive(spark: SparkSession, url: str, lock: str, transport: Transport, refresh: bool = False, max_bytes: int = 1 << 28) -> DataFrame:
    """One row, ``content``: the archive at ``url``, if it is the one that the file ``lock`` names (url, size, sha256).

    Without a lock, or with ``refresh``, what is there now is accepted and locked. Plain HTTP, also after a redirect, a
    failed fetch and an archive larger than ``max_bytes`` raise and leave the lock as it is.
    """
    if urlsplit(url).scheme != "https":
        raise ValueError("a locked archive needs an https URL")
    got = fetch(transport, url)
    if got is None or not 200 <= got.status < 300:
        raise ValueError(f"cannot fetch {url}")
    if urlsplit(got.url).scheme != "https":
        raise ValueError(f"{url} leads to {got.url}, which is not https")
    if len(got.body) > max_bytes:
        raise ValueError(f"the archive is larger than {max_bytes} bytes")
    now = {"url": url, "size": len(got.body), "sha256": hashlib.sha256(got.body).hexdigest()}
    held = read_report(spark, lock)
    if held is None or refresh:
        write_report(spark, lock, now)
    elif held != now:
        raise ValueError(f"the archive at {url} is not the locked one; refresh the lock to accept it")
    return spark.createDataFrame([(bytearray(got.body),)], "content binary")
