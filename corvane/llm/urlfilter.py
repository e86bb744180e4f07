"""Operator 6: URL allow and block rules by a sort-merge range join.

A host is keyed by its labels in reverse (``com.example.www.``), so all subdomains of a rule's host lie in one interval of
the key order and intervals nest or are disjoint. URLs are range-partitioned and sorted by key; in each partition a sweep
walks the URLs and the sorted rules together and keeps a stack of the rules whose interval holds the current key: a rule
host's rules are pushed when their interval begins and popped when it ends. The deepest host on the stack that has a rule whose
path starts the URL's path decides, with the longest such path; so the longest rule is that of the longest host, then of the
longest path. A host keeps its paths by length, so a URL asks once for each length of a path, however many rules there are.

Scale: the range shuffle carries (id, url) only, and its sort key ends with the path and id, so a host with a third of all
pages is dealt over many tasks. Rules go to the tasks in blocks of at most ``RULE_BLOCK`` (a bounded broadcast); with more
rules than that, each block is swept in the same pass over a partition and the longest match over the blocks wins.

Cases: a null URL, or one without ``://``, has empty host and path and fits no rule. Rules with a null part are ignored;
of equal rules with different verdicts the first verdict in text order (allow) wins. Hosts keep a port, which then is part
of the last label. Repeated rows are judged each. Very long URLs are handled whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import LOWER, UPPER

RULE_BLOCK = 100_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?``, ``#``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


class HostRules(NamedTuple):
    key: str
    lengths: list[int]  # of the paths, longest first
    paths: dict[str, tuple[str, str]]  # path -> rule, verdict


def _ordered(rules: Iterable[Rule]) -> list[HostRules]:
    """The rules by host in sweep order: an interval comes before those that it holds."""
    hosts: dict[str, dict[str, tuple[str, str]]] = {}
    for rule in rules:
        if None not in rule and rule.host:
            host = rule.host.translate(str.maketrans(UPPER, LOWER))
            entry, paths = (host + rule.path, rule.verdict), hosts.setdefault(host_key(host), {})
            paths[rule.path] = min(paths.get(rule.path, entry), entry, key=lambda e: e[1])
    return [HostRules(key, sorted({len(p) for p in paths}, reverse=True), paths) for key, paths in sorted(hosts.items())]


class Sweep:
    """The stack of active hosts over keys that come in ascending order."""

    def __init__(self, rules: list[HostRules]) -> None:
        self.rules, self.at, self.stack = rules, 0, []

    def match(self, key: str, path: str) -> tuple[int, int, str, str] | None:
        """Length of the host's key and of the path, rule and verdict of the longest rule that fits."""
        rules, stack = self.rules, self.stack
        while self.at < len(rules) and rules[self.at].key <= key:
            new = rules[self.at]
            while stack and not new.key.startswith(stack[-1].key):
                stack.pop()
            if key.startswith(new.key):  # else its interval has ended before this key
                stack.append(new)
            self.at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        for host in reversed(stack):
            for n in host.lengths:
                if n <= len(path) and (found := host.paths.get(path[:n])):
                    return len(host.key), n, *found
        return None


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``default`` is the verdict of URLs that no rule fits."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit(".")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "path", "page_id"]
    swept = rows.withColumn("key", key).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = [spark.sparkContext.broadcast(_ordered(rules[k : k + RULE_BLOCK])) for k in range(0, max(1, len(rules)), RULE_BLOCK)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweeps = [Sweep(b.value) for b in blocks]
        for batch in batches:
            names, verdicts = [], []
            for k, p in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = [m for s in sweeps if (m := s.match(k, p))] if k else []
                best = max(found, key=lambda m: m[:2]) if found else None
                names.append(best[2] if best else None)
                verdicts.append(best[3] if best else default)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return swept.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
