"""A ZIP archive as a Python data source whose members spread over tasks.

    spark.dataSource.register(ZipPages)
    spark.read.format("zip_pages").option("path", "/shared/site.zip").load()

Planning reads the central directory alone: the rules of ``files.archive_problems`` are enforced before any member is read,
and members are dealt to tasks by their sizes, in path order. Each task opens the archive for its own members, one at a time,
so none holds the archive. The path must be on a file system that all nodes mount.

Options: ``path``; ``sha256`` (of the archive, checked as a stream when planning); ``suffix`` (of member names, default
``.html``); ``taskBytes`` (of members a task, default 16 MiB); ``maxMembers``, ``maxMemberBytes``, ``maxTotalBytes``.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.sources.files import _kind, archive_problems


class ZipPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_pages"

    def schema(self) -> str:
        return "logical_path string, content string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Members(InputPartition):
    def __init__(self, names: list[str]) -> None:
        super().__init__(names)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        if "path" not in options:
            raise ValueError("zip_pages needs a path")
        self.path, self.sha256, self.suffix = options["path"], options.get("sha256"), options.get("suffix", ".html").lower()
        number = lambda key, default: int(options.get(key, default))
        self.task_bytes = number("taskBytes", 1 << 24)
        self.limits = number("maxMembers", 10_000), number("maxMemberBytes", 1 << 26), number("maxTotalBytes", 1 << 30)

    def partitions(self) -> list[InputPartition]:
        if self.sha256:
            with open(self.path, "rb") as raw:
                if hashlib.file_digest(raw, "sha256").hexdigest() != self.sha256:
                    raise ValueError("archive SHA-256 differs")
        with zipfile.ZipFile(self.path) as z:
            infos = z.infolist()
        if problems := archive_problems(infos, *self.limits):
            raise ValueError("archive refused: " + ", ".join(f"{problem} {path or ''}".strip() for path, problem in problems[:5]))
        pages = sorted((i.filename, i.file_size) for i in infos if _kind(i) == "file" and i.filename.lower().endswith(self.suffix))
        out, names, size = [], [], 0
        for name, n in pages:
            if names and size + n > self.task_bytes:
                out.append(_Members(names))
                names, size = [], 0
            names.append(name)
            size += n
        return [*out, _Members(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, int]]:
        most = self.limits[1]
        with zipfile.ZipFile(self.path) as z:
            for name in partition.value:
                with z.open(name) as member:
                    body = member.read(most + 1)
                if len(body) > most:
                    raise ValueError(f"archive refused: {name} is larger than it claims")
                yield name, body.decode("utf-8", "replace"), len(body)
