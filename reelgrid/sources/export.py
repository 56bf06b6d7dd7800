"""Ordered export: spans as lines of JSON, in parts that follow the order of seq, and a first line that tells of them.

Tasks write parts under names of their own; the commit, which knows all totals, moves the parts to their
final names and writes the `meta` line last, so a reader finds either a whole export or no meta. Files
in the order of their names make up the export. The folder must be one that driver and executors share,
of a file system that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import spans as S

META = "0-meta.ndjson"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Part(WriterCommitMessage):
    def __init__(self, number: int, name: str | None, lines: int, first: int | None, last: int | None):
        self.number, self.name, self.lines, self.first, self.last = number, name, lines, first, last


class LinesWriter(DataSourceWriter):
    """Rows are (seq, line); lines go out in the order they come in."""

    def __init__(self, options: dict[str, str]):
        self.path, self.meta, self.run = options["path"], json.loads(options.get("meta", "{}")), uuid.uuid4().hex

    def staged(self, name: str) -> str:
        return f"{opened(self.path)[1]}/_staged-{self.run}/{name}"

    def write(self, iterator: Iterator) -> Part:
        store, _ = opened(self.path)
        context = TaskContext.get()
        number, name, lines, first, last, out = context.partitionId(), f"{context.partitionId()}-{context.taskAttemptId()}", 0, None, None, None
        for row in iterator:
            if out is None:
                store.create_dir(self.staged("")[:-1], recursive=True)
                out = store.open_output_stream(self.staged(name))
            out.write(row[1].encode() + b"\n")
            lines, first, last = lines + 1, row[0] if first is None else first, row[0]
        if out is not None:
            out.close()
        return Part(number, name if lines else None, lines, first, last)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        parts = sorted((m for m in messages if m and m.name), key=lambda m: m.number)
        if any(a.last > b.first for a, b in zip(parts, parts[1:])):
            self.abort(messages)
            raise ValueError("parts are not in the order of seq")
        old = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name.endswith(".ndjson")]
        for path in sorted(old):  # the meta line first, so that no reader takes old parts for whole
            store.delete_file(path)
        for i, m in enumerate(parts):
            store.move(self.staged(m.name), f"{root}/1-{i:05d}.ndjson")
        with store.open_output_stream(f"{root}/_{META}") as out:
            out.write((json.dumps({"meta": self.meta | {"spans": sum(m.lines for m in parts), "parts": len(parts)}, "t": "meta"}, sort_keys=True, separators=(",", ":")) + "\n").encode())
        store.move(f"{root}/_{META}", f"{root}/{META}")
        self.drop_staged(store)

    def abort(self, messages: list[Part | None]) -> None:
        self.drop_staged(opened(self.path)[0])

    def drop_staged(self, store: fs.FileSystem) -> None:
        folder = self.staged("")[:-1]
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class OrderedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "seq long, line string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter({k.lower(): v for k, v in self.options.items()})


def write_ndjson(spans: DataFrame, path: str, cap: int = 250_000, build: str = "release", detail: int = 1) -> None:
    """The first cap spans by seq; the meta line tells how many were dropped."""
    spark = spans.sparkSession
    spark.dataSource.register(OrderedLines)
    told = S.capped(spans, cap).first()
    kept = spans.where(F.col("seq") <= told["last_seq"]) if told["last_seq"] is not None else spans
    meta = {"buildConfiguration": build, "detailLevel": detail, "droppedSpans": told["dropped"]}
    lines = S.ndjson(kept).repartitionByRange("seq").sortWithinPartitions("seq")
    lines.write.format("ordered_lines").mode("append").option("meta", json.dumps(meta)).save(path)
