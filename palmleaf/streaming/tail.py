"""A journal that grows: a streaming source that remembers byte offsets.

Only records that end with a line feed are read, so a half-written one waits; broken records are skipped. A file
that was cut, or cut and grown again, is told by the bytes before the known offset, and is read from its start as a new
generation. ``seq`` orders records over generations: generation x 2^48 + offset, where a generation is
the time in milliseconds at which it was first seen, so it also grows over restarts. On a cluster the path must be a folder that
all executors mount. Register the source with ``spark.dataSource.register(JournalTail)``, read it with ``format("journal_tail")``.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MARK_BYTES = 256


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, generation: int):
        self.path, self.start, self.end, self.generation = path, start, end, generation


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"at": 0, "generation": 0, "mark": ""}

    def latestOffset(self) -> dict:
        """The end of the last whole record, its generation, and the mark of the bytes before it."""
        try:
            size = os.path.getsize(self.path)
        except OSError:
            return self.known or self.initialOffset()
        same = self.known is not None and size >= self.known["at"] and mark(self.path, self.known["at"]) == self.known["mark"]
        start = self.known["at"] if same else 0
        generation = self.known["generation"] if same else max(time.time_ns() // 1_000_000, (self.known or {}).get("generation", 0) + 1)
        at = whole_until(self.path, start, size)
        self.known = {"at": at, "generation": generation, "mark": mark(self.path, at)}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """What came after ``start``: the rest of its generation, or the whole of a new one.

        After a restart the same file has a new generation, but its bytes before the start are the same.
        """
        same = end["generation"] == start["generation"] or (end["at"] >= start["at"] and mark(self.path, start["at"]) == start["mark"])
        a = start["at"] if same else 0
        return [_Span(self.path, a, end["at"], end["generation"])] if end["at"] > a else []

    def read(self, partition: _Span) -> Iterator[tuple]:
        base = partition.generation << 48
        for at, *rest in records(partition.path, partition.start, partition.end):
            yield Decimal(base + at), *rest

    def commit(self, end: dict) -> None:
        pass


def mark(path: str, at: int) -> str:
    """A hash of the last bytes before an offset, and of the first ones of the file."""
    with open(path, "rb") as f:
        head = f.read(min(MARK_BYTES, at))
        f.seek(max(0, at - MARK_BYTES))
        return hashlib.sha256(head + b"|" + f.read(min(MARK_BYTES, at))).hexdigest()[:16]


def whole_until(path: str, start: int, size: int) -> int:
    """The offset behind the last line feed in [start, size)."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            step = min(1 << 16, at - start)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
    return start


def records(path: str, start: int, end: int) -> Iterator[tuple]:
    """(offset, url, status, error) of the records in [start, end)."""
    with open(path, "rb") as f:
        f.seek(start)
        at = start
        for raw in f:
            if at >= end:
                break
            here, at = at, at + len(raw)
            try:
                r = json.loads(raw)
                state = r["state"]
                yield here, str(r["url"]), state.get("status"), state.get("error")
            except (ValueError, KeyError, TypeError, AttributeError):
                continue


class JournalTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal_tail"

    def schema(self) -> str:
        return "seq decimal(38,0), url string, status string, error string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])
