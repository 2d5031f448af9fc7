"""A Python data source of NDJSON lines with their offsets: ``spark.dataSource.register(LineSource)``, then format "tidemark_lines".

Rows are (offset, line), the offset being the byte where the line starts, so a reader goes on from an offset without reading
what lies before it, and a batch splits into ranges of bytes that executors read by themselves. Lines that aren't JSON take
offsets but give no rows. ``path`` is a file that the executors can open; ``bytes_per_partition`` sizes the ranges.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "offset long, line string"


class ByteRange(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


def ranges(start: int, end: int, size: int) -> list[InputPartition]:
    return [ByteRange(a, min(a + size, end)) for a in range(start, end, size)] or [ByteRange(start, start)]


def lines(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """Valid lines that start in [start, end)."""
    if start >= end or not os.path.exists(path):
        return
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the line that started before, if any, belongs to the range before
        while (at := f.tell()) < end and (raw := f.readline()):
            try:
                json.loads(raw)
            except ValueError:
                continue
            yield at, raw.decode("utf-8").rstrip("\r\n")


def whole_size(path: str) -> int:
    """Bytes up to the end of the last line that is whole."""
    if not os.path.exists(path):
        return 0
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        while size:
            step = min(size, 1 << 16)
            f.seek(size - step)
            at = f.read(step).rfind(b"\n")
            if at >= 0:
                return size - step + at + 1
            size -= step
    return 0


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("bytes_per_partition", 64 << 20))
        self.start = int(options.get("starting_offset", 0))


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def partitions(self) -> list[InputPartition]:
        return ranges(self.options.start, whole_size(self.options.path), self.options.size)

    def read(self, partition: ByteRange) -> Iterator[tuple[int, str]]:
        return lines(self.options.path, partition.start, partition.end)


class LineStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def initialOffset(self) -> dict[str, int]:
        return {"byte": self.options.start}

    def latestOffset(self) -> dict[str, int]:
        return {"byte": whole_size(self.options.path)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        return ranges(start["byte"], end["byte"], self.options.size)

    def read(self, partition: ByteRange) -> Iterator[tuple[int, str]]:
        return lines(self.options.path, partition.start, partition.end)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineStreamReader(self.options)
