"""A data source and sink for Redis-protocol streams (Redis, Valkey), over plain sockets: format "tidemark_redis".

Options: ``host`` (127.0.0.1), ``port`` (6379), ``stream``, ``password``, ``starting_id`` (0), ``max_len`` for writes (0: no trim)
and ``partitions`` for batch reads. Rows are (msg_id, fields), the fields a map of strings. A stream reader's position is the
last id that it has planned, compared by number and not as text; reading never deletes, so a micro-batch can be read again.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = T.StructType([T.StructField("msg_id", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
PAGE = 1000


def id_of(text: str) -> tuple[int, int]:
    high, _, low = text.partition("-")
    return int(high), int(low or 0)


def text_of(id_: tuple[int, int]) -> str:
    return f"{id_[0]}-{id_[1]}"


class Client:
    """As much of the protocol as streams need."""

    def __init__(self, options: dict[str, str]):
        self.socket = socket.create_connection((options.get("host", "127.0.0.1"), int(options.get("port", 6379))), timeout=30)
        self.file = self.socket.makefile("rb")
        if options.get("password"):
            self.call("AUTH", options["password"])

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()
        self.socket.close()

    def call(self, *words: str) -> object:
        parts = [str(w).encode() for w in words]
        self.socket.sendall(b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%b\r\n" % (len(p), p) for p in parts))
        return self._reply()

    def _reply(self) -> object:
        line = self.file.readline()
        if not line:
            raise ConnectionError("the server closed the connection")
        kind, rest = line[:1], line[1:-2]
        if kind == b"-":
            raise RuntimeError(rest.decode())
        if kind == b":":
            return int(rest)
        if kind == b"$":
            if int(rest) < 0:
                return None
            return self.file.read(int(rest) + 2)[:-2].decode()
        if kind == b"*":
            return None if int(rest) < 0 else [self._reply() for _ in range(int(rest))]
        return rest.decode()

    def entries(self, stream: str, after: tuple[int, int], until: tuple[int, int] | None) -> Iterator[tuple[str, dict[str, str]]]:
        """Entries with ids in (after, until], a page at a time."""
        while True:
            page = self.call("XRANGE", stream, "(" + text_of(after), "+" if until is None else text_of(until), "COUNT", str(PAGE)) or []
            yield from map(_entry, page)
            if len(page) < PAGE:
                return
            after = id_of(page[-1][0])

    def ensure_group(self, stream: str, group: str, start: str = "0") -> None:
        """Make a consumer group that reads from an id on ("0": all, "$": what comes from now on); one that exists stays as it is."""
        try:
            self.call("XGROUP", "CREATE", stream, group, start, "MKSTREAM")
        except RuntimeError as reply:
            if not str(reply).startswith("BUSYGROUP"):
                raise

    def read_group(self, stream: str, group: str, consumer: str, count: int) -> list[tuple[str, dict[str, str]]]:
        """The next entries that no consumer of the group has; they are pending until acknowledged."""
        reply = self.call("XREADGROUP", "GROUP", group, consumer, "COUNT", str(count), "STREAMS", stream, ">") or []
        return [_entry(x) for _, page in reply for x in page]

    def ack(self, stream: str, group: str, ids: list[str]) -> int:
        return sum(int(self.call("XACK", stream, group, *ids[i : i + PAGE])) for i in range(0, len(ids), PAGE))

    def pending(self, stream: str, group: str, min_idle_ms: int, count: int) -> list[tuple[str, str, int, int]]:
        """(id, consumer, idle ms, deliveries) of entries that were delivered and not acknowledged for so long, the oldest first."""
        return [(i, c, int(idle), int(n)) for i, c, idle, n in self.call("XPENDING", stream, group, "IDLE", str(min_idle_ms), "-", "+", str(count)) or []]

    def claim(self, stream: str, group: str, consumer: str, min_idle_ms: int, ids: list[str]) -> list[tuple[str, dict[str, str]]]:
        """Take pending entries over; those that another consumer was quicker with don't come."""
        return [_entry(x) for x in (self.call("XCLAIM", stream, group, consumer, str(min_idle_ms), *ids) or [] if ids else []) if x]

    def last(self, stream: str) -> tuple[int, int]:
        page = self.call("XREVRANGE", stream, "+", "-", "COUNT", "1") or []
        return id_of(page[0][0]) if page else (0, 0)


def _entry(reply: list) -> tuple[str, dict[str, str]]:
    msg_id, flat = reply
    return msg_id, dict(zip(flat[::2], flat[1::2], strict=True))


class IdRange(InputPartition):
    def __init__(self, after: tuple[int, int], until: tuple[int, int]):
        super().__init__((after, until))
        self.after, self.until = after, until


def split(after: tuple[int, int], until: tuple[int, int], parts: int) -> list[InputPartition]:
    """Ranges of ids, cut by their time part."""
    if until <= after:
        return [IdRange(after, after)]
    cuts = sorted({after[0] + (until[0] - after[0]) * i // parts for i in range(1, parts)} - {after[0], until[0]})
    ends = [after, *((c, 0) for c in cuts), until]
    return [IdRange(a, b) for a, b in zip(ends, ends[1:], strict=False)]


class _Reads:
    def __init__(self, options: dict[str, str]):
        self.options, self.start = dict(options), id_of(options.get("starting_id", "0"))

    def last(self) -> tuple[int, int]:
        with Client(self.options) as client:
            return client.last(self.options["stream"])

    def read(self, partition: IdRange) -> Iterator[tuple[str, dict[str, str]]]:
        if partition.after < partition.until:
            with Client(self.options) as client:
                yield from client.entries(self.options["stream"], partition.after, partition.until)


class BatchReader(_Reads, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return split(self.start, self.last(), int(self.options.get("partitions", 4)))


class StreamReader(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, str]:
        return {"id": text_of(self.start)}

    def latestOffset(self) -> dict[str, str]:
        return {"id": text_of(max(self.start, self.last()))}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[InputPartition]:
        return split(id_of(start["id"]), id_of(end["id"]), int(self.options.get("partitions", 4)))


@dataclass
class Written(WriterCommitMessage):
    rows: int


class _Writes:
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, rows: Iterator[Row]) -> Written:
        """Each row's ``fields`` map, or else its columns, as an entry; nulls are empty."""
        n, trim = 0, int(self.options.get("max_len", 0))
        with Client(self.options) as client:
            for row in rows:
                values = row.asDict()
                fields = values["fields"] if set(values) <= {"msg_id", "fields"} else values
                flat = [x for k, v in fields.items() for x in (k, "" if v is None else str(v))]
                client.call("XADD", self.options["stream"], *(("MAXLEN", "~", str(trim)) if trim else ()), "*", *flat)
                n += 1
        return Written(n)


class BatchWriter(_Writes, DataSourceWriter):
    pass


class StreamWriter(_Writes, DataSourceStreamWriter):
    """At least once: entries of a batch that runs again are added again, and readers tell them by their event ids."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        pass

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        pass


class RedisSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_redis"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return StreamReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return StreamWriter(self.options)
