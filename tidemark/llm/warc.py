"""WARC archives with revisit resolution.

``write_archives`` stores every page as a response record (one gzip member each) and gives one header row per
record; ``resolve`` shuffles those headers by payload digest and joins each repeat to its original;
``rewrite_archives`` copies the archives with fresh headers, repeats becoming revisit records without payload;
``read_archives`` parses archives back. Payloads never go through a shuffle: only headers do.

Defined results: a null payload is an empty one; a null url leaves the target header out; a null id leaves the id
header out and sorts after all others; rows repeated with one id keep the first stored as the response; every record has an id of
its own, made from the archive and the place that it was first written to; payloads of any length are one record, read and
written whole by the task that has them; an empty table gives no rows; other columns of the input are not read. A digest shared
by very many records is one row of the table of originals, and the headers that join it are split by adaptive execution, never
gathered.

Archives are written by the executors under ``directory`` (the shared folder), each under a temporary name first and
then moved, so a task that runs again replaces the same file by the same bytes. They are read from front to back, once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, map_rows, materialize, new_path, read, sized

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, url string, payload_bytes long, payload_digest string, part_no int, file string, offset long, stored long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda c:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * c)) & 31)::INT, 1)), '')), '') AS payload_digest FROM d),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM o
"""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(file: str, offset: int) -> str:
    """Of the record that was first written to a place of an archive."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{file}|{offset}')}>"


def _field(name: str, value: object) -> str:
    """A header line; control characters, which would end it, are percent-encoded."""
    return "" if value is None else name + ": " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value)) + "\r\n"


def encode(own_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, level: int = 1) -> bytes:
    """A response record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = (
        "WARC/1.1\r\nWARC-Type: response\r\n" + _field("WARC-Record-ID", own_id) + _field("WARC-Date", DATE) + _field("WARC-Target-URI", url)
        + _field("WARC-Payload-Digest", f"sha1:{digest}") + _field("X-Page-ID", page_id) + f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    )
    return _gzip(head.encode() + http + payload + b"\r\n\r\n", level)


def encode_revisit(own_id: str, page_id: int | None, url: str | None, n_bytes: int, digest: str, to: str, to_id: int | None, to_url: str | None, level: int = 1) -> bytes:
    """A revisit record as a gzip member: it names the original and keeps the payload's digest and length, not the payload."""
    head = (
        "WARC/1.1\r\nWARC-Type: revisit\r\n" + _field("WARC-Record-ID", own_id) + _field("WARC-Date", DATE) + _field("WARC-Target-URI", url)
        + _field("WARC-Profile", PROFILE) + _field("WARC-Refers-To", to) + _field("WARC-Refers-To-Target-URI", to_url) + _field("WARC-Refers-To-Date", DATE)
        + _field("WARC-Payload-Digest", f"sha1:{digest}") + _field("X-Payload-Length", n_bytes) + _field("X-Page-ID", page_id) + _field("X-Refers-To-Page", to_id) + "Content-Length: 0\r\n\r\n"
    )
    return _gzip(head.encode() + b"\r\n\r\n", level)


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of an uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def members(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    rest = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(z.decompress(data))
        rest = z.unused_data
        yield b"".join(out)


class _Archive:
    """A file of a task, written under a temporary name and moved when whole."""

    def __init__(self, directory: str, name: str):
        self.fs, root = fs.FileSystem.from_uri(directory)
        self.path, self.temp, self.at = f"{root}/{name}", f"{root}/_temporary/{name}-{uuid.uuid4().hex}", 0
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def add(self, record: bytes) -> int:
        self.out.write(record)
        self.at += len(record)
        return self.at - len(record)

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)  # an earlier attempt's, of the same bytes; not every store's rename replaces
        self.fs.move(self.temp, self.path)


def write_archives(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A response record per row of ``pages`` in archives below ``directory``; returns the header rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, archive = f"part-{part:06d}.warc.gz", None
        for batch in batches:
            rows = []
            for page_id, url, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                archive = archive or _Archive(directory, name)
                payload = payload or b""
                record = encode(record_id(name, archive.at), page_id, url, payload, digest := digest_of(payload))
                rows.append((page_id, url, len(payload), digest, part, name, archive.add(record), len(record)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _HEADER_TYPES, strict=True)], names=_HEADER_NAMES)
        if archive:
            archive.close()

    return map_rows(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary")), write, HEADERS)


_HEADER_NAMES = [x.split()[0] for x in HEADERS.split(", ")]
_HEADER_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in HEADERS.split(", ")]
_RECORD_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers with ``record_type``, ``refers_to`` and the original's url and place: of equal payloads of ``min_bytes`` or more, the one with the smallest id stays a response."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "offset", "url")
    originals = (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "payload_bytes", F.col("first.page_id").alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.file").alias("to_file"), F.col("first.offset").alias("to_offset"))
    )
    # Written first: a short table of originals is broadcast, a long one joins by a fresh shuffle of both sides, in which adaptive execution splits a digest that very many share.
    joined = headers.join(sized(materialize(originals, "warc-originals"), 5), ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(~((F.col("file") == F.col("to_file")) & (F.col("offset") == F.col("to_offset"))), F.lit(False))
    return joined.select(
        *_HEADER_NAMES,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("to_id")).alias("refers_to"),
        *[F.when(revisit, F.col(c)).alias(c) for c in ("to_url", "to_file", "to_offset")],
    )


def rewrite_archives(resolved: DataFrame, source: str, directory: str) -> DataFrame:
    """Copy the archives below ``source`` to ``directory`` as ``resolved`` says; returns a row per new archive."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(source)
        archive = reading = None
        done: list[tuple[int, str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if reading is None or reading[0] != row["file"]:
                    if archive:
                        archive.close()
                        reading[1].close()
                    archive, reading = _Archive(directory, row["file"]), (row["file"], store.open_input_stream(f"{root}/{row['file']}", compression=None, buffer_size=1 << 20))
                    done.append([row["part_no"], row["file"], 0])
                stored, own = reading[1].read(row["stored"]), record_id(row["file"], row["offset"])  # rows come in order and leave no gap
                if row["record_type"] == "revisit":
                    record = encode_revisit(own, row["page_id"], row["url"], row["payload_bytes"], row["payload_digest"], record_id(row["to_file"], row["to_offset"]), row["refers_to"], row["to_url"])
                else:
                    fields, block = parse(zlib.decompress(stored, 31))
                    record = encode(own, row["page_id"], row["url"], payload_of(fields, block), row["payload_digest"])
                archive.add(record)
                done[-1][2] += 1
        if archive:
            archive.close()
            reading[1].close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["part_no", "file", "n_records"])

    ordered = _by_part(resolved).sortWithinPartitions("file", "offset")
    return map_rows(ordered, rewrite, "part_no int, file string, n_records long")


def _by_part(rows: DataFrame) -> DataFrame:
    """Dealt out so that each archive lies in one task and a task has one archive or few."""
    n = rows.agg(F.max("part_no")).first()[0]
    return rows.repartitionByRange((n or 0) + 1, "part_no")


def read_archives(files: DataFrame, directory: str, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``files``; digests and lengths of responses are computed from what was read."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        number = lambda x: None if x is None else int(x)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in map(parse, members(stream)):
                        response = fields["warc-type"] == "response"
                        payload = payload_of(fields, block) if response else None
                        rows.append((
                            number(fields.get("x-page-id")), fields.get("warc-target-uri"), len(payload) if response else number(fields.get("x-payload-length")),
                            digest_of(payload) if response else fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], number(fields.get("x-refers-to-page")), payload if payloads else None,
                        ))
                        held += len(block) * payloads + 200
                        if held > 4 << 20:
                            yield _record_batch(rows)
                            rows, held = [], 0
        if rows:
            yield _record_batch(rows)

    return map_rows(_by_part(files).select("file"), records, RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_RECORD_NAMES)


def deduplicate(pages: DataFrame, directory: str, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, resolve repeats, write deduplicated archives to ``<directory>/deduplicated`` and drop the first ones; returns a row per archive."""
    headers = materialize(write_archives(pages, f"{directory}/raw", **columns), "warc-headers")
    files = materialize(rewrite_archives(resolve(headers, min_bytes), f"{directory}/raw", f"{directory}/deduplicated"), "warc-files")
    drop_tables(pages.sparkSession, [f"{directory}/raw"])
    return files


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = new_path(spark, "warc", listed=False)  # read by tasks, not as a table
    files = deduplicate(read(spark, sf_dir, "pages"), directory)
    return read_archives(files, f"{directory}/deduplicated", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
