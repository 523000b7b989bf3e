"""Web archives as WARC files packed in ZIP, written and read by Spark tasks.

An archive (WACZ layout) is a ZIP file with stored members: `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.cdxj`, a line a record with its place. The reader parses the end record, the ZIP64 records where there are
any, and the central directory by ranged reads, finds the members' bytes, and then fetches single records by range; nothing
is extracted. Archives are limited in size; a table lists them, so files left behind by lost tasks are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import lean, shared_dir, staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A URN that holds the page id."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 64) if page_id is None else page_id & 0xFFFFFFFFFFFFFFFF)}>"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def _field(value: str) -> str:
    """A header value on one line."""
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in value.encode("utf-8", "surrogatepass")) if not value.isascii() or any(ord(c) < 33 or ord(c) == 127 for c in value) else value


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, has_reference: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'revisit' if has_reference else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_field(url or 'urn:none')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if has_reference:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        block = http
    else:
        block = http + payload
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with small names, payload after the HTTP header) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class ArchiveWriter:
    """Writes one archive under a name of its own and gives it its place only when it is whole."""

    def __init__(self, folder: str, level: int) -> None:
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.part")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.level, self.at, self.index = level, 0, []

    def add(self, page_id: int | None, kind: str, raw: bytes) -> None:
        body = gzip.compress(raw, self.level, mtime=0)
        self.index.append(json.dumps({"page_id": page_id, "type": kind, "offset": self.at, "length": len(body)}))
        self.data.write(body)
        self.at += len(body)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index) + "\n")
        self.zip.close()
        self.out.close()
        self.fs.move(f"{self.folder}/{self.name}.part", f"{self.folder}/{self.name}")
        return self.name, len(self.index)


class ZipDirectory:
    """The stored members of a ZIP file, found by ranged reads of its directories."""

    def __init__(self, source: Any, size: int) -> None:
        self.source = source
        tail_at = max(0, size - 65_557)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = tail_at + end - 20
            mark, _, at, _ = struct.unpack("<4sIQI", self.range(locator, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, *_, entries, length, start = struct.unpack("<4sQHHIIQQQQ", self.range(at, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
        self.members: dict[str, tuple[int, int]] = {}
        directory, at = self.range(start, length), 0
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, plain, name, extra, comment, local = struct.unpack("<10xH8xII3H8xI", directory[at : at + 46])
            fields = directory[at + 46 + name : at + 46 + name + extra]
            if 0xFFFFFFFF in (packed, plain, local):
                plain, packed, local = self._zip64(fields, plain, packed, local)
            if method == zipfile.ZIP_STORED and packed == plain:
                self.members[directory[at + 46 : at + 46 + name].decode("utf-8", "replace")] = (local, plain)
            at += 46 + name + extra + comment

    @staticmethod
    def _zip64(fields: bytes, plain: int, packed: int, local: int) -> tuple[int, int, int]:
        at = 0
        while at + 4 <= len(fields):
            kind, size = struct.unpack("<HH", fields[at : at + 4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{size // 8}Q", fields[at + 4 : at + 4 + size // 8 * 8]))
                return tuple(next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
            at += 4 + size
        raise ValueError("no ZIP64 sizes")

    def range(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(length)
        if len(got) != length:
            raise ValueError("the archive ends early")
        return got

    def place(self, name: str) -> tuple[int, int]:
        """First byte and length of a stored member."""
        local, size = self.members[name]
        head = self.range(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n, extra = struct.unpack("<HH", head[26:30])
        return local + 30 + n + extra, size


def _write_batches(folder: str, level: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or ArchiveWriter(folder, level)
                writer.add(page_id, "revisit" if revisit else "response", record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit))
                if writer.at >= most_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return run


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as source:
                archive = ZipDirectory(source, source.size())
                data, length = archive.place(DATA)
                at, size = archive.place(INDEX)
                rows: list[tuple] = []
                for line in archive.range(at, size).decode().splitlines():
                    entry = json.loads(line)
                    if entry["offset"] + entry["length"] > length:
                        raise ValueError("the index points outside its archive")
                    fields, payload = parse_record(zlib.decompress(archive.range(data + entry["offset"], entry["length"]), 31))
                    kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != stated:
                        raise ValueError("a payload doesn't match its digest")
                    target = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(fields["warc-record-id"]), len(payload) if kind == "response" else None, stated, kind, target, payload if kind == "response" else None))
                    if len(rows) >= 500:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_archives(pages: DataFrame, least_bytes: int = 0, level: int = 6, most_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the table of archives (path, records).

    Of rows with equal payloads of `least_bytes` or more, the one with the largest page_id is the response and the others
    revisit it. Null html counts as empty, a null url is recorded as none; rows that repeat the response's
    page_id and payload are responses too; an empty table gives no archive.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    text = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    keyed = staged(own.select("page_id", F.sha2("html", 256).alias("key"), F.octet_length("html").alias("size")), "warc-keys")
    first = keyed.where(F.col("size") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = staged(first, "warc-first")
    again = staged(keyed.join(first, "key").where("not (page_id <=> to)").select("page_id", "key", "to").distinct(), "warc-again")
    marked = own.join(again.select(F.col("page_id").alias("p"), F.col("key").alias("k"), "to"), F.col("page_id").eqNullSafe(F.col("p")) & (F.sha2("html", 256) == F.col("k")), "left")
    rows = marked.select("page_id", "url", "html", F.col("to").alias("refers_to"), F.col("k").isNotNull().alias("revisit"))
    return staged(rows.mapInArrow(lean(_write_batches(folder, level, most_bytes)), "path string, records long"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) for each record; a revisit has no payload of its own."""
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(lean(_read_batches), ddl)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the payload_bytes of the response it refers to."""
    found = staged(records.drop("payload"), "warc-records")
    full = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("target"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("full"))
    joined = found.join(full, (F.when(F.col("record_type") == "revisit", F.col("refers_to")) == F.col("target")) & (F.col("payload_digest") == F.col("d")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
