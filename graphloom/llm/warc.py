"""WARC archives: a writer that stores each page as a gzip member, and a splittable reader.

Writing. A narrow pass finds the payload digests that occur more than once and the smallest page of each; that table
is broadcast only if a count shows it small, else it is an equi-join, which adaptive execution splits when a digest
is hot. Tasks then stream their pages to files of their own; a file counts only if its task's manifest row reaches
the driver, so a task that is run again leaves nothing behind but an unlisted file.

Reading. A split is a byte range of a file. Its task looks for the gzip magic, accepts a candidate only if the
member's head decodes to a WARC header, and owns the records that start inside the range, to their end wherever
that is. Neighbouring members are then read one after another through one buffer, so that a file is fetched once. One record is in
memory at a time, however long its page.

Nulls and odd rows: null html is an empty payload; a null url becomes about:blank; a row with a null page_id is
written without a page id, and can only be a revisit if its payload has a smallest page. Rows that repeat page and
payload are all written; those of the smallest page are all responses. Extra columns are ignored. An empty table
gives no archives and no rows. Of pages that tie in payload the smallest id is the response.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.files import make_dir, opened
from graphloom.scratch import materialise, new_path

MAGIC = b"\x1f\x8b\x08"
# Fixed values of the format: header names, profile.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
_READ = 1 << 18
_FEED = 1 << 14


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE}{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(
    pages: DataFrame,
    out: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = 100,
    broadcast_rows: int = 100_000,
    file_bytes: int = 256 << 20,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> list[tuple[str, int]]:
    """Write the pages under ``out``; returns (file, bytes) of each archive."""
    make_dir(out)
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        named.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_page")
    )
    shared = materialise(shared, "shared-payloads")
    if shared.count() <= broadcast_rows:
        shared = F.broadcast(shared)
    rows = named.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(out)
        path, sink = "", None
        done: list[tuple[str, int]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    path = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(path, compression=None)
                sink.write(record(*row, date, level))
                if sink.tell() >= file_bytes:
                    done.append((path, sink.tell()))
                    sink.close()
                    sink = None
        if sink is not None:
            done.append((path, sink.tell()))
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{p.rsplit('/', 1)[1]}" for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return [(r.path, r.bytes) for r in rows.mapInArrow(run, "path string, bytes long").collect()]


@dataclass
class Record:
    """A record as read: its headers, and its block without the HTTP head."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Cursor:
    """Reads a file forward through one buffer, so that every byte is fetched once."""

    def __init__(self, f: pa.NativeFile, at: int) -> None:
        self.f, self.at = f, at
        self.held, self.off = b"", 0

    def ahead(self, n: int) -> int:
        """How many bytes are held from here on, after fetching until they are n or the file ends."""
        while len(self.held) - self.off < n:
            more = self.f.read_at(_READ, self.at + len(self.held) - self.off)
            if not more:
                break
            self.held, self.off = self.held[self.off :] + more, 0
        return len(self.held) - self.off

    def skip(self, n: int) -> None:
        self.off += n
        self.at += n

    def begins_record(self, offset: int = 0) -> bool:
        """Whether a gzip member that decodes to a WARC header begins so many bytes from here."""
        self.ahead(offset + 512)
        try:
            return zlib.decompressobj(31).decompress(self.held[self.off + offset : self.off + offset + 512], 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def seek_record(self, end: int) -> bool:
        """Move to the first record at or behind this place that starts before ``end``."""
        while self.at < end and self.ahead(len(MAGIC)) >= len(MAGIC):
            hit = self.held.find(MAGIC, self.off) - self.off
            if hit < 0:
                self.skip(len(self.held) - self.off - len(MAGIC) + 1)
                continue
            self.skip(min(hit, end - self.at))
            if self.at < end and self.begins_record():
                return True
            self.skip(1)
        return False

    def member(self) -> bytes:
        """The decoded member here; the cursor moves behind it, or stays where it is if the member is damaged."""
        unpacker, parts, fed = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if self.ahead(fed + 1) == fed:
                raise ValueError("a record ends in the middle")
            raw = self.held[self.off + fed : self.off + fed + _FEED]
            parts.append(unpacker.decompress(raw))
            fed += len(raw)
        self.skip(fed - len(unpacker.unused_data))
        return b"".join(parts)


def records(path: str, start: int, end: int) -> Iterator[Record]:
    """The records that start in the byte range [start, end) of a file. Magic is looked for at the start of the range and
    behind damage only: a record begins where the one before it ends. Damaged stretches are skipped to the next valid member."""
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        cursor = Cursor(f, start)
        while cursor.at < end and (cursor.begins_record() or cursor.seek_record(end)):
            try:
                data = cursor.member()
            except (ValueError, zlib.error):
                cursor.skip(1)
                continue
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = _fields(head)
            block = rest[: int(headers.get("content-length", len(rest)))]
            http_head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            yield Record(headers, _fields(http_head), payload)


def _page(ref: str | None) -> int | None:
    m = re.fullmatch(rf"<{PAGE}(-?\d+)>", ref or "")
    return int(m[1]) if m else None


def read(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and the payload
    (null for revisits, or if ``payloads`` is off). Digests of responses are taken from the payload as read."""
    splits = [(p, a, min(a + split_bytes, n)) for p, n in files for a in range(0, n, split_bytes)]
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def row(r: Record) -> dict:
        stored = r.headers.get("warc-type") != "revisit"
        return {
            "page_id": _page(r.headers.get("warc-record-id")),
            "url": r.headers.get("warc-target-uri"),
            "record_type": r.headers.get("warc-type"),
            "refers_to": _page(r.headers.get("warc-refers-to")),
            "payload_bytes": len(r.payload) if stored else int(r.http.get("content-length", 0)),
            "payload_digest": hashlib.sha256(r.payload).hexdigest() if stored else r.headers.get("warc-payload-digest", "").removeprefix("sha256:"),
            "payload": r.payload if stored and payloads else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for split in b.to_pylist():
                held, size = [], 0
                for r in records(split["path"], split["a"], split["b"]):
                    held.append(row(r))
                    size += len(r.payload) if payloads else 0
                    if size > 8 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    table = spark.createDataFrame(splits, "path string, a long, b long")
    return table.repartition(max(1, len(splits))).mapInArrow(run, ddl)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a fresh folder and read the archives back: the digest of each record."""
    spark = pages.sparkSession
    files = write(pages, new_path(spark, "warc"))
    return read(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
