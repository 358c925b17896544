"""WARC archives: a writer with one gzip member a record, and a reader that can be split.

A reading task gets a byte range of a file.  It looks for the gzip magic, takes a candidate for a
member only if it decodes to a WARC header, and owns the records that start inside its range;
the last of them may end beyond it.  From there on members follow each other without a gap, and
the task that reads a range's last member also checks that another begins behind it, so that
damaged bytes anywhere are an error and no record is lost in silence.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import materialize, new_path, open_shared, table, utf8

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a reading task, of one read, and of an archive file before the next is begun.
SPLIT, READ, FILE = 8 << 20, 1 << 20, 256 << 20
LEVEL = 4
#: Compressed bytes decoded at once.
FEED = 1 << 15
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:feedloom:page:"
MANIFEST = "file string, bytes long, records long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member.  A revisit holds the HTTP head only; a missing id or URL has no header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Record-ID: <{ID}{page_id}>" if page_id is not None else f"WARC-Record-ID: <{uuid.uuid4().urn}>")
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n"), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()])


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with ``refers_to``: the smallest page_id among equal payloads.

    Null html is an empty payload.  A page without an id refers to the smallest id of its
    payload, if there is one.  Rows that repeat the smallest id are responses like it.
    Only ids and digests are grouped and joined; html moves once, by page.
    """
    pages = pages.select("page_id", "url", "html")
    keyed = pages.withColumn("_digest", F.sha1(F.coalesce("html", F.lit(""))))
    ids = keyed.select("page_id", "_digest")
    groups = ids.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisits = (
        ids.join(groups, "_digest")
        .where("refers_to is not null and (page_id is null or page_id > refers_to)")
        .select(F.col("page_id").alias("_page"), F.col("_digest").alias("_same"), "refers_to")
        .distinct()
    )
    on = keyed.page_id.eqNullSafe(revisits._page) & (keyed._digest == revisits._same)
    return keyed.join(revisits, on, "left").select("page_id", "url", "html", "refers_to")


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each attempt has files of its own; only those in the manifest of the attempts that
        # ended well are ever read
        name, out, size, count, done = "", None, 0, 0, []
        for b in batches:
            urls = b.column("url").to_pylist()
            for page, url, html, to in zip(b.column("page_id").to_pylist(), urls, utf8(b.column("html")), b.column("refers_to").to_pylist()):
                if out is None:
                    name, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(name, "w")
                html = html or b""
                data = record(page, url, html, base32_sha1(html), to)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["file", "bytes", "records"])

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``pages(page_id, url, html, refers_to)`` under ``folder``
    (a place that all executors reach) and returns the manifest (file, bytes, records)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"))
    return materialize(rows.mapInArrow(_writer(folder), MANIFEST), "warc-manifest")


class Range:
    """Bytes of a file from ``start`` on, read as needed."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data = file, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ)
        self.data += got
        return bool(got)

    def has(self, at: int) -> bool:
        """Whether there is a byte at the place."""
        while at >= self.at + len(self.data):
            if not self.more():
                return False
        return True

    def drop(self, before: int) -> None:
        del self.data[: before - self.at]
        self.at = before


class DamagedArchive(ValueError):
    pass


def members(file, start: int, end: int) -> Iterator[bytes]:
    """The decoded WARC members that start in [start, end).

    The first one of a range in the middle of a file is looked for; each further one, and that of
    the file's start, has to be there, whole, or ``DamagedArchive`` is raised.
    """
    here, at, known = Range(file, start), start, start == 0
    while at < end:
        if not known:
            while (found := here.data.find(MAGIC, at - here.at)) < 0:
                at = max(at, here.at + len(here.data) - len(MAGIC) + 1)
                if at >= end or not here.more():
                    return
                here.drop(at)
            at = here.at + found
            if at >= end:
                return
        elif not here.has(at):
            return
        if (got := _member(here, at)) is None:
            if known:
                raise DamagedArchive(f"no record where one should begin, at byte {at}")
            at += 1
            continue
        known, (text, at) = True, got
        if at - here.at > READ:
            here.drop(at)
        yield text
    if known and start < end and here.has(at) and not _begins(here, at):
        raise DamagedArchive(f"no record where one should begin, at byte {at}")


HEAD = b"WARC/1."


def _begins(here: Range, at: int) -> bool:
    """Whether a member decodes to a WARC header at the place."""
    unpack, head, pos = zlib.decompressobj(31), b"", at
    try:
        while len(head) < len(HEAD) and not unpack.eof and here.has(pos):
            fed = here.data[pos - here.at : pos - here.at + FEED]
            head += unpack.decompress(fed, len(HEAD) - len(head))
            pos += len(fed) - len(unpack.unconsumed_tail)
    except zlib.error:
        return False
    return head == HEAD


def _member(here: Range, at: int) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends; None if no WARC header is there.

    What begins as a record has to end as one."""
    if not _begins(here, at):
        return None
    unpack, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if not here.has(pos):
                raise DamagedArchive(f"the record at byte {at} is cut off")
            fed = here.data[pos - here.at : pos - here.at + FEED]
            parts.append(unpack.decompress(fed))
            pos += len(fed) - len(unpack.unused_data)
    except zlib.error as e:
        raise DamagedArchive(f"the record at byte {at} is damaged: {e}") from e
    return b"".join(parts), pos


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a decoded member."""
    top, _, rest = member.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _page(value: str | None) -> int | None:
    return int(value[len(ID) + 1 : -1]) if value and value.startswith(f"<{ID}") else None


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for b in batches:
            for path, start, end, size in zip(*(b.column(c).to_pylist() for c in ("file", "start", "end", "bytes"))):
                rows, held = [], 0
                with open_shared(path, "r") as file:
                    if file.size() != size:
                        raise DamagedArchive(f"{path} has {file.size()} bytes, not {size}")
                    for member in members(file, start, end):
                        headers, http, payload = parse(member)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        length = int(re.search(rb"(?i)^content-length: (\d+)", http, re.M)[1])
                        if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                            raise DamagedArchive(f"a record of {path} does not match its digest")
                        url = headers.get("WARC-Target-URI")
                        url = None if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
                        own = payload if with_payload and kind == "response" else None
                        rows.append((_page(headers["WARC-Record-ID"]), url, own, length, digest, kind, _page(headers.get("WARC-Refers-To"))))
                        held += len(own or b"")
                        if held > SPLIT:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Records of the files in ``manifest(file, bytes)``: page_id, url, payload (null for
    revisits), payload_bytes, payload_digest, record_type, refers_to.

    A file of another size, a damaged or cut-off record, and bytes that belong to none fail the
    read.  An empty manifest gives an empty table."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = manifest.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    splits = splits.withColumn("end", F.col("start") + split_bytes)
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(parts, "file", "start").mapInArrow(_reader(with_payload), RECORD)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT, with_payload: bool = False) -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages), folder)
    return read_archives(manifest, split_bytes, with_payload)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select page_id, h, sha1(h) as x, min(page_id) over (partition by h) as first_id from p
)
select page_id,
       cast(strlen(h) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast((cast('0x' || substr(x, cast(i // 4 * 5 + 1 as integer), 5) as bigint) >> cast(15 - i % 4 * 5 as integer)) & 31 as integer) + 1, 1)), '') as payload_digest,
       case when page_id > first_id then 'revisit' else 'response' end as record_type,
       case when page_id > first_id then first_id end as refers_to
from d
"""
