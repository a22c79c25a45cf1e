"""Web archives: legacy ARC files to WARC, and back to rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.storage import new_path, stage

#: Payloads from this size on that equal an earlier one become revisits.
REVISIT_BYTES = 1000
#: Groups of equal payloads that are broadcast to all tasks (about 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20
ARC_SCHEMA = "record_id string, url string, ip string, date string, mime string, warc_type string, page_id long, head binary, payload binary, digest string"


def _batches(rows: Iterator[tuple], names: list[str], types: list, size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _records(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    yield from _batches(((r,) for r in rows), ["record"], [pa.binary()], lambda r: len(r[0]))


def _write(records: DataFrame, path: str, separator: str) -> None:
    """Write byte strings one after another, each followed by ``separator``; Spark's writer keeps the bytes as they are."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()


def _quoted(url: str) -> str:
    """A URL as one field of a header line: white space percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url) or "about:blank"


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Write ``pages(page_id, url, html)`` as gzipped ARC files, version 1 from even and version 2 from odd partitions.

    A file begins with its version block. Null ``html`` is an empty payload, null ``url`` is ``about:blank``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"{part:06d}.arc"

        def header(url: str, mime: str, status: str, offset: int, length: int) -> bytes:
            middle = f" {status} - - {offset} {name}" if version == 2 else ""
            return f"{url} 0.0.0.0 {date} {mime}{middle} {length}\n".encode()

        def rows() -> Iterator[bytes]:
            about = f"{version} 0 emberlog\n".encode() + FIELDS[version] + b"\n"
            first = header(f"filedesc://{name}", "text/plain", "200", 0, len(about)) + about
            yield first
            at = len(first) + 1
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    head = _http(page, payload)
                    record = header(_quoted(url or ""), "text/html", "200", at, len(head) + len(payload)) + head + payload
                    yield record
                    at += len(record) + 1

        yield from _records(rows())

    _write(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "record binary"), path, "\n")


def _plain(content: bytes) -> io.BufferedReader:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))


def _split_http(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Header block with its empty line, payload, and the header's fields by lower-case name."""
    end = body.find(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or end < 0:
        return b"", body, {}
    lines = body[:end].decode("latin-1").split("\r\n")[1:]
    return body[: end + 4], body[end + 4 :], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_records(name: str, content: bytes) -> Iterator[tuple]:
    """Rows of ARC_SCHEMA from one ARC file, plain or gzipped.

    The version block names the header's fields; a file without one is told by the number of fields. The URL takes what
    the other fields leave, spaces too. A record is as long as its header declares. Identifiers come from the file's
    name, the record's place and its URL, so reading again gives the same ones.
    """
    stream, at, version = _plain(content), 0, None
    while line := stream.readline():
        begin, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue  # between records
        fields = line.split(b" ")
        width = {1: 5, 2: 10}.get(version) or (10 if len(fields) >= 10 else 5)
        if len(fields) < width or not fields[-1].isdigit():
            raise ValueError(f"{name}, byte {begin}: not an ARC header: {line[:100]!r}")
        ip, date, mime = fields[1 - width : 4 - width]
        url, length = b" ".join(fields[: 1 - width]).decode("utf-8", "replace"), int(fields[-1])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"{name}, byte {begin}: the record ends early")
        at += length
        about = begin == 0 and url.startswith("filedesc:")
        if about:
            version = int(body.split(b" ", 1)[0])
        head, payload, http = _split_http(body)
        kind = "warcinfo" if about else "response" if head else "resource"
        number = uuid.UUID(bytes=hashlib.sha1(f"{name}\0{begin}\0{url}".encode()).digest()[:16], version=5)
        stamp = date.decode().ljust(14, "0")
        when = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
        page = http.get("x-page-id", "")
        yield (f"urn:uuid:{number}", url, ip.decode("latin-1"), when, mime.decode("latin-1"), kind, int(page) if page.lstrip("-").isdigit() else None, head, payload, sha1(payload))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below ``path``, in ARC_SCHEMA; equal records come each, empty payloads are empty."""
    types = [*[pa.string()] * 6, pa.int64(), pa.binary(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in ARC_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((n.as_py().rsplit("/", 1)[-1], c.as_py()) for b in batches for n, c in zip(b.column(0), b.column(1)))
        yield from _batches((r for n, c in files for r in arc_records(n, c)), names, types, lambda r: len(r[8]) + 500)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, ARC_SCHEMA)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, revisit_bytes: int = REVISIT_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """Convert the ARC files below ``arc_path`` to gzipped WARC files.

    Identifiers, timestamps, types and SHA-1 digests are made from what an ARC record has. Of responses with equal
    payloads of ``revisit_bytes`` or more, that with the largest page id (the largest record id among equals) stays a
    response; the others become revisits that refer to it and keep their HTTP header only. Groups of equal payloads are
    counted in Spark with the largest row kept, so that a payload which a third of all pages share is no single task's.
    """
    records = read_arc(spark, arc_path)
    large = records.filter((F.col("warc_type") == "response") & (F.octet_length("payload") >= revisit_bytes)).select("digest", "page_id", "record_id", "url", "date")
    first = F.max(F.struct(F.col("page_id"), F.col("record_id"), F.col("url"), F.col("date"))).alias("first")
    groups = stage(large.groupBy("digest").agg(F.count("*").alias("n"), first).filter("n > 1").select("digest", F.col("first.record_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")), "payloads")
    again = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    joined = records.join(again, "digest", "left")
    revisit = (F.col("warc_type") == "response") & (F.octet_length("payload") >= revisit_bytes) & (F.col("first_id") != F.col("record_id"))
    revisit = F.coalesce(revisit, F.lit(False))
    rows = joined.select(
        "record_id", "url", "ip", "date", "mime", F.when(revisit, "revisit").otherwise(F.col("warc_type")).alias("warc_type"), "head", F.when(~revisit, F.col("payload")).alias("payload"), "digest",
        *(F.when(revisit, F.col(c)).alias(c) for c in ("first_id", "first_url", "first_date")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[bytes]:
            for batch in batches:
                for number, url, ip, date, mime, kind, head, payload, digest, first_id, first_url, first_date in zip(*(c.to_pylist() for c in batch.columns)):
                    block = (head or b"") + (payload or b"")
                    media = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response" if head else mime
                    if kind == "warcinfo":
                        block = f"software: emberlog\r\nformat: WARC File Format 1.1\r\nisPartOf: {url}\r\n".encode()
                    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{number}>", f"WARC-Date: {date}", f"Content-Type: {media}", f"WARC-Block-Digest: {sha1(block)}"]
                    if kind != "warcinfo":
                        lines += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: {digest}"]
                    if kind == "revisit":
                        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{first_id}>", f"WARC-Refers-To-Target-URI: {first_url}", f"WARC-Refers-To-Date: {first_date}"]
                    yield ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block

        yield from _records(out())

    _write(rows.mapInArrow(run, "record binary"), warc_path, "\r\n\r\n")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name and the block of each record of one WARC file, plain or gzipped."""
    stream = _plain(content)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if sha1(block) != fields.get("warc-block-digest", sha1(block)):
            raise ValueError(f"record {fields.get('warc-record-id')} is damaged")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, url, date, page_id, payload_bytes, payload_digest, refers_to_id, payload`` of all records
    but ``warcinfo`` below ``path``.

    A revisit has no payload; its size is the one its HTTP header declares, its digest the one its WARC header has.
    Pages without an id have a null ``page_id``; equal records come each.
    """
    schema = "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, payload binary"
    types = [*[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(content):
            kind = fields["warc-type"]
            if kind == "warcinfo":
                continue
            _, payload, http = _split_http(block)
            size = int(http.get("content-length", 0)) if kind == "revisit" else len(payload)
            digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            page = http.get("x-page-id", "")
            yield (fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), fields["warc-date"], int(page) if page.lstrip("-").isdigit() else None, size, digest, fields.get("warc-refers-to", "").strip("<>") or None, None if kind == "revisit" else payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (c.as_py() for b in batches for c in b.column(0))
        yield from _batches((r for c in files for r in rows(c)), [x.split()[0] for x in schema.split(", ")], types, lambda r: len(r[8] or b"") + 500)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as ARC, convert them to WARC, and read that back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``, the last being the page id of the response that a revisit refers to.

    Null ids stay null; rows that repeat are records of their own; other columns are left out; no rows give none.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    rows = stage(read_warc(spark, warc).drop("payload", "url", "date"), "warc-index")
    first = rows.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    plain, again = rows.filter("refers_to_id IS NULL"), rows.filter("refers_to_id IS NOT NULL")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return again.join(first, "refers_to_id").select(columns).union(plain.withColumn("refers_to", F.lit(None).cast("long")).select(columns))
