"""Legacy web archives: ARC files of version 1 and 2, and their conversion to WARC.

An archive is written by Spark's text sink as one row per file, so any file system Spark writes to will do and a
lost task repeats its files through the commit protocol. Archives are closed at a byte size, so one
always fits in a task, and they are read back whole, record by record by the lengths their headers declare.

The converter makes what ARC lacks: record identifiers (name-based UUIDs), ISO timestamps, record types, block
and payload digests, and revisit records for payloads that repeat.
"""

from __future__ import annotations

import gzip
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.llm.common import durable
from pvflow.session import work_dir

#: Bytes at which an archive is closed, and the payload size from which repeats become revisits.
ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 100
CAPTURED = "20240101000000"
PAGE_HEADER = b"X-Page-Id"

# The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Capture:
    """One archived record: its header fields by lower-case name, where it began, and its content."""

    fields: dict[str, str]
    offset: int
    block: bytes
    version: int = 0
    http: list[tuple[bytes, bytes]] = field(default_factory=list)
    payload: bytes = b""
    is_http: bool = False

    def split(self) -> Capture:
        """Separate HTTP headers and payload; a block without HTTP headers is all payload."""
        self.payload = self.block
        if self.block.startswith(b"HTTP/"):
            head, found, rest = self.block.partition(b"\r\n\r\n")
            if found:
                self.is_http, self.payload = True, rest
                for line in head.split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    self.http.append((name.strip(), value.strip()))
        return self

    def http_header(self, name: bytes) -> bytes | None:
        return next((v for n, v in self.http if n.lower() == name.lower()), None)


def _number(value: bytes | str | None) -> int | None:
    return int(value) if value else None


# --- ARC -------------------------------------------------------------------------------------------------


def arc_header(version: int, url: str, date: str, mime: str, length: int, ip: str = "0.0.0.0", name: str = "-") -> bytes:
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"{url} {ip} {date} {mime} {middle}{length}\n".encode()


def arc_start(version: int, name: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", CAPTURED, "text/plain", len(body), name=name) + body + b"\n"


def arc_record(version: int, url: str | None, block: bytes, date: str = CAPTURED) -> bytes:
    """A record; characters that would break the header line are percent-encoded, a null url is about:blank."""
    safe = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else "about:blank"
    return arc_header(version, safe, date, "text/html", len(block)) + block + b"\n"


def read_arc(data: bytes) -> Iterator[Capture]:
    """Records of an archive, the version block first. Fields follow the version the archive declares."""
    at, names, version = 0, None, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"no header line at {at}")
        values = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(values[-1])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} follow")
        if names is None:
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            names = lines[1].lower().split() if len(lines) > 1 else ARC_FIELDS[version].lower().split()
        if len(values) > len(names):  # blanks inside a content type
            at_type = names.index("content-type")
            extra = len(values) - len(names)
            values[at_type : at_type + extra + 1] = [" ".join(values[at_type : at_type + extra + 1])]
        yield Capture(dict(zip(names, values)), at, block, version)
        at = stop + 1 + length


# --- WARC ------------------------------------------------------------------------------------------------


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def iso_date(date: str) -> str:
    """The 14 digits of an ARC date (missing ones being the least) as an instant."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def to_warc(capture: Capture, revisit_of: int | None = None) -> bytes:
    """The WARC record of a split ARC record; a revisit keeps the HTTP headers and drops the payload."""
    fields, digest = capture.fields, sha256(capture.payload)
    date = iso_date(fields["archive-date"])
    if fields["url"].startswith("filedesc:"):
        block = f"software: archive converter\r\nformat: ARC {capture.version}\r\n".encode()
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(fields["url"], date)), ("WARC-Date", date)]
        return warc_record(head + [("WARC-Filename", fields["url"][11:]), ("Content-Type", "application/warc-fields")], block)
    page = _number(capture.http_header(PAGE_HEADER))
    own = record_id("page", page, digest) if page is not None else record_id(fields["url"], date, digest)
    kind = "response" if capture.is_http else "resource"
    block = capture.block
    extra: list[tuple[str, object]] = []
    if revisit_of is not None:
        kind, block = "revisit", capture.block[: len(capture.block) - len(capture.payload)]
        extra = [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id("page", revisit_of, digest)),
            ("X-Refers-To-Page-Id", revisit_of),
            ("WARC-Truncated", "length"),
        ]
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", fields["url"]),
        ("WARC-IP-Address", fields.get("ip-address")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{sha256(block)}"),
        *extra,
        ("Content-Type", "application/http; msgtype=response" if capture.is_http else fields.get("content-type")),
    ]
    return warc_record(head, block)


def read_warc(data: bytes) -> Iterator[Capture]:
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError(f"no record header at {at}")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} follow")
        yield Capture(fields, at, block)
        at = stop + 4 + length


# --- Spark jobs ------------------------------------------------------------------------------------------


def _save(archives: DataFrame, path: str, line_end: str) -> None:
    """One file per row of the binary column ``archive``; the sink adds the last record's line end."""
    rows = archives.select(F.col("archive").cast("string"))
    rows.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("lineSep", line_end).text(path)


def _stored(spark, path: str) -> DataFrame:
    """path and content of the stored archives."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _each(files: DataFrame, fn: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``fn(path, bytes, *further columns)`` makes of every stored archive."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))
    columns = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in columns]
                data = gzip.decompress(row[1]) if row[1] else b""
                made: list[dict] = []
                for r in fn(row[0], data, *row[2:]):
                    made.append(r)
                    if len(made) == 2000:
                        yield pa.RecordBatch.from_pylist(made, target)
                        made = []
                if made:
                    yield pa.RecordBatch.from_pylist(made, target)

    return files.mapInArrow(run, schema)


def write_arc(pages: DataFrame, path: str, most_bytes: int = ARCHIVE_BYTES) -> None:
    """Write page_id, url, html as ARC files of both versions: an HTTP response per page, a null html being empty.

    The checksum of the page id picks the version. Repeated rows become repeated records.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, list[bytes]] = {}
        sizes: dict[int, int] = {}

        def closed(version: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(opened.pop(version))[:-1]], pa.binary())], names=["archive"])

        for batch in batches:
            ids, urls, bodies = (batch.column(n) for n in ("page_id", "url", "html"))
            for i in range(batch.num_rows):
                page, url, html = ids[i].as_py(), urls[i].as_py(), bodies[i].as_py()
                payload = (html or "").encode()
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if page is not None:
                    head += b"%s: %d\r\n" % (PAGE_HEADER, page)
                block = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
                version = 1 + zlib.crc32(str(page).encode()) % 2
                if version not in opened:
                    opened[version] = [arc_start(version, f"pages-{page}-v{version}.arc")]
                    sizes[version] = 0
                record = arc_record(version, url, block)
                opened[version].append(record)
                sizes[version] += len(record)
                if sizes[version] >= most_bytes:
                    yield closed(version)
        for version in list(opened):
            yield closed(version)

    _save(pages.select("page_id", "url", "html").mapInArrow(pack, "archive binary"), path, "\n")


def convert(spark, arc_path: str, warc_path: str, least: int = REVISIT_BYTES) -> None:
    """Convert stored ARC files to WARC files, one for one.

    Of records with equal payloads of ``least`` bytes or more, that with the smallest page id is the response and the
    others are revisits of it; records that repeat this id as well, and groups without any id, are all responses.
    """

    def summary(path: str, data: bytes) -> Iterator[dict]:
        for c in read_arc(data):
            c.split()
            if c.is_http and len(c.payload) >= least:
                page = _number(c.http_header(PAGE_HEADER))
                yield {"path": path, "offset": c.offset, "page_id": page, "digest": hashlib.sha256(c.payload).digest()}

    files = _stored(spark, arc_path)
    seen = durable(_each(files, summary, "path string, offset bigint, page_id bigint, digest binary"), "arc-index")
    firsts = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    repeats = seen.join(firsts, "digest").where("page_id IS NULL OR page_id <> first")
    # an archive is closed at a byte size, so its list of repeats is bounded
    revisits = repeats.groupBy("path").agg(F.collect_list(F.struct("offset", "first")).alias("revisits"))

    def rewrite(path: str, data: bytes, revisits: list | None) -> Iterator[dict]:
        first_of = {r["offset"]: r["first"] for r in revisits or []}
        records = [to_warc(c.split(), first_of.get(c.offset)) for c in read_arc(data)]
        if records:
            yield {"archive": b"\r\n\r\n".join(records)}

    joined = files.join(revisits, "path", "left").select("path", "content", "revisits")
    _save(_each(joined, rewrite, "archive binary"), warc_path, "\r\n\r\n")


def read_back(spark, warc_path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url, date, record_id of stored WARC records."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, date string, record_id string"

    def rows(path: str, data: bytes) -> Iterator[dict]:
        for c in read_warc(data):
            kind = c.fields["warc-type"]
            if kind == "warcinfo":
                continue
            c.split()
            digest = c.fields["warc-payload-digest"].partition(":")[2]
            size = len(c.payload)
            if kind == "revisit":
                size = int(c.http_header(b"Content-Length") or 0)
            elif sha256(c.payload) != digest:
                raise ValueError(f"digest of {c.fields['warc-record-id']} in {path} differs")
            yield {
                "page_id": _number(c.http_header(PAGE_HEADER)),
                "payload_bytes": size,
                "payload_digest": digest,
                "record_type": kind,
                "refers_to": _number(c.fields.get("x-refers-to-page-id")),
                "url": c.fields["warc-target-uri"],
                "date": c.fields["warc-date"],
                "record_id": c.fields["warc-record-id"],
            }

    return _each(_stored(spark, warc_path), rows, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as ARC, convert the files to WARC, and return what the WARC files hold.

    One row per row of ``pages``; null ids, urls and html, empty and very long pages and repeated rows pass through as
    the functions above say. An empty table gives an empty result. Further columns, of whatever name, are left out.
    """
    spark = pages.sparkSession
    arc, warc = work_dir(spark, "arc"), work_dir(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_back(spark, warc)
