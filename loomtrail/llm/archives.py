"""Legacy ARC archives, and their conversion to WARC.

An ARC file begins with a version block: a header line, a line with the version and a line that names the fields of
the header lines of this version (five in version 1, ten in version 2). Every document follows as a header line and as many
bytes as it declares. The converter reads header lines by the fields their file names, takes the declared bytes whatever
they hold, and makes up what WARC asks for: record ids from the archive's name and the record's offset, ISO dates from
14 digits, types from scheme and status line, digests of block and payload. Of equal payloads of ``LEAST_PAYLOAD``
bytes or more, one stays a response (the greatest ``page_id``); the others become revisits that refer to it.

Archives are real files, written by Spark's text sink with the terminator of a record as line separator, and compressed as a whole;
they are read as binary files and parsed by declared lengths, so their bytes need not be text. Archives hold about
``ARCHIVE_BYTES``, more only if a single document does. Documents of one payload may be most of all: their number is counted, and
the response they refer to is joined by broadcast if they are many.

Results on edge cases: a null html is an empty payload; white space and control characters of a URL are percent-encoded, a null URL is
``-``; a null ``page_id`` writes no identifier and comes back null; equal rows are records of their own; a document
cut short by the end of its archive keeps what is there and is marked truncated; archives of other field lists
are read by these, without a length they are refused; an empty table gives archives without documents and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.counted_join import counted_join
from loomtrail.scale import stage

LEAST_PAYLOAD = 1000
ARCHIVE_BYTES = 32 << 20
SOFTWARE = "loomtrail"
IP, DATE = "0.0.0.0", "19990101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Names of the header fields by version of the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_HTTP_ID = re.compile(rb"^X-Page-Id: *(-?\d+) *\r?$", re.MULTILINE | re.IGNORECASE)
_FLUSH_BYTES = 8 << 20
#: Documents turned into rows at once.
_ROWS = 16


def safe_url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 {SOFTWARE}\n{' '.join(FIELDS[version])}\n"
    values = {"URL": f"filedesc://{name}", "IP-address": IP, "Archive-date": DATE, "Content-type": "text/plain"}
    return header_line(version, values | {"Result-code": "200", "Offset": "0", "Filename": name}, len(body)) + body.encode()


def header_line(version: int, values: dict[str, str], length: int) -> bytes:
    known = values | {"Archive-length": str(length)}
    return (" ".join(known.get(f, "-") for f in FIELDS[version]) + "\n").encode()


def http_response(html: str | None, page_id: int | None) -> bytes:
    payload = (html or "").encode()
    named = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%b\r\n"
    return head % (len(payload), named) + payload


def payload_of(block: bytes) -> bytes:
    """What follows the headers of an HTTP message; the whole of anything else."""
    if not block.startswith(b"HTTP/"):
        return block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    if not ends:
        return b""
    at, size = min(ends)
    return block[at + size :]


def _records(column: str, made: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for record in made:
        out.append(record)
        size += len(record)
        if size >= _FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=[column])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=[column])


def _write(records: DataFrame, path: str, separator: str) -> None:
    # The sink writes the bytes of its strings as they are. Archives are read once or twice, so they are packed fast.
    records.select(F.col("record").cast("string")).write.options(
        **{"lineSep": separator, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    ).text(path)


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Every page (page_id, url, html) as a document of an ARC file, versions 1 and 2 in turn."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"{part:05d}.arc"

        def made() -> Iterator[bytes]:
            first = version_block(version, name)
            yield first
            offset = len(first) + 1
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    block = http_response(html, page_id)
                    values = {"URL": safe_url(url), "IP-address": IP, "Archive-date": DATE, "Content-type": "text/html",
                              "Result-code": "200", "Offset": str(offset), "Filename": name}
                    record = header_line(version, values, len(block)) + block
                    offset += len(record) + 1
                    yield record

        return _records("record", made())

    spread = rows.repartition(int(total // archive_bytes) + 1)
    _write(spread.mapInArrow(run, "record binary"), path, "\n")
    return path


class _Source:
    """Bytes of an archive, compressed or not, with the place reached."""

    def __init__(self, content: bytes):
        raw = io.BytesIO(content)
        packed = content[:2] == b"\x1f\x8b"
        self.stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if packed else raw
        self.at = 0

    def line(self) -> bytes:
        line = self.stream.readline()
        self.at += len(line)
        return line

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.at += len(data)
        return data


def parse_arc(content: bytes) -> Iterator[dict]:
    """Documents of an ARC file: offset, header values by field, block, and whether it is cut short."""
    source, fields = _Source(content), FIELDS[1]
    while True:
        offset = source.at
        line = source.line()
        if not line:
            return
        if not line.strip():
            continue
        text = line.decode("utf-8", "surrogateescape").strip("\r\n")
        if offset == 0 and text.startswith("filedesc://"):
            # Its own header line may be of either version; both end with the length.
            body = source.read(int(text.rsplit(" ", 1)[1]))
            named = body.decode("utf-8", "replace").split("\n")
            fields = named[1].split() if len(named) > 1 and named[1].split() else fields
            if "Archive-length" not in fields:
                raise ValueError(f"an archive without lengths: {fields}")
            continue
        # Old URLs may hold spaces; no other field does.
        values = dict(zip(fields, text.rsplit(" ", len(fields) - 1)))
        length = int(values["Archive-length"])
        block = source.read(length)
        yield {"offset": offset, "values": values, "block": block, "truncated": len(block) < length}


def iso_date(digits: str) -> str:
    """14 digits, or fewer of an older archive, as an ISO date."""
    d = digits + "00000101000000"[len(digits) :] if len(digits) < 14 else digits
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_id(block: bytes) -> int | None:
    head = block[: len(block) - len(payload_of(block))]
    found = _HTTP_ID.search(head)
    return int(found[1]) if found else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Archives by name, the last part of their paths."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("archive"), "content"
    )


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Documents of all ARC files below a path; ``block`` is null if not asked for."""
    schema = pa.schema([
        ("archive", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date", pa.string()),
        ("content_type", pa.string()), ("is_http", pa.bool_()), ("page_id", pa.int64()), ("block_bytes", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("truncated", pa.bool_()), ("block", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                archive, out, size = batch.column(0)[k].as_py(), [], 0
                for d in parse_arc(batch.column(1)[k].as_py()):
                    values, block = d["values"], d["block"]
                    payload = payload_of(block)
                    out.append({
                        "archive": archive, "offset": d["offset"], "url": values["URL"], "date": values["Archive-date"],
                        "content_type": values["Content-type"], "is_http": block.startswith(b"HTTP/"),
                        "page_id": _page_id(block), "block_bytes": len(block), "payload_bytes": len(payload),
                        "payload_sha1": hashlib.sha1(payload).hexdigest(), "truncated": d["truncated"],
                        "block": block if blocks else None,
                    })
                    size += 200 + len(block) * blocks
                    if size >= _FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return _files(spark, path).mapInArrow(
        run, "archive string, offset long, url string, date string, content_type string, is_http boolean, page_id long, "
        "block_bytes long, payload_bytes long, payload_sha1 string, truncated boolean, block binary",
    )


def warc_record(headers: dict[str, str | None], block: bytes) -> bytes:
    named = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *named, f"Content-Length: {len(block)}"])
    return head.encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def _warc_info(name: str) -> bytes:
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\nconformsTo: ARC converted\r\n".encode()
    return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, 0), "WARC-Date": iso_date(DATE),
                        "WARC-Filename": name, "Content-Type": "application/warc-fields"}, block)


def _converted(row: dict) -> bytes:
    block, payload = row["block"], payload_of(row["block"])
    headers = {
        "WARC-Type": "response" if row["is_http"] else "resource",
        "WARC-Record-ID": record_id(row["archive"], row["offset"]),
        "WARC-Date": iso_date(row["date"]), "WARC-Target-URI": row["url"],
        "WARC-Payload-Digest": _digest(payload),
        "WARC-Truncated": "length" if row["truncated"] else None,
        "Content-Type": "application/http; msgtype=response" if row["is_http"] else row["content_type"],
    }
    if row["to_archive"] is not None:
        block = block[: len(block) - len(payload)]
        headers |= {
            "WARC-Type": "revisit", "WARC-Profile": PROFILE,
            "WARC-Refers-To": record_id(row["to_archive"], row["to_offset"]),
            "WARC-Refers-To-Target-URI": row["to_url"], "WARC-Refers-To-Date": iso_date(row["to_date"]),
        }
    return warc_record(headers | {"WARC-Block-Digest": _digest(block)}, block)


def revisits(records: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Documents whose payload another one keeps: archive, offset, and that one's place, URL and date."""
    own = records.where(F.col("is_http") & (F.col("payload_bytes") >= least))
    place = F.struct("page_id", "archive", "offset", "url", "date")
    kept = own.groupBy("payload_sha1", "payload_bytes").agg(F.max(place).alias("to"), F.count(F.lit(1)).alias("n"))
    found = counted_join(
        own.select("payload_sha1", "payload_bytes", "archive", "offset"), kept.where("n > 1"), ["payload_sha1", "payload_bytes"], "n"
    )
    other = (F.col("archive") != F.col("to.archive")) | (F.col("offset") != F.col("to.offset"))
    return found.where(other).select(
        "archive", "offset", *[F.col(f"to.{c}").alias(f"to_{c}") for c in ("archive", "offset", "url", "date")]
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the documents of ARC files as WARC files."""
    records = stage(read_arc(spark, arc_path, blocks=False).drop("block"), "arc-documents")
    total = records.agg(F.sum("block_bytes")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            yield _warc_info(f"{TaskContext.get().partitionId():05d}.warc")
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    yield from map(_converted, batch.slice(at, _ROWS).to_pylist())

        return _records("record", made())

    # Asked for by number: as many archives as their size needs, whatever joins use.
    blocks = read_arc(spark, arc_path).repartition(int(total // archive_bytes) + 1, "archive", "offset")
    joined = blocks.join(stage(revisits(records), "arc-revisits"), ["archive", "offset"], "left")
    columns = ["archive", "offset", "url", "date", "content_type", "is_http", "truncated", "block",
               "to_archive", "to_offset", "to_url", "to_date"]
    _write(joined.select(*columns).mapInArrow(run, "record binary"), warc_path, "\r\n\r\n")
    return warc_path


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file: header values by lower-case name, and the block of declared length."""
    source = _Source(content)
    while line := source.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {source.at - len(line)}")
        headers = {}
        while (line := source.line()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, source.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below a path, with the digest of the payload that is there; no warcinfo."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()),
                        ("refers_to", pa.string()), ("page_id", pa.int64()), ("declared_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = []
                for headers, block in parse_warc(batch.column(1)[k].as_py()):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    payload = payload_of(block)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    out.append({
                        "record_id": headers["warc-record-id"], "record_type": headers["warc-type"],
                        "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
                        "refers_to": headers.get("warc-refers-to"), "page_id": _page_id(block),
                        "declared_digest": base64.b32decode(digest).hex(), "payload_bytes": len(payload),
                        "payload_digest": hashlib.sha1(payload).hexdigest(),
                    })
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return _files(spark, path).mapInArrow(
        run, "record_id string, record_type string, url string, date string, refers_to string, page_id long, "
        "declared_digest string, payload_bytes long, payload_digest string",
    )


def resolved(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to (a page_id).

    A revisit takes them from the record it refers to. ``digest_holds`` tells whether the payload has the digest declared.
    """
    records = stage(records, "warc-records")
    own = records.where("record_type <> 'revisit'")
    again = records.where("record_type = 'revisit'").select("page_id", "refers_to", "declared_digest")
    wanted = again.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    targets = own.select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), "payload_bytes", "payload_digest"
    ).join(wanted, "refers_to")
    found = counted_join(again, targets, ["refers_to"], "n", "left")
    holds = (F.col("declared_digest") == F.col("payload_digest")).alias("digest_holds")
    return own.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), holds
    ).unionByName(found.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
        F.col("to_page").alias("refers_to"), holds,
    ))
