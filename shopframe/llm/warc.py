"""Legacy archive converter: ARC files to WARC files.

``parse_arc`` reads an archive by its version block and the lengths that its
records declare (version 1 header lines have 5 fields, version 2 lines 10);
nothing is searched for inside contents.  ``convert`` synthesises what ARC
lacks: record identifiers (name-based UUIDs, so a repeated run gives the same
ones), W3C timestamps from 12- or 14-digit dates, record types, and base32
SHA-1 digests.  Records whose payload another record already carries become
``revisit`` records that refer to it.

At scale an archive is a file of bounded size, read and written by Spark:
archives are written by the text source (a record is a row; the format's
record end is the line separator) and read as binary files, parsed as a
stream inside a task.

Defined cases: a null URL becomes ``about:blank`` and a null payload an empty
one; blanks and control characters in URLs are percent-encoded, as header
lines are split at blanks; equal payloads, empty ones included if
``min_payload`` is 0, refer to the record with the smallest id (ties: the
smallest record identifier); rows with a null id are kept; an empty table
gives archives without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path
from .common import bounded_batches, stored

# The formats' lines.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")
#: Mean uncompressed bytes of records per archive at most.  Archives follow
#: the input's partitions; only larger ones are dealt out anew.
ARCHIVE_BYTES = 192 * 1024 * 1024

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def w3c_date(date: str) -> str:
    """``YYYYMMDDhhmm[ss]`` as a W3C timestamp; other dates become the epoch."""
    if not re.fullmatch(r"\d{12}(\d\d)?", date):
        return "1970-01-01T00:00:00Z"
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def arc_filedesc(name: str, version: str, date: str) -> bytes:
    """The first record of an archive; a blank line ends its block."""
    block = f"{version} 0 shopframe\n{ARC_TITLES[version]}\n".encode()
    blank = {"1": "", "2": " 200 - - 0 " + name}[version]
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{blank} {len(block)}\n".encode() + block


def arc_record(version: str, url: str, ip: str, date: str, kind: str, content: bytes, name: str) -> bytes:
    more = {"1": "", "2": f" 200 {sha1_base32(content)} - 0 {name}"}[version]
    return f"{url} {ip} {date} {kind}{more} {len(content)}\n".encode() + content


def _stream(data: bytes) -> io.BufferedReader:
    """A reader of the archive's bytes, unpacked if gzip (any members)."""
    import gzip

    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, 1 << 20)


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, content) of each record after the version block."""
    f = _stream(data)
    fields = None
    while line := f.readline():
        if line == b"\n":  # the end of the record before
            continue
        parts = line.rstrip(b"\r\n").decode().split(" ")
        if fields is None:
            block = f.read(int(parts[-1]))
            fields = ARC_FIELDS[block.split(b" ", 1)[0].decode()]
            continue
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line with {len(parts)} fields, {len(fields)} expected")
        head = dict(zip(fields, parts))
        content = f.read(int(head["length"]))
        if len(content) != int(head["length"]):
            raise ValueError("ARC record shorter than declared")
        yield head, content


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with their end, payload); content without an
    HTTP header is all payload."""
    at = content.find(b"\r\n\r\n")
    return (content[:at + 4], content[at + 4:]) if content.startswith(b"HTTP/") and at >= 0 else (b"", content)


def record_type(url: str, head: bytes) -> str:
    return "response" if head else "metadata" if url.startswith("dns:") else "resource"


def record_id(file: str, index: int, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file} {index} {url} {date}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{WARC_VERSION}\r\n{lines}\r\n".encode() + block


def convert(file: str, index: int, head: dict, content: bytes, first: str | None) -> bytes:
    """The WARC record (without its end) of an ARC record.  ``first``: the
    identifier of the record that carries an equal payload, if any."""
    http, payload = split_http(content)
    kind = record_type(head["url"], http)
    out = [
        ("WARC-Type", "revisit" if first else kind),
        ("WARC-Record-ID", record_id(file, index, head["url"], head["date"])),
        ("WARC-Date", w3c_date(head["date"])),
        ("WARC-Target-URI", head["url"]),
        ("WARC-IP-Address", head["ip"]),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if first:
        out += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", first)]
    block = http if first else content
    out += [
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response" if http else head["type"]),
    ]
    return warc_record(out, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    f = _stream(data)
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        yield head, f.read(int(head["Content-Length"]))


def _header(http: bytes, name: str) -> str | None:
    m = re.search(rb"\r\n" + name.encode() + rb": ([^\r\n]*)", http)
    return m[1].decode() if m else None


def _write(records: DataFrame, path: str, end: str) -> None:
    """Rows of the binary column ``record`` as gzip archives."""
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    )


def _archives(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content"
    )


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", ip: str = "0.0.0.0") -> None:
    """``page_id, url, html`` as ARC archives; every other one is of version 2.

    The content is an HTTP response whose header names the page's id."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
        F.spark_partition_id().alias("part"),
    )

    def run(batches):
        part = None
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, at in zip(*(c.to_pylist() for c in batch.columns)):
                version, name = ("1", "2")[at % 2], f"pages-{at:05d}.arc.gz"
                if part is None:
                    part = at
                    out.append(arc_filedesc(name, version, date))
                known = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(html)}\r\n\r\n"
                out.append(arc_record(version, safe_url(url), ip, date, "text/html", http.encode() + html, name))
                size += len(html)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])

    _write(rows.mapInArrow(run, "record binary"), path, "\n")


def _described(archives: DataFrame) -> DataFrame:
    """What an ARC record says of itself, without its content."""

    def run(batches):
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for i, (head, body) in enumerate(parse_arc(content)):
                    http, payload = split_http(body)
                    known = _header(http, "X-Page-Id")
                    rows.append((
                        file, i, int(known) if known else None, record_id(file, i, head["url"], head["date"]),
                        len(payload), sha1_base32(payload),
                    ))
                if rows:
                    names = ["file", "index", "page_id", "record_id", "length", "digest"]
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*rows), types)], names=names)

    return archives.mapInArrow(run, "file string, index long, page_id long, record_id string, length long, digest string")


def _revisits(described: DataFrame, min_payload: int) -> DataFrame:
    """Per archive the records that become revisits and what they refer to."""
    big = described.where(F.col("length") >= min_payload)
    # combined on the map side, so a payload with many copies is no hot spot
    firsts = (
        big.groupBy("digest", "length")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first"),
             F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "length", F.col("first.record_id").alias("first"))
    )
    return (
        big.join(firsts, ["digest", "length"])
        .where(F.col("record_id") != F.col("first"))
        .groupBy("file").agg(F.collect_list(F.struct("index", "first")).alias("revisits"))
    )


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str, min_payload: int = 0) -> None:
    """Convert every ARC archive under ``arc_path``."""
    archives = _archives(spark, arc_path)
    revisits = _revisits(stored(_described(archives), "arc-index"), min_payload)

    def run(batches):
        for batch in batches:
            for file, content, found in zip(*(c.to_pylist() for c in batch.columns)):
                first = {x["index"]: x["first"] for x in found or []}
                info = b"format: WARC File Format 1.0\r\n"
                date = "1970-01-01T00:00:00Z"
                out, size, begun = [], 0, False
                for i, (head, body) in enumerate(parse_arc(content)):
                    if not begun:
                        date, begun = w3c_date(head["date"]), True
                        out.append(warc_record([
                            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(file, -1, "", "")),
                            ("WARC-Date", date), ("WARC-Filename", file), ("Content-Type", "application/warc-fields"),
                        ], info))
                    out.append(convert(file, i, head, body, first.get(i)))
                    size += len(out[-1])
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])

    # an archive and its list: bounded rows, joined by file name
    joined = archives.join(revisits, "file", "left").select("file", "content", "revisits")
    _write(joined.mapInArrow(run, "record binary"), warc_path, WARC_END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records other than ``warcinfo``: ``record_id, page_id, url, date,
    record_type, payload_bytes, payload_digest, refers_to_id``.  Digests and
    lengths of present payloads are recomputed and must agree."""

    def run(batches):
        for batch in batches:
            for (content,) in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for head, block in parse_warc(content):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind != "revisit" and (digest, length) != (sha1_base32(payload), len(payload)):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
                    known = _header(http, "X-Page-Id")
                    rows.append((
                        head["WARC-Record-ID"], int(known) if known else None, head["WARC-Target-URI"],
                        head["WARC-Date"], kind, length, digest, head.get("WARC-Refers-To"),
                    ))
                if rows:
                    s, n = pa.string(), pa.int64()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, type=t) for v, t in zip(zip(*rows), (s, n, s, s, s, n, s, s))],
                        names=["record_id", "page_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to_id"],
                    )

    return _archives(spark, path).select("content").mapInArrow(
        run,
        "record_id string, page_id long, url string, date string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to_id string",
    )


def archive_pages(pages: DataFrame, min_payload: int = 0) -> tuple[DataFrame, str]:
    """Pages through ARC archives into WARC archives and back: the records
    as read from the WARC archives with ``refers_to`` (the id of the page
    referred to), and the archives' folder."""
    spark = pages.sparkSession
    checkpoint_root(spark)
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    size = pages.select(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    wanted = -(-size // ARCHIVE_BYTES)
    # rows are dealt out at random, by no key
    write_arc(pages.repartition(wanted) if wanted > pages.rdd.getNumPartitions() else pages, arc)
    convert_archives(spark, arc, warc, min_payload)
    records = read_warc(spark, warc)
    told = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    return records.join(told, "refers_to_id", "left"), warc
