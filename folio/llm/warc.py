"""WARC: a converter of legacy ARC archives, a writer and a reader.

ARC (versions 1 and 2): a file starts with a version block, `filedesc://` URL, whose first line has the version number and
whose second names the fields of all URL records. A record is one line of fields split by spaces, the last of which is
the declared length in bytes, then so many bytes, then a line feed. Version 1 has 5 fields (URL, IP, date, content type,
length), version 2 has 10 (with result code, checksum, location, offset, filename before the length).

Conversion to WARC 1.1: WARC-Record-ID is a UUID of version 5 from the URL, the date and the block's digest, so that it is the
same on each run; WARC-Date is the 14-digit date; HTTP responses become `response`, others `resource`; WARC-Block-Digest
and WARC-Payload-Digest are base32 SHA-1. Of records with equal payloads of at least `least` bytes that with the smallest page
id stays a response, the others become revisits of it (profile identical-payload-digest) without their payload; their
digest and WARC-Payload-Length still tell of the full payload.

Archives are UTF-8 texts that Spark writes and reads (any store it knows). A record ends with CR LF CR LF, which is the
writer's line separator; the reader takes whole files and cuts them at the declared lengths. Files hold a partition's share.

Nulls: a null html is an empty payload, a null url the URL `about:blank`; blanks in a URL are percent-encoded. A null page id is
written as no id and comes back as null; as the smallest of a payload it counts last. Rows that repeat a page id each get a
record; the first response is told by page id. Copies with the response's own page id are responses as well. Empty tables
give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import materialize, ship, utf8
from folio.session import temporary

FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:folio:warc")
_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(records: list[dict], version: int = 1) -> bytes:
    """An ARC file of records with url, ip, date (14 digits), content_type and body, for version 2 also the others."""
    names = " ".join(FIELDS[version])
    about = f"{version} 0 Folio\n{names}\n".encode()
    out = [_arc_line(version, "filedesc://folio.arc", "0.0.0.0", "20000101000000", "text/plain", len(about)), about, b"\n"]
    for r in records:
        out += [_arc_line(version, r["url"], r["ip"], r["date"], r["content_type"], len(r["body"])), r["body"], b"\n"]
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int) -> bytes:
    url = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url)
    more = " 200 - - 0 folio.arc" if version == 2 else ""
    return f"{url or 'about:blank'} {ip} {date} {kind}{more} {length}\n".encode()


def header_text(line: bytes) -> str:
    """A header line as text: UTF-8, or Latin-1 where it is not, as old crawlers wrote it."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def read_arc(data: bytes) -> Iterator[dict]:
    """The URL records of an ARC file, by its version's fields and declared lengths. Raises ValueError if it is broken."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = header_text(data[at:end]).split(" ")
        length = int(parts[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"an ARC record at byte {at} is cut short")
        at = end + 1 + length
        if version is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with a filedesc record")
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        if len(parts) != len(FIELDS[version]):
            raise ValueError(f"an ARC record of version {version} has {len(FIELDS[version])} fields, not {len(parts)}")
        yield dict(zip(FIELDS[version], parts, strict=True)) | {"body": body}


def _date(arc: str) -> str:
    return f"{arc[:4]}-{arc[4:6]}-{arc[6:8]}T{arc[8:10]}:{arc[10:12]}:{arc[12:14]}Z"


def record_id(url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {digest}')}>"


def to_warc(record: dict, refers_to: tuple[int, str, str] | None = None, page_id: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the CR LF CR LF at its end. refers_to: (page id, record id, URL) of the
    response that has the same payload."""
    block, url, date = record["body"], record["URL"], _date(record["Archive-date"])
    http = block.startswith(b"HTTP/")
    head, gap, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    digest = base32_sha1(payload)
    kind = ("revisit" if refers_to else "response") if http else "resource"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(url, date, base32_sha1(block))}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {record['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to[1]}", f"WARC-Refers-To-Target-URI: {refers_to[2]}", f"WARC-Refers-To-Page-ID: {refers_to[0]}"]
        block = head + gap
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {'application/http; msgtype=response' if http else record['Content-type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, cut at Content-Length. Raises ValueError if a record is broken or a digest wrong."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k: v for k, _, v in (x.partition(": ") for x in lines)}
        length = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        at = end + 4 + length
        if len(block) != length or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        at += 4
        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError("a WARC block does not have its digest")
        yield headers, block


def _arc_record(page_id: int | None, url: str, html: bytes) -> dict:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page_id is None else f"X-Page-ID: {page_id}\r\n") + f"Content-Length: {len(html)}\r\n\r\n"
    return {"url": url, "ip": "0.0.0.0", "date": "20000101000000", "content_type": "text/html", "body": head.encode() + html}


def _converted(page_id: int | None, url: str, html: bytes) -> dict:
    """A page as the ARC record that a legacy archive of the page has; even pages are kept in version 1, odd in 2."""
    return next(read_arc(write_arc([_arc_record(page_id, url, html)], 1 + (page_id or 0) % 2)))


def write_archives(pages: DataFrame, path: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Converts pages, as legacy archives, to WARC archives in the folder `path`."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("about:blank")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, links, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))
            sha, record = [], []
            for i, link, text in zip(ids, links, texts, strict=True):
                payload = text.as_buffer().to_pybytes()
                arc = _converted(i, link, payload)
                sha.append(hashlib.sha1(payload).digest())
                record.append(record_id(arc["URL"], _date(arc["Archive-date"]), base32_sha1(arc["body"])))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sha, pa.binary()), pa.array(record), pa.array([t.as_buffer().size for t in texts], pa.int64())], names=["page_id", "url", "sha", "record", "size"])

    found = rows.mapInArrow(digest, "page_id long, url string, sha binary, record string, size long").where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = found.groupBy("sha").agg(F.min(F.struct("page_id", "record", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    first = materialize(first, "responses")
    keyed = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("long", F.octet_length("html") >= least)
    joined = keyed.join(first.withColumn("long", F.lit(True)), ["sha", "long"], "left").select("page_id", "url", "html", F.col("first.page_id").alias("to_id"), F.col("first.record").alias("to_record"), F.col("first.url").alias("to_url"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = utf8(b.column(2)), []
            for i, link, text, to, record, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, *(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                refers = (to, record, target) if to is not None and to != i else None
                out.append(to_warc(_converted(i, link, text.as_buffer().to_pybytes()), refers, i))
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    joined.mapInArrow(convert, "value string").write.option("lineSep", "\r\n\r\n").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record of the WARC archives in the folder `path`."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for h, block in read_warc(data.as_buffer().to_pybytes()):
                    number = lambda name, h=h: int(h[name]) if name in h else None
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if h["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}" or number("WARC-Payload-Length") != len(payload):
                            raise ValueError("a WARC payload does not have its digest")
                    rows.append((number("WARC-Page-ID"), number("WARC-Payload-Length"), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number("WARC-Refers-To-Page-ID"), h["WARC-Record-ID"], h["WARC-Date"], h["WARC-Target-URI"]))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri"]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, _SCHEMA)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes WARC archives of pages to the shared folder and reads them back: a row for each page."""
    spark = pages.sparkSession
    ship(spark)
    path = temporary(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path)
