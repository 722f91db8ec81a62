"""Web archives: reading legacy ARC files of both versions, converting them to WARC, writing and reading WARC.

An ARC file is parsed by the field names that its version block declares (version 1: five fields, version
2: ten) and each record by its declared length. The converter makes the equivalent WARC record: an
identifier (a name-based UUID), the 14-digit date as a timestamp, the record type and SHA-1 digests in
base32. Archives are written by Spark's text writer, with the two line ends that close a WARC record
as separator, so whole files need no local disk and no task holds more than a record; they are read
as binary files and parsed by declared lengths.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove, spread_join, tidy, written

FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in a file, at most, and about so many bytes of them before compression; a file is read as one value.
RECORDS_A_FILE, FILE_BYTES = 5_000, 64 << 20
#: Workers hand on records in batches of about so many bytes.
BATCH_BYTES = 8 << 20
#: Up to so many revisits are broadcast to the pages.
BROADCAST_ROWS = 200_000


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 lexloom\n{' '.join(FIELDS[version])}\n".encode()
    url = f"filedesc://{name}"
    line = f"{url} 0.0.0.0 {date} text/plain " + (f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}")
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, body: bytes, status: int = 200, name: str = "-") -> bytes:
    """One record: header line, body of the declared length, line end. Spaces in the URL are escaped."""
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") or "urn:none"
    tail = str(len(body)) if version == 1 else f"{status} - - 0 {name} {len(body)}"
    return f"{url} {ip} {date} {mime} {tail}\n".encode() + body + b"\n"


class ArcError(ValueError):
    pass


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version block first. A header that does not fit the declared fields, or a length
    beyond the end, is an error; blank lines between records are passed over."""
    at, version, names = 0, 0, FIELDS[1]
    while True:
        while at < len(data) and data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no end of the header at {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not version:
            if not line.startswith("filedesc://"):
                raise ArcError("no version block")
            length = int(line.rsplit(" ", 1)[1])
            block = data[end + 1 : end + 1 + length]
            declared = block.decode("utf-8", "replace").splitlines()
            version = int(declared[0].split()[0])
            if version not in FIELDS:
                raise ArcError(f"version {version} is unknown")
            names = tuple(declared[1].split()) if len(declared) > 1 and declared[1].startswith("URL") else FIELDS[version]
            # the block's own line may have either version's fields
            own = line.rsplit(" ", 4 if line.count(" ") < 9 else 9)
            fields = dict(zip(FIELDS[1] if len(own) == 5 else FIELDS[2], own, strict=True))
        else:
            parts = line.rsplit(" ", len(names) - 1)  # a URL may hold spaces; the other fields may not
            if len(parts) != len(names) or not parts[-1].isdigit():
                raise ArcError(f"a header of {len(parts)} fields at {at}: {line[:80]!r}")
            fields = dict(zip(names, parts, strict=True))
            length = int(parts[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ArcError(f"{length} bytes declared at {at}, {len(body)} there")
        yield ArcRecord(version, fields, body)
        at = end + 1 + length


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def timestamp(date: str) -> str:
    """A date of 4 to 14 digits as WARC has it; missing parts are the least."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block, or all of a block without one."""
    if not block.startswith(b"HTTP/"):
        return block
    head, found, rest = block.partition(END)
    return rest if found else b""


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def warc_record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode() + END + block


def to_warc(record: ArcRecord, ident: str | None = None, revisit_of: str | None = None, extra: Iterable[tuple[str, str]] = ()) -> bytes:
    """The WARC record equivalent to an ARC record; as a revisit it leaves the payload out."""
    payload = payload_of(record.body)
    http = record.body.startswith(b"HTTP/")
    sha = digest(payload)
    kind = "warcinfo" if record.url.startswith("filedesc://") else "revisit" if revisit_of else "response" if http else "resource"
    block = record.body[: len(record.body) - len(payload)] if kind == "revisit" else record.body
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", ident or record_id(record.url, record.fields["Archive-date"], sha)),
        ("WARC-Date", timestamp(record.fields["Archive-date"])),
        ("Content-Type", "application/http;msgtype=response" if http else record.fields["Content-type"]),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if kind == "warcinfo":
        headers.append(("WARC-Filename", record.url.removeprefix("filedesc://")))
    else:
        headers += [("WARC-Target-URI", record.url), ("WARC-IP-Address", record.fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", str(revisit_of))]
    return warc_record([*headers, *extra], block)


def opened(data: bytes) -> io.BufferedIOBase:
    """A file over the data, unpacked as it is read if it is gzipped (of any number of members)."""
    file = io.BytesIO(data)
    return gzip.GzipFile(fileobj=file) if data[:2] == b"\x1f\x8b" else file


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by declared lengths. Gzipped data is unpacked record by record."""
    file = opened(data)
    while line := file.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := file.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"a header without an end: {head}")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        length = int(head["Content-Length"])
        block = file.read(length)
        if len(block) < length:
            raise ValueError(f"{length} bytes declared, {len(block)} there: {head}")
        yield head, block


def convert(arcs: DataFrame) -> DataFrame:
    """(path, n, record): the WARC records of ARC files (path, content), n counting from the version block.

    Records are as bytes without the closing line ends, for write_warc(). Content may be gzipped.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                made = [to_warc(r) for r in parse_arc(plain(content.as_py() or b""))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(made), pa.string()), pa.array(range(len(made)), pa.int64()), pa.array(made, pa.binary())], ["path", "n", "record"])

    return arcs.select("path", "content").mapInArrow(tidy(rows), "path string, n long, record binary")


def plain(data: bytes) -> bytes:
    """Gzipped data of any number of members, or the data itself."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out) if out else data


def write_warc(records: DataFrame, path: str, compression: str = "gzip", records_a_file: int = RECORDS_A_FILE) -> None:
    """Write a column of records (binary or string) as WARC files of at most ``records_a_file`` records."""
    column = records.columns[0]
    records.select(F.col(column).cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", compression).option("maxRecordsPerFile", records_a_file).text(path)


def read_warc(files: DataFrame) -> DataFrame:
    """(headers map, payload binary) of the records of WARC files (path, content)."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                heads, loads, size = [], [], 0
                for head, block in parse_warc(content.as_py()):
                    heads.append(list(head.items()))
                    loads.append(payload_of(block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(loads, pa.binary())], ["headers", "payload"])
                        heads, loads, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(loads, pa.binary())], ["headers", "payload"])

    return files.select("content").mapInArrow(tidy(rows), "headers map<string,string>, payload binary")


def page_records(pages: DataFrame, min_bytes: int = 0, version: int = 2, date: str = "20200101000000") -> DataFrame:
    """(record binary): a WARC record for each page, by way of the ARC record that a legacy crawl would have.

    Of pages with equal payloads of at least ``min_bytes`` bytes the least page_id is the response and the
    others revisit it.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # equal payloads: equal lengths and SHA-256; only groups of several go on
    keyed, _ = written(base.select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("sha"), F.xxhash64("html").alias("loc")), "payloads")
    groups = keyed.where(F.col("n") >= min_bytes).groupBy("n", "sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups, beside = written(groups, "payloads")
    revisits, _ = written(spread_join(keyed, groups.drop("rows"), ["n", "sha"], groups.select("n", "sha", "rows")).where("first is not null and not (page_id <=> first)").select(F.col("page_id").alias("p"), "loc", "first").distinct(), "revisits")
    remove(pages.sparkSession, beside)
    few = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    joined = base.withColumn("own", F.xxhash64("html")).join(few, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("own") == F.col("loc")), "left").select("page_id", "url", "html", "first")
    opening = arc_header(version, "pages.arc", date)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made, size = [], 0
            for page, url, html, first in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                payload = html.as_py().encode("utf-8", "replace")
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                arc = opening + arc_record(version, url or f"urn:page:{page}", "0.0.0.0", date, "text/html", body)
                _, record = parse_arc(arc)
                sha = digest(payload)
                extra = [("X-Page-Id", str(page)), ("X-Payload-Length", str(len(payload)))]
                if first is not None:
                    extra.append(("X-Refers-To-Page", str(first)))
                made.append(to_warc(record, record_id("page", str(page), sha), None if first is None else record_id("page", str(first), sha), extra))
                size += len(made[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    return joined.mapInArrow(tidy(rows), "record binary")


def _page_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for part in parts:
        for content in part.column(0):
            cols: list[list] = [[] for _ in names]
            for head, block in parse_warc(content.as_py()):
                page, first = head["X-Page-Id"], head.get("X-Refers-To-Page")
                sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    payload = payload_of(block)
                    if digest(payload) != sha or len(payload) != int(head["X-Payload-Length"]):
                        raise ValueError(f"the payload of page {page} is not what its header says")
                for col, v in zip(cols, (None if page == "None" else int(page), int(head["X-Payload-Length"]), sha, head["WARC-Type"], None if first is None else int(first)), strict=True):
                    col.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0, version: int = 2) -> DataFrame:
    """Write a WARC record for each page under ``path`` (else in the shared folder), read the files back: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of records with equal payloads of at least ``min_bytes`` bytes the
    smallest page_id is the response; rows that repeat it are responses too, all others revisits. Pages
    without an id are responses unless an equal payload has an id. A null or blank url becomes
    urn:page:<id>. Other columns are ignored; an empty table gives an empty result. Payloads are
    read back and checked against their digests.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    write_warc(page_records(pages, min_bytes, version), path, records_a_file=int(max(1, min(RECORDS_A_FILE, FILE_BYTES // (size + 1)))))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(tidy(_page_rows), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
