"""WARC from legacy ARC archives.

``write_arc`` stores pages as ARC files (version 1 or 2, a gzip member per record);
``index_arc`` reads them; ``convert`` turns each ARC file into a WARC/1.1 file;
``read_warc`` reads those. An ARC file opens with a version block, whose second line
gives the version and whose third names the fields of every header line; a record is a
header line of those fields, the last of which declares the length, and that many bytes.
Conversion synthesises what ARC lacks: record ids (name-based on file and offset), ISO
timestamps, record types (response for HTTP documents, resource for others, revisit for
payloads archived before), block and payload digests. A revisit refers to the record id
of the response that has its payload.

Archives know nothing of page ids: a table beside them says which page each ARC record
(file and offset) came from, and every WARC record names its ARC record as its source.

Files live below the shared work folder, in subfolders by the first digits of their
names. A task names its files uniquely and returns the names; later steps open, inside
tasks, only files named by tasks that ended, so a task that is run again leaves no
doubles and no folder is listed. A file holds about ``FILE_BYTES`` of payload, or one
larger record.

Defined results: null html is an empty payload; a null url is written as ``unknown:``;
of equal payloads of at least ``least_bytes``, rows with the smallest page_id are
responses and the others revisit the first of them (null ids come last; if all are null,
all are responses); other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, work_dir

LEAST_BYTES = 0
FILE_BYTES = 16 << 20
MOST_TASKS = 10_000
PREFIX = 3  # digits of a file's name that name its folder
#: Payloads that occur more than once, and responses that others revisit, up to which they are broadcast.
BROADCAST_ROWS = 500_000
ARCHIVED = "20240101000000"
#: The fields of a header line by ARC version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, name space of URLs


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def deflate(record: bytes) -> bytes:
    z = zlib.compressobj(1, wbits=31)
    return z.compress(record) + z.flush()


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    at, start, z, parts = 0, 0, zlib.decompressobj(wbits=31), []
    while at < len(data):
        piece = data[at : at + step]
        parts.append(z.decompress(piece))
        at += len(piece)
        if z.eof:
            at -= len(z.unused_data)
            yield start, b"".join(parts)
            start, z, parts = at, zlib.decompressobj(wbits=31), []


def folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


class _Files:
    """Writes records to files of a bounded size, in subfolders by their names."""

    def __init__(self, path: str, ending: str):
        self.fs, self.path = folder(path)
        self.ending, self.names, self.parts, self.held, self.name = ending, [], [], 0, ""

    def open(self) -> str:
        self.name = f"{uuid.uuid4().hex}{self.ending}"
        self.names.append(self.name)
        self.parts, self.held = [], 0
        return self.name

    @property
    def offset(self) -> int:
        return self.held

    def add(self, record: bytes) -> None:
        self.parts.append(record)
        self.held += len(record)

    def close(self) -> None:
        if self.parts:
            self.fs.create_dir(f"{self.path}/{self.name[:PREFIX]}")
            with self.fs.open_output_stream(f"{self.path}/{self.name[:PREFIX]}/{self.name}", compression=None) as out:
                for part in self.parts:
                    out.write(part)
        self.parts = []


def write_arc(pages: DataFrame, path: str) -> DataFrame:
    """Write page_id, url, html as ARC files below ``path``; name, offset and page_id of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, raw, version, name = _Files(path, ".arc.gz"), FILE_BYTES, 2, ""
        for batch in batches:
            at: list[tuple[str, int]] = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                if raw >= FILE_BYTES:
                    files.close()
                    version, raw = 3 - version, 0
                    name = files.open()
                    block = f"{version} 0 sextant\n{FIELDS[version]}\n\n".encode()
                    rest = [str(len(block))] if version == 1 else ["200", "-", "-", "0", name, str(len(block))]
                    files.add(deflate(" ".join([f"filedesc://{name}", "0.0.0.0", ARCHIVED, "text/plain", *rest]).encode() + b"\n" + block))
                body = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                size = len(head) + len(body)
                at.append((name, files.offset))
                rest = [str(size)] if version == 1 else ["200", base32_sha1(body), "-", str(files.offset), name, str(size)]
                line = " ".join([quote(url or "unknown:", safe="%/:=&?~#+!$,;'@()*[]"), "0.0.0.0", ARCHIVED, "text/html", *rest])
                files.add(deflate(line.encode() + b"\n" + head + body + b"\n"))
                raw += size
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in at], pa.string()), pa.array([o for _, o in at], pa.int64()), batch.column("page_id")], names=["name", "offset", "page_id"])
        files.close()

    return stored(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "name string, offset long, page_id long"))


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and content of each record of an ARC file after its version block."""
    fields: list[str] = []
    for offset, record in members(data):
        line, _, rest = record.partition(b"\n")
        length = int(line.rsplit(b" ", 1)[1])
        if len(rest) < length:
            raise ValueError(f"ARC record at {offset} declares {length} bytes and has {len(rest)}")
        if not fields:
            version, names = rest[:length].decode().split("\n")[:2]
            fields = names.split(" ")
            if FIELDS.get(int(version.split(" ")[0])) != names:
                raise ValueError(f"unknown ARC version block: {version!r}")
            continue
        # URLs of old archives may hold spaces: fields are counted from the right.
        yield offset, dict(zip(fields, line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1))), rest[:length]


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, header bytes, payload."""
    at = block.find(b"\r\n\r\n")
    head, body = (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)
    lines = [x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:] if ":" in x]
    return {k.strip().lower(): v.strip() for k, _, v in lines}, head, body


def _opened(path: str, name: str) -> bytes:
    fs, base = folder(path)
    with fs.open_input_stream(f"{base}/{name[:PREFIX]}/{name}", compression=None) as file:
        return file.read()


def _dealt(names: DataFrame) -> DataFrame:
    return names.repartition(max(1, min(names.count(), MOST_TASKS)))


def index_arc(names: DataFrame, path: str) -> DataFrame:
    """name, offset, digest and payload length of every record of the ARC files ``names`` below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                for offset, _, content in arc_records(_opened(path, name)):
                    _, _, body = http_parts(content)
                    rows.append({"name": name, "offset": offset, "digest": base32_sha1(body), "bytes": len(body)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("offset", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64())]))

    return _dealt(names).mapInArrow(run, "name string, offset long, digest string, bytes long")


def _small(frame: DataFrame) -> DataFrame:
    """With a broadcast hint, if the (stored) frame has few rows; else a join may split its hot keys."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def revisits(index: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Per file the offsets of records that revisit an earlier page, with the file and offset of that page's record.

    index: name, offset, page_id, digest, bytes.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "name", "offset")).alias("first")
    same = index.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(first, F.count("*").alias("n"))
    same = stored(same.where("n > 1 and not first.none").select("digest", "bytes", F.col("first.page_id").alias("least"), F.col("first.name").alias("of"), F.col("first.offset").alias("place")))
    again = index.join(_small(same), ["digest", "bytes"]).where(F.col("page_id").isNull() | (F.col("page_id") > F.col("least")))
    return again.groupBy("name").agg(F.collect_list(F.struct("offset", "of", "place")).alias("again"))


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}#{offset}')}>"


def warc_record(kind: str, url: str, date: str, name: str, offset: int, block: bytes, payload_digest: str, more: dict[str, str]) -> bytes:
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(name, offset), "WARC-Target-URI": url, "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", **more, "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v).encode() + b"\r\n" + block + b"\r\n\r\n"


def iso(date: str) -> str:
    d = (date + "0101000000"[len(date) - 4 :] if len(date) < 14 else date)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(name: str, data: bytes, again: dict[int, tuple[str, int]]) -> Iterator[bytes]:
    """WARC records equivalent to an ARC file's. again: by offset, file and offset of the record that one revisits."""
    for offset, fields, content in arc_records(data):
        http, head, body = http_parts(content)
        kind, block, more = ("response", content, {}) if head else ("resource", content, {})
        if offset in again:
            kind, block, more = "revisit", head, {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(*again[offset])}
        more |= {"Content-Type": "application/http;msgtype=response" if head else fields["Content-type"], "WARC-IP-Address": fields["IP-address"], "WARC-Source-URI": f"filedesc://{name}#{offset}"}
        yield warc_record(kind, fields["URL"], iso(fields["Archive-date"]), name, offset, block, base32_sha1(body), more)


def convert(names: DataFrame, again: DataFrame, source: str, path: str) -> DataFrame:
    """Write one WARC file below ``path`` per ARC file below ``source``; returns the file names.

    Only names and revisits are joined; a task opens the files that it is dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = []
            for row in batch.to_pylist():
                files = _Files(path, ".warc.gz")
                written.append(files.open())
                for record in to_warc(row["name"], _opened(source, row["name"]), {x["offset"]: (x["of"], x["place"]) for x in row["again"] or []}):
                    files.add(deflate(record))
                files.close()
            yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], names=["name"])

    return stored(_dealt(names.join(again, "name", "left")).mapInArrow(run, "name string"))


def read_warc(names: DataFrame, path: str) -> DataFrame:
    """record_id, url, payload_bytes, payload_digest, record_type, refers_to (a record id), name and offset (of the ARC record) of every WARC record.

    A response's payload is hashed again and must agree with its digest field.
    """
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("name", pa.string()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("name").to_pylist():
                rows = []
                for offset, record in members(_opened(path, file)):
                    head, _, rest = record.partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    http, _, body = http_parts(rest[: int(fields["Content-Length"])])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and base32_sha1(body) != digest:
                        raise ValueError(f"payload of the record at {offset} does not match its digest")
                    name, _, place = fields["WARC-Source-URI"].removeprefix("filedesc://").rpartition("#")
                    rows.append({
                        "record_id": fields["WARC-Record-ID"], "url": fields["WARC-Target-URI"], "payload_bytes": int(http["content-length"]) if kind == "revisit" else len(body),
                        "payload_digest": digest, "record_type": kind, "refers_to": fields.get("WARC-Refers-To"), "name": name, "offset": int(place),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, name string, offset long"
    return _dealt(names).mapInArrow(run, kinds)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[str, DataFrame, DataFrame]:
    """Pages to ARC to WARC: the folder of the WARC files, their names, and the page of every ARC record."""
    base = work_dir(pages.sparkSession)
    origin = write_arc(pages, f"{base}/arc")
    names = stored(origin.select("name").distinct())
    index = stored(index_arc(names, f"{base}/arc").join(origin, ["name", "offset"]))
    return f"{base}/warc", convert(names, revisits(index, least_bytes), f"{base}/arc", f"{base}/warc"), origin


def identified(records: DataFrame, origin: DataFrame) -> DataFrame:
    """WARC records with the page_id of each, and that of the response as refers_to instead of its record id."""
    rows = stored(records.join(origin, ["name", "offset"]))
    asked = rows.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    found = stored(rows.select("record_id", F.col("page_id").alias("response")).join(asked, "record_id"))
    return rows.join(_small(found.withColumnRenamed("record_id", "refers_to")), "refers_to", "left").drop("refers_to", "name", "offset").withColumnRenamed("response", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, names, origin = archive(table(spark, sf_dir, "pages"))
    return identified(read_warc(names, path), origin).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, html,
    array_to_string(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(('0x' || c)::INTEGER), 4, '0')), '') AS bits FROM p
),
d AS (
  SELECT page_id, payload_bytes, html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (substr(bits, i * 5 + 1, 1)::INTEGER * 16 + substr(bits, i * 5 + 2, 1)::INTEGER * 8 + substr(bits, i * 5 + 3, 1)::INTEGER * 4
     + substr(bits, i * 5 + 4, 1)::INTEGER * 2 + substr(bits, i * 5 + 5, 1)::INTEGER + 1)::INTEGER, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first FROM h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
