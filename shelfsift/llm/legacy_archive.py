"""Legacy archive converter: ARC files of version 1 and 2 become WARC files with the same content.

An ARC file begins with a ``filedesc://`` record that names the version and the fields of the header lines; each record
is a header line with the declared length at its end, and that many bytes. The converter reads each line by its file's
version, takes exactly the declared bytes, and makes up what WARC has and ARC lacks: a record id (a name-based UUID of
archive, offset, target and date, so a retried task makes the same one), the timestamp in its form, the record type,
and SHA-256 digests of block and payload. Of records with equal payloads of at least REVISIT_BYTES bytes, the one with
the smallest page id (then archive and offset) becomes the response, and the others revisits that refer to it.

Archives are rows (name, content) of a Parquet folder of at most about ARCHIVE_BYTES each, so Spark's commit protocol
guards them on any shared store. Which records revisit which is found on digests alone, and handed to each archive's
task as a list no longer than the archive's records; equal payloads are never gathered.

Defined cases: a null html is empty; a null or blank url is written as ``unknown:``; blanks and control signs in urls
are percent-encoded; a page longer than an archive is an archive of its own, read whole in one task; a null page id is
greater than all others; of records tied on the smallest page id, the first by archive and offset is the response;
repeated rows are records of their own; an empty table gives no archives and reads back empty; columns but page_id, url
and html are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm.support import SMALL_ROWS, inputs, new_folder, stored

ARCHIVE_BYTES = 4 << 20
REVISIT_BYTES = 100
# Revisit lists are copied to the archives up to so many bytes of URLs.
SMALL_URLS = 32 << 20
# Compressed records are read in steps of so many bytes.
PIECE = 1 << 16
NO_ID = (1 << 63) - 1

# The header lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, content binary"
_SPACE = re.compile(r"[\x00-\x20\x7f]")
_PAGE_ID = re.compile(rb"^X-Page-Id: (-?[0-9]+)\r?$", re.M)
_LENGTH = re.compile(rb"^Content-Length: ([0-9]+)\r?$", re.M | re.I)


def _target(url: str | None) -> str:
    return _SPACE.sub(lambda sign: f"%{ord(sign[0]):02X}", url or "") or "unknown:"


def _arc_record(page_id: int | None, url: str | None, html: bytes, version: int, date: str, name: str, offset: int) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    block = f"{head}Content-Length: {len(html)}\r\n\r\n".encode() + html
    known = [_target(url), "0.0.0.0", date, "text/html"]
    if version == 2:
        known += ["200", f"{zlib.crc32(block):08x}", "-", str(offset), name]
    return " ".join([*known, str(len(block))]).encode() + b"\n" + block + b"\n"


def _arc_start(version: int, date: str, name: str) -> bytes:
    block = f"{version} 0 crawl\n{FIELDS[version]}\n\n".encode()
    known = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        known += ["200", "-", "-", "0", name]
    return " ".join([*known, str(len(block))]).encode() + b"\n" + block


def write_arc(pages: DataFrame, date: str = "20000101000000", folder: str | None = None) -> str:
    """Write ``pages`` (page_id, url, html) as ARC files, versions 1 and 2 in turn; returns the folder."""
    folder = folder or new_folder(pages.sparkSession, "arc")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, content = TaskContext.get().partitionId(), 0, bytearray()

        def name() -> str:
            return f"legacy-{part:06d}-{number:06d}.arc"

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                version = 1 + number % 2
                if not content:
                    content += _arc_start(version, date, name())
                page = (html.as_py() or "").encode()
                content += _arc_record(page_id, url.as_py(), page, version, date, name(), len(content))
                if len(content) >= ARCHIVE_BYTES:
                    yield _archive(name(), bytes(content))
                    number, content = number + 1, bytearray()
        if content:
            yield _archive(name(), bytes(content))

    rows = inputs(pages, page_id="page_id", url="url", html="html").withColumn("page_id", F.col("page_id").cast("bigint"))
    rows.mapInArrow(archives, ARCHIVES).write.option("compression", "zstd").parquet(folder)
    return folder


def _archive(name: str, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])


@dataclass
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes

    @property
    def header(self) -> bytes:
        """The HTTP header with its empty line; empty for other blocks."""
        end = self.block.find(b"\r\n\r\n")
        return self.block[: end + 4] if self.block.startswith(b"HTTP/") and end >= 0 else b""

    @property
    def payload(self) -> bytes:
        return self.block[len(self.header) :]


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, by the version that its first record declares."""
    at, fields = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "surrogateescape")
        if fields is None:
            length = int(line.rsplit(" ", 1)[1])
            start = content[end + 1 : end + 1 + length].decode().splitlines()
            version = int(start[0].split(" ", 1)[0])
            if not line.startswith("filedesc://") or version not in FIELDS:
                raise ValueError("not an ARC file of version 1 or 2")
            fields = start[1].split(" ")
            at = end + 1 + length
            continue
        # the target may hold blanks in files of careless writers: fields are counted from the end
        values = dict(zip(fields, line.rsplit(" ", len(fields) - 1)))
        length = int(values["Archive-length"])
        block = content[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError("an ARC record is cut off")
        yield ArcRecord(at, values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], block)
        at = end + 1 + length


def _record_id(archive: str, offset: int, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{offset}/{date}/{url}')}>"


def _warc_date(date: str) -> str:
    date = date.ljust(14, "0")
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _warc_record(lines: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    text = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogateescape")
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(text + block + b"\r\n\r\n") + squeeze.flush()


def _as_warc(record: ArcRecord, archive: str, original: dict | None) -> bytes:
    header, payload = record.header, record.payload
    kind = "revisit" if original else "response" if header else "resource"
    block = header if original else record.block
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(archive, record.offset, record.url, record.date)),
        ("WARC-Date", _warc_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip if record.ip not in ("0.0.0.0", "-") else None),
        ("Content-Type", "application/http; msgtype=response" if header else record.mime),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Payload-Digest", _digest(payload)),
    ]
    if original:
        lines += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", original["record_id"]),
            ("WARC-Refers-To-Target-URI", original["url"]),
            ("WARC-Refers-To-Date", _warc_date(original["date"])),
        ]
    return _warc_record(lines, block)


def _warc_start(archive: str) -> bytes:
    text = f"software: shelfsift\r\nformat: WARC File Format 1.1\r\nconverted-from: {archive}\r\n".encode()
    lines = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(archive, -1, "", "")),
        ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"),
        ("WARC-Filename", archive.removesuffix(".arc") + ".warc.gz"),
    ]
    return _warc_record(lines, text)


_KEYS = "archive string, offset bigint, page_id bigint, digest binary, url string, date string"


def _records(arcs: DataFrame) -> DataFrame:
    """What decides on revisits, of every record whose payload is long enough."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for r in read_arc(content.as_py()):
                    payload = r.payload
                    if len(payload) >= REVISIT_BYTES and r.header:
                        found = _PAGE_ID.search(r.header)
                        rows.append((archive, r.offset, int(found[1]) if found else NO_ID,
                                     hashlib.sha256(payload).digest(), r.url, r.date))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _KEYS.split(", ")]
                    )

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    return arcs.mapInArrow(keys, _KEYS)


def convert(spark: SparkSession, arc_folder: str, folder: str | None = None) -> str:
    """Convert a folder of ARC files to a folder of WARC files; returns it."""
    folder = folder or new_folder(spark, "warc")
    arcs = spark.read.schema(ARCHIVES).parquet(arc_folder)
    keys = stored(_records(arcs), "arc-keys")
    first = keys.groupBy("digest").agg(
        F.min(F.struct("page_id", "archive", "offset", "url", "date")).alias("first"), F.count("*").alias("n")
    )
    first = first.where("n > 1").select("digest", "first")
    again = keys.join(first, "digest").where(
        (F.col("archive") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset"))
    )
    again = stored(again.select("archive", "offset", "first"), "arc-revisits")
    lists = again.groupBy("archive").agg(
        F.collect_list(F.struct("offset", F.col("first.archive").alias("of_archive"), F.col("first.offset").alias("of_offset"),
                                F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("revisits")
    ).withColumnRenamed("archive", "of")

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, revisits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                originals = {
                    r["offset"]: r | {"record_id": _record_id(r["of_archive"], r["of_offset"], r["url"], r["date"])}
                    for r in revisits.as_py() or ()
                }
                out = bytearray(_warc_start(archive))
                for record in read_arc(content.as_py()):
                    out += _as_warc(record, archive, originals.get(record.offset))
                yield _archive(archive.removesuffix(".arc") + ".warc.gz", bytes(out))

    # short lists go to the archives; only where they are long do archives go to their lists
    size = again.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("first.url")), F.lit(0))).first()
    if size[0] <= SMALL_ROWS and size[1] <= SMALL_URLS:
        lists = F.broadcast(lists)
    met = arcs.join(lists, arcs["archive"] == lists["of"], "left").select("archive", "content", "revisits")
    met.mapInArrow(converted, ARCHIVES).write.option("compression", "none").parquet(folder)
    return folder


def _members(content: bytes) -> Iterator[bytes]:
    at, view = 0, memoryview(content)
    while at < len(view):
        gunzip, parts = zlib.decompressobj(31), []
        while not gunzip.eof and at < len(view):
            parts.append(gunzip.decompress(view[at : at + PIECE]))
            at = min(len(view), at + PIECE)
        yield b"".join(parts) + gunzip.flush()
        at -= len(gunzip.unused_data)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The response and revisit records: page_id, record_id, record_type, url, date, payload_bytes, payload_digest
    (lower-case hex), refers_to_id, and payload (null for revisits). Digests of blocks are verified."""
    names = ["page_id", "record_id", "record_type", "url", "date", "payload_bytes", "payload_digest", "refers_to_id", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for member in _members(content.as_py()):
                    head, _, rest = member.partition(b"\r\n\r\n")
                    lines = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
                    block = rest[: int(lines["Content-Length"])]
                    if lines["WARC-Type"] not in ("response", "revisit"):
                        continue
                    if _digest(block) != lines["WARC-Block-Digest"]:
                        raise ValueError("a WARC block does not have its digest")
                    revisit = lines["WARC-Type"] == "revisit"
                    header, _, payload = block.partition(b"\r\n\r\n")
                    page = _PAGE_ID.search(header)
                    size = int(_LENGTH.search(header)[1]) if revisit else len(payload)
                    digest = lines["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((int(page[1]) if page else None, lines["WARC-Record-ID"], lines["WARC-Type"],
                                 lines["WARC-Target-URI"], lines["WARC-Date"], size, digest,
                                 lines.get("WARC-Refers-To"), None if revisit else payload))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    schema = (
        "page_id bigint, record_id string, record_type string, url string, date string, payload_bytes bigint, "
        "payload_digest string, refers_to_id string, payload binary"
    )
    return spark.read.schema(ARCHIVES).parquet(folder).mapInArrow(records, schema)


def resolve(records: DataFrame) -> DataFrame:
    """``read_warc`` rows without payloads, with ``refers_to``: the page id of the response that a revisit refers to."""
    light = stored(records.drop("payload"), "warc-records")
    responses = light.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    revisits = light.where("record_type = 'revisit'").join(responses, "refers_to_id", "left")
    plain = light.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint"))
    return plain.unionByName(revisits)
