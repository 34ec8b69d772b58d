"""WARC records in ZIP archives.

Writing: every task packs its pages into one ZIP file with two stored members,
``records.warc`` and ``index.cdxj``. Reading: the end of an archive leads to
its (ZIP64) directory, the directory to the stored members, the index member to
the records, and records are read by byte ranges; nothing is unpacked. Index
lines, not archives, are dealt to the reading tasks, so a large archive is read
by many.

Archives lie in a shared folder and are reached through ``pyarrow.fs``, for
local and cluster file systems alike. A retried task writes a file of its own
name, and only files named by finished tasks are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import column, flagged, stored
from tandem.session import scratch_path

RECORDS, INDEX = "records.warc", "index.cdxj"
PAGES_PER_ARCHIVE = 20_000
INDEX_LINES_PER_TASK = 20_000
DATE = "2020-01-01T00:00:00Z"
IDENTICAL = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
# Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
LOCAL_HEAD = struct.Struct("<4s5H3L2H")
CENTRAL_HEAD = struct.Struct("<4s6H3L5H2L")
END_HEAD = struct.Struct("<4s4H2LH")
END64_HEAD = struct.Struct("<4sQ2H2L4Q")
LOCATOR_HEAD = struct.Struct("<4sLQL")
NO16, NO32 = 0xFFFF, 0xFFFFFFFF


# ---- ZIP --------------------------------------------------------------------
@dataclass
class Member:
    name: str
    method: int
    size: int
    head: int  # offset of the local header


class StoredZip:
    """Writes stored members of any size to an output stream; sizes and
    checksums are kept in a descriptor after the data and in a ZIP64 directory."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64
        self.crc = self.size = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.head, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<2H2Q", 1, 16, 0, 0) if self.zip64 else b""
        sizes = NO32 if self.zip64 else 0
        self._write(LOCAL_HEAD.pack(LOCAL, 45, 8, 0, 0, 33, 0, sizes, sizes, len(self.name), len(extra)) + self.name + extra)

    def add(self, data: bytes) -> int:
        """Append to the open member; returns the place inside it."""
        place = self.size
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._write(data)
        return place

    def end(self) -> None:
        self._write(struct.pack("<4sL2Q" if self.zip64 else "<4s3L", b"PK\7\x08", self.crc, self.size, self.size))
        self.entries.append((self.name, self.crc, self.size, self.head))

    def close(self) -> None:
        start = self.at
        for name, crc, size, head in self.entries:
            extra = struct.pack("<2H3Q", 1, 24, size, size, head) if self.zip64 else b""
            s, h = (NO32, NO32) if self.zip64 else (size, head)
            self._write(CENTRAL_HEAD.pack(CENTRAL, 45, 45, 8, 0, 0, 33, crc, s, s, len(name), len(extra), 0, 0, 0, 0, h) + name + extra)
        size, n, place = self.at - start, len(self.entries), self.at
        if self.zip64:
            self._write(END64_HEAD.pack(END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(LOCATOR_HEAD.pack(LOCATOR64, 0, place, 1))
            self._write(END_HEAD.pack(END, 0, 0, NO16, NO16, NO32, NO32, 0))
        else:
            self._write(END_HEAD.pack(END, 0, 0, n, n, size, start, 0))


def directory(source) -> dict[str, Member]:
    """Members of an archive, from its last bytes and its directory."""
    total = source.size()
    tail_at = max(0, total - (END_HEAD.size + 0xFFFF + LOCATOR_HEAD.size))
    tail = source.read_at(total - tail_at, tail_at)
    end = tail.rfind(END)
    while end >= 0:
        if len(tail) - end >= END_HEAD.size and end + END_HEAD.size + END_HEAD.unpack_from(tail, end)[7] == len(tail):
            break
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    _, _, _, _, count, size, start, _ = END_HEAD.unpack_from(tail, end)
    if NO16 == count or NO32 in (size, start):
        at = end - LOCATOR_HEAD.size
        if at < 0 or tail[at:at + 4] != LOCATOR64:
            raise ValueError("no locator of the ZIP64 directory")
        place = LOCATOR_HEAD.unpack_from(tail, at)[2]
        head = END64_HEAD.unpack(source.read_at(END64_HEAD.size, place))
        if head[0] != END64:
            raise ValueError("no end of the ZIP64 directory")
        count, size, start = head[7], head[8], head[9]
    data, at, members = source.read_at(size, start), 0, {}
    for _ in range(count):
        (sig, _, _, _, method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _,
         head) = CENTRAL_HEAD.unpack_from(data, at)
        if sig != CENTRAL:
            raise ValueError("broken ZIP directory")
        at += CENTRAL_HEAD.size
        name, extra = data[at:at + n_name].decode(), data[at + n_name:at + n_name + n_extra]
        wide = _zip64_values(extra)
        size = next(wide) if size == NO32 else size
        packed = next(wide) if packed == NO32 else packed
        head = next(wide) if head == NO32 else head
        members[name] = Member(name, method, size, head)
        at += n_name + n_extra + n_comment
    return members


def _zip64_values(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
        at += 4 + n


def data_offset(source, member: Member) -> int:
    """Where the data of a stored member begins."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not a stored member")
    head = LOCAL_HEAD.unpack(source.read_at(LOCAL_HEAD.size, member.head))
    if head[0] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.head + LOCAL_HEAD.size + head[9] + head[10]


# ---- WARC -------------------------------------------------------------------
def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit record without payload that refers to
    the record of page ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())),
            ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
            ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        head += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    version, _, rest = data.partition(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    head, _, rest = rest.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    block = rest[:int(warc["Content-Length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


# ---- on Spark ---------------------------------------------------------------
def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, html, refers_to: null, or the smallest page id of the
    records with an equal payload where that is another page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = keyed.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # Only pages that may have copies are shuffled.
    first = stored(first, "warc-originals")
    asked = flagged(keyed, first, ["digest"])
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    copies = asked.where("maybe__").join(first, "digest", "left").select("page_id", "url", "html", refers)
    return asked.where("NOT maybe__").select(
        "page_id", "url", "html", F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to")).union(copies)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0, per_archive: int = PAGES_PER_ARCHIVE) -> DataFrame:
    """Write one archive per task under ``folder``; returns (path, records).

    The list of finished archives is itself written, so reading it again does
    not write archives again.
    """
    rows = with_originals(pages, id_col, url_col, html_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        out = archive = None
        index: list[bytes] = []

        def close() -> pa.RecordBatch:
            archive.end()
            archive.begin(INDEX)
            archive.add(b"".join(index))
            archive.end()
            archive.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([len(index)], pa.int64())})

        for batch in batches:
            ids, urls, htmls, refers = (column(batch, n).to_pylist() for n in ("page_id", "url", "html", "refers_to"))
            for page_id, url, html, refer in zip(ids, urls, htmls, refers):
                if archive is None:
                    name, index = f"{uuid.uuid4().hex}.zip", []
                    out = system.open_output_stream(f"{root}/{name}")
                    archive = StoredZip(out)
                    archive.begin(RECORDS)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refer)
                place = archive.add(data)
                index.append((json.dumps({"url": url, "id": page_id, "offset": place, "length": len(data)}) + "\n").encode())
                if len(index) >= per_archive:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    return stored(rows.mapInArrow(run, "path string, records long"), "archives")


def index_of(archives: DataFrame, folder: str) -> DataFrame:
    """(path, offset, length) of every record, from the archives' index members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in column(batch, "path").to_pylist():
                with system.open_input_file(f"{root}/{path}") as source:
                    members = directory(source)
                    base = data_offset(source, members[RECORDS])
                    lines = source.read_at(members[INDEX].size, data_offset(source, members[INDEX])).splitlines()
                found = [json.loads(x) for x in lines]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(found), pa.string()),
                    "offset": pa.array([base + x["offset"] for x in found], pa.int64()),
                    "length": pa.array([x["length"] for x in found], pa.int64())})

    return archives.select("path").mapInArrow(run, "path string, offset long, length long")


def read_records(index: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """One row per record by range reads: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest and payload (null for a revisit). The digest
    of a response is checked against its payload."""
    schema = (f"page_id {id_type}, url string, record_type string, refers_to {id_type}, payload_bytes long, "
              "payload_digest string, payload binary")

    def page(uri: str | None) -> str | None:
        value = uri[len("<urn:page:"):-1] if uri else "None"
        return None if value == "None" else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows, source, open_path = [], None, None
            places = zip(*(column(batch, n).to_pylist() for n in ("path", "offset", "length")))
            for path, offset, length in sorted(places):
                if path != open_path:
                    if source:
                        source.close()
                    source, open_path = system.open_input_file(f"{root}/{path}"), path
                warc, http, payload = parse(source.read_at(length, offset))
                digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                if kind == "response" and digest_of(payload) != digest:
                    raise ValueError(f"payload of {warc['WARC-Record-ID']} does not match its digest")
                rows.append((page(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], kind, page(warc.get("WARC-Refers-To")),
                             int(http["Content-Length"]), digest, payload if kind == "response" else None))
            if source:
                source.close()
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows
                                             else [pa.array([], k) for k in kinds], names)

    text = schema.replace(f"page_id {id_type}", "page_id string").replace(f"refers_to {id_type}", "refers_to string")
    return index.mapInArrow(run, text).withColumns(
        {c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives, then read all records back.

    A null html is an empty payload, a null url an empty target; records with
    equal payloads of at least ``least_bytes`` bytes but the one with the
    smallest page id are revisits. Rows that repeat the smallest id are all
    responses; null ids are never the smallest unless there is no other. An
    empty table writes no archive. Other columns are left out.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    archives = write_archives(pages, folder, least_bytes=least_bytes)
    index = stored(index_of(archives, folder), "warc-index")
    lines = index.count()
    spread = index.repartitionByRange(max(1, -(-lines // INDEX_LINES_PER_TASK)), "path", "offset")
    return read_records(spread, folder, pages.schema["page_id"].dataType.simpleString())
