"""WARC records in ZIP-packaged web archives: a writer and a reader that never extracts.

A package is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member for each record,
and `indexes/index.cdx`, a line of LINE bytes for each record with its offset and length in that archive, so that a line is found by its number. The reader parses the end of
central directory record (ZIP64 too), the central directory and its ZIP64 extra fields, finds a stored member's bytes through its local
header, and reads each record by its range.

Writing. A task writes one package for its rows, under a name of its own in the shared folder; a row with the name goes into
a table once the package is complete, so a lost or repeated task leaves no more than a file that nothing refers to.
Of records with equal payloads of REVISIT_BYTES bytes or more the one with the largest id is the response and the others
are revisits that refer to it. That is settled on ids and digests alone, with maxima before the shuffle, so a digest
of many records is no burden; the revisits then join the pages on the record's own id, the one time that payloads move.

Nulls, empties: a null payload counts as empty, a null url as an empty one. Null ids are written as `-`, read back as
null, and never settle which record is the response unless all are null. Repeated ids with equal long payloads: the
records of the largest id are all responses. An empty table makes no package with records.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM, CENTRAL_FORM, END_FORM, END64_FORM, LOCATOR_FORM = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
LINE = 32  # bytes of an index line: offset in 18 digits, length in 12, a space and a line feed


class ZipWriter:
    """Stored members, written one after another to a stream that can seek."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.zip64, self.members, self.at = out, zip64, [], 0

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.out.tell(), 0, 0
        self.out.write(struct.pack(LOCAL_FORM, LOCAL, 45, 0x800, 0, 0, 33, 0, FULL32, FULL32, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self.out.write(data)

    def end(self) -> None:
        """Goes back to put the member's checksum and size into its local header."""
        here = self.out.tell()
        self.out.seek(self.start + 14)
        self.out.write(struct.pack("<I", self.crc))
        self.out.seek(self.start + struct.calcsize(LOCAL_FORM) + len(self.name) + 4)
        self.out.write(struct.pack("<QQ", self.size, self.size))
        self.out.seek(here)
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        begin = self.out.tell()
        for name, crc, size, start in self.members:
            large = self.zip64 or max(size, start) >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if large else b""
            held = [FULL32] * 3 if large else [size, size, start]
            self.out.write(struct.pack(CENTRAL_FORM, CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, held[0], held[1], len(name), len(extra), 0, 0, 0, 0, held[2]) + name + extra)
        end = self.out.tell()
        n, size = len(self.members), end - begin
        large = self.zip64 or n >= FULL16 or max(size, begin) >= FULL32
        if large:
            self.out.write(struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self.out.write(struct.pack(LOCATOR_FORM, LOCATOR, 0, end, 1))
        counts = (FULL16, FULL16, FULL32, FULL32) if large else (n, n, size, begin)
        self.out.write(struct.pack(END_FORM, END, 0, 0, *counts, 0))


class ZipReader:
    """A ZIP file's stored members by range, over anything with seek, read and a size."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        tail = self.range(max(0, size - 65557), min(size, 65557))
        at = tail.rfind(END, 0, max(0, len(tail) - 18))  # a comment may hold the signature too
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        *_, n, length, begin, _ = struct.unpack_from(END_FORM, tail, at)
        place = size - len(tail) + at
        if FULL16 == n or FULL32 in (length, begin):
            sign, _, at64, _ = struct.unpack(LOCATOR_FORM, self.range(place - 20, 20))
            if sign != LOCATOR:
                raise ValueError("no ZIP64 locator")
            sign, *_, n, length, begin = struct.unpack(END64_FORM, self.range(at64, 56))
            if sign != END64:
                raise ValueError("no ZIP64 end of central directory")
        directory, at, self.members = self.range(begin, length), 0, {}
        for _ in range(n):
            sign, _, _, flags, method, _, _, _, packed, whole, n_name, n_extra, n_comment, _, _, _, start = struct.unpack_from(CENTRAL_FORM, directory, at)
            if sign != CENTRAL:
                raise ValueError("broken central directory")
            at += struct.calcsize(CENTRAL_FORM)
            name, extra = directory[at : at + n_name].decode(), directory[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            values = [whole, packed, start]
            while len(extra) >= 4:
                tag, length = struct.unpack_from("<HH", extra)
                if tag == 1:
                    more = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                    values = [next(more) if v == FULL32 else v for v in values]
                extra = extra[4 + length :]
            self.members[name] = (method, *values)

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file ends early")
        return data

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, size, _, start = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = struct.unpack(LOCAL_FORM, self.range(start, struct.calcsize(LOCAL_FORM)))
        if head[0] != LOCAL:
            raise ValueError("no local header")
        return start + struct.calcsize(LOCAL_FORM) + head[-2] + head[-1], size


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record, without its compression; a revisit has no payload but says its length and digest."""
    name = "-" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'-' if refers_to is None else refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers and payload, its lengths and digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than it says")
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda v: None if (x := v.removeprefix("<urn:page:").removesuffix(">")) == "-" else int(x)
    out = {"page_id": number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload": payload, "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(h["X-Payload-Length"]), "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = number(h["WARC-Refers-To"])
    elif len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
        raise ValueError("a record's payload does not have the digest that it says")
    return out


def open_file(path: str, mode: str):
    """A path of any store that pyarrow knows; (stream, size)."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return store.open_input_file(at), store.get_file_info(at).size
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(at.rpartition("/")[0])
        return open(at, "wb"), 0
    return _Later(store, at), 0


class _Later:
    """For stores without seek: a temporary file that can spill, sent when it is closed."""

    def __init__(self, store, at: str) -> None:
        import tempfile

        self.store, self.at, self.file = store, at, tempfile.SpooledTemporaryFile(64_000_000)
        self.write, self.seek, self.tell = self.file.write, self.file.seek, self.file.tell

    def close(self) -> None:
        import shutil

        self.file.seek(0)
        with self.store.open_output_stream(self.at) as out:
            shutil.copyfileobj(self.file, out)
        self.file.close()


def settle(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, digest, target): the revisits and what they refer to."""
    long_ = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= REVISIT_BYTES)
    top = long_.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").select("digest", "target")
    return long_.join(top, "digest").where("page_id < target").select("page_id", "digest", "target").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zip64: bool = False) -> DataFrame:
    """Packages in `folder` -> a table (path, n) of the complete ones."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    revisits = common.table(settle(source), "revisits")
    digest = F.sha1(F.encode("html", "UTF-8"))
    marked = source.withColumn("digest", digest).join(revisits, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, n = None, [], 0
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        for batch in batches:
            for part in common.slices(batch, batch.schema.get_field_index("html")):
                for page_id, digest, url, html, target in zip(*(part.column(k).to_pylist() for k in ("page_id", "digest", "url", "html", "target")), strict=True):
                    if out is None:
                        out, _ = open_file(path, "w")
                        z = ZipWriter(out, zip64)
                        z.begin(DATA)
                    data = gzip.compress(record(page_id, url, html.encode(), digest, target, target is not None), 1, mtime=0)
                    lines.append(f"{z.size:018d} {len(data):012d}\n")
                    z.write(data)
                    n += 1
        if out is not None:
            z.end()
            z.begin(INDEX)
            z.write("".join(lines).encode())
            z.end()
            z.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])

    return common.table(marked.select("page_id", "digest", "url", "html", "target").mapInArrow(run, "path string, n long"), "packages")


def read(packages: DataFrame, payloads: bool = False, step: int = 2000) -> DataFrame:
    """packages (path, n) -> (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    A task reads `step` records of a package by the ranges that their lines of its index give, and no other lines."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    jobs = packages.where("n > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("first"))
    spark = packages.sparkSession
    jobs = jobs.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, size = open_file(path, "r")
                with file:
                    z = ZipReader(file, size)
                    start, _ = z.locate(DATA)
                    index, length = z.locate(INDEX)
                    lines = z.range(index + first * LINE, min(step * LINE, length - first * LINE)).decode().splitlines()
                    rows, held = [], 0
                    for line in lines:
                        at, n = map(int, line.split())
                        rows.append(parse(gzip.decompress(z.range(start + at, n))))
                        held += rows[-1]["payload_bytes"]
                        if held > common.SLICE_CHARS:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=False)], names)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=False)], names)

    return jobs.mapInArrow(run, ddl)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages into packages in the shared folder and reads every record back."""
    return read(write(pages, common.scratch(pages.sparkSession, "wacz")))
