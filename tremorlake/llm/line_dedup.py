"""Lines that many documents share stay in one document only; the answer is a compressed bitmap of lines to keep, not text.

A row for each long line (128-bit hash of its key, document, position) is dealt by ranges of (hash, document falling, position),
so that a line of any frequency is cut over as many tasks as its rows need, and a task streams through sorted rows: the first document
of a hash is the one that keeps it. Only the first and the last hash of a range may continue in another one. Their
undecided rows are set aside and settled by a table of a few rows a range, which is broadcast.

Defined results: null and empty texts are one empty line. Rows with the same id are one document when documents are counted and kept,
and have bitmaps of their own; a null id is a document too, and less than any other. Repeated rows get the same bitmap. A document with
a line twice keeps or loses both. Lines are bytes up to the next \\n, however long; texts are read whole. An empty table gives an
empty table. Other columns are not read. Two keys with the same 128-bit hash (none is to be expected) would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_DOCS = 20, 3
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
DROPPED, OPEN, SEEN = 0, 1, 2  # kinds of rows that a range gives


def key_of(line: bytes, least: int) -> bytes | None:
    """The line without blanks at both ends and with A-Z lower-cased, or None if it has under `least` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least:
        return None
    return key if len(key) >= 4 * least or len(key) - sum(1 for b in key if b & 0xC0 == 0x80) >= least else None


def body(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """docs (doc, row, text) -> (high, low, doc, row, pos): the hash of each long line's key, and where it stands."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                hashes, at, pos = bytearray(), [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for j, line in enumerate(text.split(b"\n")):
                        if (key := key_of(line, least)) is not None:
                            hashes += xxhash.xxh3_128_digest(key)
                            at.append(i)
                            pos.append(j)
                pair = np.frombuffer(bytes(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), part.column(0).take(rows), part.column(2).take(rows), pa.array(pos, pa.int64())], ["high", "low", "doc", "row", "pos"])

    return docs.select("doc", F.col("text").cast("binary").alias("text"), "row").mapInArrow(run, "high long, low long, doc long, row long, pos long")


class Ranges:
    """Streams one range of sorted rows; rows come as an int64 array of (high, low, id is there, id, row, pos)."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.hash: tuple | None = None  # the hash that the last row had
        self.doc: tuple | None = None  # its document
        self.ordinal = -1  # that document's place among those of the hash
        self.first = True  # the range's first hash still runs
        self.held: list[np.ndarray] = []  # rows of a later hash that are undecided
        self.seen: list[tuple] = []  # its first documents
        self.opening: list[tuple] = []  # (hash, document) of the first hash's first documents

    def take(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """-> kinds and rows that are settled now."""
        if not len(rows):
            return
        new_hash, new_doc = np.ones(len(rows), bool), np.ones(len(rows), bool)
        new_hash[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        new_doc[1:] = new_hash[1:] | (rows[1:, 2:4] != rows[:-1, 2:4]).any(axis=1)
        starts = np.flatnonzero(new_hash)
        carried = -1
        if self.hash == tuple(rows[0, :2]):
            new_doc[0] = self.doc != tuple(rows[0, 2:4])
            carried = self.ordinal
        else:  # the hash before ended inside the range, with too few documents for the rows that are held
            self.held, self.seen = [], []
            self.first = self.hash is None
        count = np.cumsum(new_doc)
        ends = np.append(starts[1:], len(rows))
        ordinal = count - 1 - np.repeat(count[starts] - new_doc[starts], ends - starts)
        ordinal[: ends[0]] += carried + 1
        enough = np.repeat(ordinal[ends - 1] + 1 >= self.min_docs, ends - starts)
        fresh = new_doc & (ordinal < self.min_docs)
        begin = 0
        if self.first:
            begin = ends[0]
            yield OPEN, rows[:begin]
            self.opening += [tuple(r[:4]) for r in rows[:begin][fresh[:begin]]]
        elif enough[0]:
            for rest in self.held:
                yield DROPPED, rest
            self.held = []
        yield DROPPED, rows[begin:][(enough & (ordinal > 0))[begin:]]
        last = starts[-1]
        if last >= begin:  # this run may go on
            if last > 0:
                self.held, self.seen, self.first = [], [], False
            self.seen += [tuple(r[:4]) for r in rows[last:][fresh[last:]]]
            if not enough[-1]:
                self.held.append(rows[last:][ordinal[last:] > 0])
        self.hash, self.doc, self.ordinal = tuple(rows[-1, :2]), tuple(rows[-1, 2:4]), int(ordinal[-1])

    def end(self) -> Iterator[tuple[int, np.ndarray]]:
        for rest in self.held:
            yield OPEN, rest
        seen = [(*s, 0, 0) for s in self.opening + self.seen]
        yield SEEN, np.array(seen, np.int64).reshape(-1, 6)


def dropped(lines: DataFrame, min_docs: int) -> DataFrame:
    """long_lines -> (doc, row, pos) of the lines that go."""
    schema = "kind byte, high long, low long, doc long, row long, pos long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Ranges(min_docs)

        def out(made: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for kind, r in made:
                if len(r):
                    arrays = [pa.array(np.full(len(r), kind, np.int8)), pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array(r[:, 3], mask=r[:, 2] == 0), pa.array(r[:, 4]), pa.array(r[:, 5])]
                    yield pa.RecordBatch.from_arrays(arrays, ["kind", "high", "low", "doc", "row", "pos"])

        for batch in batches:
            doc = batch.column(2)
            columns = [batch.column(0), batch.column(1), doc.is_valid().cast(pa.int64()), doc.fill_null(0), batch.column(3), batch.column(4)]
            yield from out(state.take(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)))
        yield from out(state.end())

    order = [F.col("high"), F.col("low"), F.desc_nulls_last("doc"), F.col("row"), F.col("pos")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = common.table(dealt.mapInArrow(run, schema), "line-ranges")
    name = F.coalesce(F.col("doc").cast("string"), F.lit(""))
    # a few rows a range (two hashes, min_docs documents each), however many lines there are
    settled = rows.where(F.col("kind") == SEEN).groupBy("high", "low").agg(F.max("doc").alias("keeper"), F.count_distinct(name).alias("n")).where(F.col("n") >= min_docs)
    late = rows.where(F.col("kind") == OPEN).join(F.broadcast(settled), ["high", "low"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return rows.where(F.col("kind") == DROPPED).select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))


def pack_bits(keep: np.ndarray) -> bytes:
    return pa.compress(np.packbits(keep).tobytes(), codec="zstd", asbytes=True)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pa.decompress(data, (n + 7) // 8, codec="zstd", asbytes=True), np.uint8), count=n).astype(bool)


def named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, row): row tells texts under the same id apart."""
    text = body(F.col(text_col))
    return df.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("row"))


def keep_bitmaps(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc, row, n_lines long, n_dropped long, keep binary): for each text the compressed bitmap of lines that stay; null if all do."""
    docs = named(df, id_col, text_col)
    lines = common.table(long_lines(docs, min_chars), "lines")
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    sizes = docs.select("doc", "row", (breaks + 1).cast("long").alias("n_lines"), F.lit(None).cast("long").alias("pos"))
    gone = dropped(lines, min_docs).select("doc", "row", F.lit(None).cast("long").alias("n_lines"), "pos")
    grouped = sizes.unionByName(gone).groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits: list[bytes | None] = []
            for n, positions in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                at = positions.values.to_numpy(zero_copy_only=False)
                if len(at):
                    keep = np.ones(n, bool)
                    keep[at] = False
                    bits.append(pack_bits(keep))
                else:
                    bits.append(None)
            n_dropped = pc.list_value_length(batch.column(3)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n_dropped, pa.array(bits, pa.binary())], ["doc", "row", "n_lines", "n_dropped", "keep"])

    return grouped.mapInArrow(run, "doc long, row long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_lines, n_dropped, kept: the text's lines that stay, joined by \\n), a row for each row of df."""
    docs = named(df, id_col, text_col)
    right = bitmaps.select(F.col("doc").alias("d"), F.col("row").alias("r"), "n_lines", "n_dropped", "keep")
    both = docs.join(right.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 3):
                kept = []
                for n, bits, text in zip(part.column(1).to_pylist(), part.column(4).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if bits is not None:
                        text = b"\n".join(line for line, stays in zip(text.split(b"\n"), unpack_bits(bits, n), strict=True) if stays)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    rows = both.select("doc", "n_lines", "n_dropped", F.col("text").cast("binary").alias("text"), "keep")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary")


def digests(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """-> (doc_id, n_lines, n_dropped, kept_sha256)."""
    return apply_bitmaps(df, keep_bitmaps(df, min_chars, min_docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
