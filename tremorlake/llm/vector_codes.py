"""Product-quantised vectors: each is cut into parts, and a part becomes the number of its nearest codebook entry.

Vectors stand in columnar blocks (a row of numbers for each dimension) in a table of the shared folder. A round of training is one
`treeAggregate` over that table's RDD: a task adds squared distances dimension by dimension, puts its vectors into
tensors of sums and counts with `np.add.at`, and the tensors (entries x dimensions, whatever the number of rows) meet in a tree.
All arithmetic is on whole numbers, so the result is the same for any partitioning and after lost executors.

Defined results: a null vector, or one with null, NaN or infinite components, is dropped. Null ids come after all others, repeated
ids in the order of their vectors; each row gives a row. Fewer rows than entries: as many entries as rows. Equal distances go to the
lower entry, an entry without vectors stays. Vectors of each length have codebooks of their own; where a length is no multiple of
the number of parts, the first parts are longer by one; vectors without components have code 0 and error 0. Components too
large for 64-bit distances are reckoned with unbounded integers (slowly); an error beyond a long is an OverflowError. Null labels
are one label. An empty table gives an empty table. Texts do not occur here; long vectors are handled in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 1 << 19  # numbers in a block: distances of a block to all entries take some 16 MB for parts of 8


@dataclass
class Codebooks:
    """cuts: where parts begin and end; entries: (entry, dimension), the parts' books side by side."""

    cuts: list[tuple[int, int]]
    entries: np.ndarray

    def digest(self) -> str:
        numbers = [str(int(x)) for a, b in self.cuts for row in self.entries[:, a:b] for x in row]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    infinite = float("inf")
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)), F.lit(False))


def cut(width: int, parts: int) -> list[tuple[int, int]]:
    at = np.cumsum([0] + [width // parts + (i < width % parts) for i in range(parts)]).tolist()
    return list(zip(at, at[1:], strict=False))


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers as int64 where no sum of squared differences of such numbers can pass 63 bits, else as Python's integers."""
    top = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    return x.astype(np.int64 if 4 * top * top * max(1, max(x.shape)) < 1 << 62 else object)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**50 / scale:
        return narrow(np.floor(x * scale).astype(np.int64))
    return narrow(np.array([[math.floor(v * scale) if abs(v) < 2.0**900 else math.floor(v) * scale for v in row] for row in x.tolist()], object))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (dimension, vector), book (entry, dimension) -> each vector's entry and squared distance."""
    kind = np.int64 if x.dtype == book.dtype == np.int64 else object
    x, book = x.astype(kind, copy=False), book.astype(kind, copy=False)
    far = np.zeros((len(book), x.shape[1]), kind)
    for d in range(len(x)):
        off = x[d] - book[:, d, None]
        off *= off
        far += off
    best = far.argmin(axis=0) if len(x) else np.zeros(x.shape[1], np.int64)
    return best, far[best, np.arange(x.shape[1])]


def planes(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of equal length -> (dimension, vector)."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width).T


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch (its last column the vector) with vectors of one length, of BLOCK numbers at most or one vector."""
    widths = pc.list_value_length(batch.columns[-1]).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        same = batch.filter(pa.array(widths == width))
        step = max(1, BLOCK // max(1, width))
        for i in range(0, same.num_rows, step):
            yield width, same.slice(i, step)


def blocks(vectors: DataFrame) -> DataFrame:
    """vectors (id, label, vector) -> the table (width int, n int, kind string, planes binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in by_width(batch):
                x = np.ascontiguousarray(planes(part.columns[0], width))
                made = [pa.array([width], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.dtype.str]), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["width", "n", "kind", "planes"])

    return common.table(vectors.select("vector").mapInArrow(run, "width int, n int, kind string, planes binary"), "vector-blocks")


def train(vectors: DataFrame, made: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks of the vectors of one length; made: blocks(vectors)."""
    first = vectors.where(F.size("vector") == width).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    kind = np.float32 if vectors.schema["vector"].dataType.elementType == T.FloatType() else np.float64
    books = Codebooks(cut(width, parts), narrow(whole(np.array([r[0] for r in first], kind).reshape(len(first), width), scale)))
    rows = made.where(F.col("width") == width).select("n", "kind", "planes").rdd
    depth = max(2, math.ceil(math.log(max(2, rows.getNumPartitions()), 32)))

    def add(state: tuple | None, row: T.Row) -> tuple:
        x = whole(np.frombuffer(row.planes, row.kind).reshape(width, row.n), scale)
        sums, counts = state or (np.zeros(books.entries.shape, np.int64), np.zeros((parts, len(books.entries)), np.int64))
        sums = sums.astype(object) if x.dtype == object and sums.dtype != object else sums
        for p, (a, b) in enumerate(books.cuts):
            best, _ = nearest(x[a:b], books.entries[:, a:b])
            np.add.at(sums[:, a:b], best, x[a:b].T)
            np.add.at(counts[p], best, 1)
        return sums, counts

    def merge(left: tuple | None, right: tuple | None) -> tuple | None:
        return right if left is None else left if right is None else (left[0] + right[0], left[1] + right[1])

    for _ in range(rounds):
        sums, counts = rows.treeAggregate(None, add, merge, depth)
        new = books.entries.astype(object)
        for p, (a, b) in enumerate(books.cuts):
            used = counts[p] > 0
            new[used, a:b] = (sums[used, a:b] // counts[p][used, None]).astype(object)
        books = Codebooks(books.cuts, narrow(new))
    return books


def encode(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """vectors (id, label, vector) of the codebooks' length -> (id, label, code binary: a byte a part, error long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in by_width(batch):
                x = whole(planes(part.columns[-1], width), scale)
                found = [nearest(x[a:b], books.entries[:, a:b]) for a, b in books.cuts]
                code = np.ascontiguousarray(np.stack([best for best, _ in found], axis=1).astype(np.uint8))
                error = pa.array([int(e) for e in sum(far for _, far in found)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([row.tobytes() for row in code], pa.binary()), error], ["id", "label", "code", "error"])

    kept = T.StructType([vectors.schema["id"], vectors.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return vectors.where(F.size("vector") == books.entries.shape[1]).select("id", "label", "vector").mapInArrow(run, kept)


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict[int, Codebooks]]:
    """-> ((id, label, code binary, error long, width int) of all usable rows, and the codebooks by length of vector)."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("an entry's number must fit a byte, and there must be a part")
    vectors = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    made = blocks(vectors)
    books = {r.width: train(vectors, made, r.width, parts, entries, rounds, scale) for r in made.select("width").distinct().orderBy("width").collect()}
    if not books:
        return vectors.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("width")), books
    coded = None
    for width, own in books.items():
        one = encode(vectors, own, scale).withColumn("width", F.lit(width))
        coded = one if coded is None else coded.unionByName(one)
    return common.table(coded, "vector-codes"), books


def decode(code: bytes, books: Codebooks) -> np.ndarray:
    """The whole numbers that a code stands for."""
    return np.concatenate([books.entries[code[p], a:b] for p, (a, b) in enumerate(books.cuts)])


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded and label_error: the error summed over rows of an equal label (nulls together)."""
    sums = common.table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= common.SMALL else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
