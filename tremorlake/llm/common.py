"""Shared plumbing: Arrow passes over texts, tables in the shared folder, connected components.

Every operator selects the two or three columns it needs under names of its own, so further columns of the
caller, whatever they are called, never clash.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_CHARS = 1_500_000  # characters of text handled at once inside a Python worker
_made: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where that setting is absent in local mode (tests) is a temporary folder made; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tremorlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(path)
    return path


def _sweep(spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        for path in _made:
            if path.startswith("file:"):
                import shutil

                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    for path in _made:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_mod_py(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice has about `most` bytes of text at most, or one row."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed planes of bytes; of a rising one, its differences."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: type, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x) if rising else x


def by_word(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words -> their order by bucket, hash and word, and where each bucket begins in it."""
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    at = ((h & np.uint64((1 << 24) - 1)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, at))
    if len(h) and (h[order][1:] == h[order][:-1]).any():
        order = np.array(sorted(range(len(words)), key=lambda i: (at[i], h[i], words[i])), np.int64)
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def streamed(*columns) -> bytes:
    """Columns of equal length as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def map_texts(df: DataFrame, schema: str, work: Callable[[list, list], dict], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One Arrow pass: work(ids, texts) -> columns by name, for slices of bounded size. Null texts come as ''.

    keep: long columns that go through to the result unseen (work then gives a row for each text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = work(part.column(0).to_pylist(), part.column(1).to_pylist())
                made = [pa.array(out[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*made, *part.columns[2:]], [*arrow.names, *keep])

    return source.mapInArrow(run, schema + "".join(f", {c} long" for c in keep))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (u long, v long) -> (u, root): the smallest vertex reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round is two hash aggregations with
    map-side minima and two joins, and ends in a table in the shared folder; a hub's edges are summed before the
    shuffle, and the join side that holds them can be split by AQE. The rounds keep what is connected connected, so they
    may end as soon as the edges are stars: no vertex has two edges, and none is both a leaf and a centre.
    Vertices without an edge do not appear."""
    now = table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        ends = now.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("n")).unionByName(now.select(F.col("v").alias("x")).distinct().withColumn("n", F.lit(1)))
        if ends.groupBy("x").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
            return now.select("u", F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = table(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = table(small, name)


def open_members(live: DataFrame, roots: DataFrame, member: str) -> DataFrame:
    """Members of buckets (k, member) that hold several components (roots: u, root) -> the table (k, a, c, main): member, its
    component, and whether that is the largest in the bucket."""
    named = live.join(roots, F.col(member) == F.col("u"), "left").select("k", F.col(member).alias("a"), F.coalesce("root", member).alias("c"))
    sizes = named.groupBy("k", "c").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("k").agg(F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("n_c")).where("n_c > 1").select("k", F.col("top.c").alias("top"))
    return table(named.join(open_, "k").select("k", "a", "c", (F.col("c") == F.col("top")).alias("main")), "open")


def across(live: DataFrame, roots: DataFrame, member: str, met: Callable[[str, str], Column]) -> DataFrame:
    """Members of buckets that stand in different components and meet the condition -> pairs (u, v) of these components.

    Members outside a bucket's largest component are compared with all of other components; so a bucket that is one
    component, or nearly so, costs little, and no two different components of a bucket stay uncompared."""
    rest = open_members(live, roots, member)
    x = rest.where("!main").select("k", "a", F.col("c").alias("u"))
    y = rest.select(F.col("k").alias("l"), F.col("a").alias("b"), F.col("c").alias("v"), F.col("main").alias("other_main"))
    apart = (F.col("k") == F.col("l")) & (F.col("u") != F.col("v")) & (F.col("other_main") | (F.col("u") < F.col("v")))
    return x.join(y, apart & met("a", "b")).select("u", "v").distinct()


SMALL = 1_000_000  # rows of two numbers that may be broadcast: 16 MB, and some 64 MB as a hash table


def without(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_anti") -> DataFrame:
    """rows without those that stand in the table `keys`; broadcast if they are few, else by a shuffle of both sides."""
    return rows.join(F.broadcast(keys) if keys.count() <= SMALL else keys, on, how)


def workers_import(spark: SparkSession) -> None:
    """Ships the package to Python workers that would not find it by themselves, and keeps Arrow batches of long texts small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows, "10000")) == 10000:  # Spark's default; another value is the caller's choice
        spark.conf.set(rows, "2000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p] + [os.getcwd()]
    if root in known or getattr(spark.sparkContext, "_tremorlake_sent", False):
        return
    import shutil

    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tremorlake-"), "tremorlake"), "zip", root, "tremorlake")
    spark.sparkContext.addPyFile(packed)
    spark.sparkContext._tremorlake_sent = True


def keep_rows(df: DataFrame, good: Callable[[list], list], text_col: str = "text") -> DataFrame:
    """The rows of df, all columns untouched, for whose text (null: '') good() says true. One Arrow pass, no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(good([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def rewrite_texts(df: DataFrame, new: Callable[[list], list], text_col: str = "text") -> DataFrame:
    """The rows of df with new(texts) in place of the texts; nulls stay null. One Arrow pass, no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                column = part.column(at)
                held = [t for t in column.to_pylist() if t is not None]
                made = iter(new(held))
                texts = [next(made) if ok else None for ok in column.is_valid().to_pylist()]
                arrays = list(part.columns)
                arrays[at] = pa.array(texts, column.type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return df.mapInArrow(run, df.schema)
