"""Feature matrices in blocks of columns, and score scans over them.

A matrix of many features over a design's rows is kept as blocks: (block, stratum, row_idx, is_case, x: the values of up to `width` features).
Stored, a block is a partition of a Parquet table, sorted by stratum and row; `names` says which block and place a feature has, and
`size` how many rows and features there must be, which a load checks. Readers prune to the blocks and strata they need.

A scan deals the design's rows by stratum, before they have their features, so a stratum's rows meet in a task. There they are Arrow batches: a
matrix X of centred values, and a sparse matrix W of 0 and 1 that says which row each permutation draws from each stratum. W @ X gives the permuted
sums of all features at once; only sums by block leave a task, one row for each block that it met. A matrix is written in the same way, in files that
no reader splits, so a scan of a stored one shuffles nothing; should a stratum be split nevertheless, its count tells, and the rows are shuffled.
Blocks without a design (arrays from elsewhere) are shuffled as they are."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.random import ROUNDS, M
from tremorlake.operators.tables import materialize

WIDTH = 256
ROWS = 2048  # rows of a block that are multiplied at once
BLOCKS = "block int, stratum long, row_idx int, is_case boolean, x array<double>"


@dataclass(frozen=True)
class Matrix:
    """blocks (see BLOCKS) and the features by block and place; n_rows: the design's rows, where known.

    design, spread, pieces: what the blocks are made of, a row at a time: pieces(batches of spread(design)) are batches of the blocks.
    n_strata: of a stored matrix whose files hold whole strata, one after the other."""

    blocks: DataFrame
    names: tuple[tuple[str, int, int], ...]
    n_rows: int | None = None
    n_strata: int | None = None
    design: DataFrame | None = None
    spread: Callable[[DataFrame], DataFrame] | None = None
    pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None

    def names_table(self) -> DataFrame:
        return self.blocks.sparkSession.createDataFrame([*self.names], "feature string, block int, at int")


def of(design: DataFrame, features: dict[str, Column], width: int = WIDTH) -> Matrix:
    """design (stratum, row_idx, is_case, ...) and its features -> a matrix, not stored yet."""
    names = _placed(list(features), width)
    columns = [c.cast("double") for c in features.values()]
    parts = [F.struct(F.lit(i // width).alias("block"), F.array(*columns[i : i + width]).alias("x")) for i in range(0, len(columns), width)]

    def spread(rows: DataFrame) -> DataFrame:
        # A projection of its own: many features are too much code for one method, which a projection splits, and a generator would interpret.
        rows = rows.select(F.col("stratum").cast("long"), F.col("row_idx").cast("int"), "is_case", F.array(*parts).alias("p"))
        return rows.withColumn("p", F.explode("p")).select("p.block", "stratum", "row_idx", "is_case", "p.x")

    return Matrix(spread(design), names, design=design, spread=spread, pieces=iter)


def made(design: DataFrame, inputs: list[Column], names: list[str], make: Callable[..., np.ndarray], width: int = WIDTH) -> Matrix:
    """design (stratum, row_idx, is_case, ...) and make(arrays of inputs) -> (row, feature), called in tasks for some ROWS at once -> a matrix."""
    n = len(names)

    def spread(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("stratum").cast("long"), F.col("row_idx").cast("int"), "is_case", *[c.cast("double").alias(f"i{i}") for i, c in enumerate(inputs)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield from _cut(part, make(*[c.to_numpy(zero_copy_only=False) for c in part.columns[3:]]), n, width)

    return Matrix(spread(design).mapInArrow(pieces, BLOCKS), _placed(names, width), design=design, spread=spread, pieces=pieces)


def _placed(names: list[str], width: int) -> tuple[tuple[str, int, int], ...]:
    return tuple((name, i // width, i % width) for i, name in enumerate(names))


def _cut(rows: pa.RecordBatch, x: np.ndarray, n: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (stratum, row_idx, is_case, ...) and their n values as batches of BLOCKS."""
    for at in range(0, n, width):
        own = np.ascontiguousarray(x[:, at : at + width], np.float64)
        lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), pa.array(own.ravel(), from_pandas=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), at // width, np.int32)), *rows.columns[:3], lists], ["block", "stratum", "row_idx", "is_case", "x"])


def of_arrays(rows: DataFrame, names: list[str], width: int = WIDTH, column: str = "features") -> Matrix:
    """rows (stratum, row_idx, is_case, <column>: an array of all features) -> a matrix. Arrays are cut in Arrow batches, evaluated once."""
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield from _cut(part, values(part.column(3), n), n, width)

    rows = rows.select(F.col("stratum").cast("long"), F.col("row_idx").cast("int"), "is_case", F.col(column).cast("array<double>").alias("x"))
    return Matrix(rows.mapInArrow(run, BLOCKS), _placed(names, width))


TASK = 128 << 20  # bytes of values that a task sorts and writes
GROUP = 1 << 30  # a row group takes a file of such a task whole, and no reader splits a row group


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _dealt(design: DataFrame, tasks: int) -> DataFrame:
    """The design's rows, those of a stratum in one partition, in order."""
    return design.repartition(tasks, "stratum").sortWithinPartitions("stratum", "row_idx")


def write(matrix: Matrix, path: str) -> None:
    """Stores a matrix, in place of what stood there; the size is written last."""
    spark, design, strata = matrix.blocks.sparkSession, matrix.design, None
    if design is None:
        blocks, group = matrix.blocks.repartitionByRange("block", "stratum"), {}
    else:
        size = design.groupBy("stratum").count().agg(F.count("*").alias("strata"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
        strata, group = size.strata, {"parquet.block.size": str(GROUP)}
        rows = matrix.spread(design.repartition(max(_tasks(spark), math.ceil(size.rows * len(matrix.names) * 8 / TASK)), "stratum"))
        blocks = rows if matrix.pieces is iter else rows.mapInArrow(matrix.pieces, BLOCKS)
    blocks.sortWithinPartitions("block", "stratum", "row_idx").write.mode("overwrite").options(**group).partitionBy("block").parquet(f"{path}/blocks")
    matrix.names_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where("block = 0").count()
    spark.createDataFrame([(rows, len(matrix.names), strata)], "n_rows long, n_features long, n_strata long").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def load(spark: SparkSession, path: str) -> Matrix:
    """The stored matrix; a ValueError if a block has not as many rows or features as it must have."""
    size = spark.read.schema("n_rows long, n_features long, n_strata long").parquet(f"{path}/size").first()
    names = tuple((r.feature, r.block, r["at"]) for r in spark.read.parquet(f"{path}/names").collect())  # one row a feature
    if len(names) != size.n_features:
        raise ValueError(f"{path}: {len(names)} names for {size.n_features} features")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    widths: dict[int, int] = {}
    for _, block, at in names:
        widths[block] = max(widths.get(block, 0), at + 1)
    got = {r.block: r for r in blocks.groupBy("block").agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).collect()}
    for block, width in widths.items():
        r = got.get(block)
        if size.n_rows and (r is None or (r.n, r.low, r.high) != (size.n_rows, width, width)):
            raise ValueError(f"{path}: block {block} must have {size.n_rows} rows of {width} values, and has {r}")
    if set(got) - set(widths):
        raise ValueError(f"{path}: blocks without names: {sorted(set(got) - set(widths))}")
    return Matrix(blocks, names, size.n_rows, size.n_strata)


def select(matrix: Matrix, features: list[str], strata: tuple[int, int] | None = None) -> Matrix:
    """The blocks of these features, cut to their places; strata: first and last. Both reach the scan."""
    place = {name: (block, at) for name, block, at in matrix.names}
    if missing := [f for f in features if f not in place]:
        raise ValueError(f"no such features: {missing}")
    by: dict[int, list[str]] = {}
    for f in features:
        by.setdefault(place[f][0], []).append(f)
    rows = matrix.blocks.where(F.col("block").isin(sorted(by)))
    if strata:
        rows = rows.where(F.col("stratum").between(*strata))
    cut = None
    for block, names in by.items():
        x = F.array(*[F.get("x", F.lit(place[f][1])) for f in names])
        cut = F.when(F.col("block") == block, x) if cut is None else cut.when(F.col("block") == block, x)
    names = tuple((f, block, i) for block, fs in sorted(by.items()) for i, f in enumerate(fs))
    return Matrix(rows.withColumn("x", cut), names, *((matrix.n_rows, matrix.n_strata) if strata is None else ()))


def map_batches(matrix: Matrix, work: Callable[[int, pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(block, rows: stratum, row_idx, is_case, values) for Arrow batches of one block each; values is (rows, features), NaN where null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield from work(int(block[a]), part.select(["stratum", "row_idx", "is_case"]), values(part.column(4)))

    return matrix.blocks.select("block", "stratum", "row_idx", "is_case", "x").mapInArrow(run, schema)


def values(x: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of equal length as (row, place), NaN where null. width: the length that they must have."""
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if width is not None and len(flat) != len(x) * width:
        raise ValueError(f"rows must have {width} features")
    return flat.reshape(len(x), -1)


def concatenated(frames: list[tuple[DataFrame, list[str]]], keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Feature arrays of several frames (keys, x) side by side: one array a key, nulls where a frame has no row; and all names in order.

    A name that two frames share is an error; so is an array whose length is not that of its names. Rows of a frame with the same key: the
    least array. One shuffle for all frames: their rows are put together and grouped by key."""
    names = [n for _, own in frames for n in own]
    if len(set(names)) != len(names):
        raise ValueError(f"shared names: {sorted({n for n in names if names.count(n) > 1})}")
    rows = None
    for i, (df, own) in enumerate(frames):
        fits = F.when(F.size("x") == len(own), F.transform("x", lambda v: v.cast("double"))).otherwise(F.raise_error(F.lit(f"frame {i} must have {len(own)} features")))
        part = df.where("x is not null").select(*keys, F.lit(i).alias("__i"), fits.alias("__x"))
        rows = part if rows is None else rows.unionByName(part)
    parts = [F.coalesce(F.min(F.when(F.col("__i") == i, F.col("__x"))), F.array(*[F.lit(None).cast("double")] * len(own))) for i, (_, own) in enumerate(frames)]
    return rows.groupBy(*keys).agg(F.concat(*parts).alias("x")), names


# Score scans


def mix_array(key: np.ndarray, seed: int) -> np.ndarray:
    """functions.random.mix of whole arrays."""
    v = (key * 48271 + seed) % M
    for c in ROUNDS:
        v = (v * ((v % 65521) + c)) % M
    return v


def picks(strata: np.ndarray, sizes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(permutation, stratum) -> which of the stratum's rows stands in the case's place; the draw of scores.permutations."""
    keys = (mix_array(strata % M, seed)[None, :] + np.arange(1, n + 1)[:, None]) % M
    return mix_array(keys, seed + 1) % sizes[None, :]


class _Sums:
    """Sums of one block over the strata that a task met."""

    def __init__(self, width: int, n: int, seed: int) -> None:
        self.n, self.seed, self.strata, self.rows = n, seed, 0, 0
        self.u, self.v, self.t1, self.t2 = (np.zeros(width) for _ in range(4))
        self.drawn = np.zeros((n, width))

    def add(self, stratum: np.ndarray, case: np.ndarray, x: np.ndarray) -> None:
        """Whole strata, their rows in order."""
        starts = np.flatnonzero(np.append(True, stratum[1:] != stratum[:-1]))
        sizes = np.diff(np.append(starts, len(stratum)))
        known = ~np.isnan(x)
        held = np.where(known, x, 0.0)
        count = np.maximum(np.add.reduceat(known, starts, axis=0), 1)
        centred = np.where(known, x - np.repeat(np.add.reduceat(held, starts, axis=0) / count, sizes, axis=0), 0.0)
        self.strata, self.rows = self.strata + len(starts), self.rows + len(x)
        self.u += centred[case].sum(axis=0)
        self.v += (np.add.reduceat(centred * centred, starts, axis=0) / count).sum(axis=0)
        self.t1, self.t2 = self.t1 + held.sum(axis=0), self.t2 + (held * held).sum(axis=0)
        if self.n:
            drawn = np.zeros((self.n, len(x)))
            drawn[np.arange(self.n)[:, None], starts[None, :] + picks(stratum[starts], sizes, self.n, self.seed)] = 1
            self.drawn += drawn @ centred


SUMS = "block int, n_strata long, n_rows long, u array<double>, v array<double>, t1 array<double>, t2 array<double>, drawn array<double>"
NAMES = [c.split()[0] for c in SUMS.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 5]


def scan_sums(matrix: Matrix, permutations: int = 0, seed: int = 20260822) -> DataFrame:
    """-> one row a block: strata, rows, and by feature U, V, sums and squares; drawn: U of each permutation, one after the other.

    Missing values count as the stratum's mean. Every stratum has its rows once, and one case at most counts once."""

    pieces = matrix.pieces or iter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, _Sums] = {}
        held: dict[int, list[tuple]] = {}  # rows of each block: under ROWS in all and a batch, or one stratum

        def settle(block: int, to_end: bool) -> None:
            stratum, case, x = (np.concatenate([h[i] for h in held[block]]) for i in range(3))
            own = sums.setdefault(block, _Sums(x.shape[1], permutations, seed))
            cuts = np.flatnonzero(stratum[1:] != stratum[:-1]) + 1
            end = len(stratum) if to_end else int(cuts[-1]) if len(cuts) else 0
            start = 0
            while start < end:  # whole strata, some ROWS at once
                fit = cuts[(cuts > start) & (cuts <= end)]
                stop = end if end - start <= ROWS or not len(fit) else int(max(fit[0], fit[fit <= start + ROWS].max(initial=0)))
                own.add(stratum[start:stop], case[start:stop], x[start:stop])
                start = stop
            held[block] = [(stratum[end:], case[end:], x[end:])] if end < len(stratum) else []

        for batch in pieces(batches):
            of = batch.column(0).to_numpy()
            found = np.unique(of)
            for block in found.tolist():
                part = batch if len(found) == 1 else batch.take(pa.array(np.flatnonzero(of == block)))
                own = held.setdefault(block, [])
                own.append((part.column(1).to_numpy(), part.column(3).fill_null(False).to_numpy(zero_copy_only=False), values(part.column(4))))
                if sum(len(h[0]) for h in own) * len(held) >= ROWS:
                    settle(block, False)
        for block in list(held):
            if held[block]:
                settle(block, True)
            own = sums[block]
            made = [block, own.strata, own.rows, own.u, own.v, own.t1, own.t2, own.drawn.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(made, TYPES, strict=True)], NAMES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list | None = None
        for batch in batches:
            for row in batch.to_pylist():
                own = [row["block"], row["n_strata"], row["n_rows"], *[np.array(row[c]) for c in ("u", "v", "t1", "t2", "drawn")]]
                total = own if total is None else [own[0], *[a + b for a, b in zip(total[1:], own[1:], strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(total, TYPES, strict=True)], NAMES)

    def summed(rows: DataFrame) -> DataFrame:
        return materialize(rows.mapInArrow(run, SUMS).groupBy("block").applyInArrow(merge, SUMS), "scan-sums")

    if matrix.design is not None:
        return summed(matrix.spread(_dealt(matrix.design, _tasks(matrix.blocks.sparkSession))))
    blocks = matrix.blocks.select("block", "stratum", "row_idx", "is_case", "x")
    if matrix.n_strata is not None:
        out = summed(blocks)
        if out.where(F.col("n_strata") != matrix.n_strata).isEmpty():
            return out
    return summed(blocks.repartitionByRange("block", "stratum").sortWithinPartitions("block", "stratum", "row_idx"))


def observed(matrix: Matrix, sums: DataFrame) -> DataFrame:
    """feature -> U, V, z, strata, total variance, leverage, whether it can be tested: as scores.conditional_score."""
    at = lambda c: F.get(c, F.col("at")).alias(c)
    f = sums.drop("drawn").join(F.broadcast(matrix.names_table()), "block").select("feature", "n_strata", "n_rows", *[at(c) for c in ("u", "v", "t1", "t2")])
    f = f.withColumn("total_var", F.greatest(F.col("t2") / F.col("n_rows") - F.pow(F.col("t1") / F.col("n_rows"), 2), F.lit(0.0)))
    f = f.withColumn("leverage", F.when(F.col("total_var") > 0, F.col("v") / F.col("n_strata") / F.col("total_var")).otherwise(0.0))
    f = f.withColumn("testable", (F.col("v") > 1e-12) & (F.col("leverage") > 1e-8))
    return f.withColumn("z", F.when(F.col("testable"), F.col("u") / F.sqrt("v")).otherwise(0.0)).select("feature", "u", "v", "z", "n_strata", "total_var", "leverage", "testable")


def null(matrix: Matrix, sums: DataFrame) -> DataFrame:
    """(perm, feature) -> z of the permutations, for features that can be tested: as scores.permutations."""
    ok = observed(matrix, sums).where("testable").select("feature", F.col("v").alias("of"))
    width = F.size("v")
    rows = sums.select("block", width.alias("w"), F.posexplode("drawn").alias("i", "u")).select("block", (F.floor(F.col("i") / F.col("w")) + 1).cast("int").alias("perm"), (F.col("i") % F.col("w")).alias("at"), "u")
    return rows.join(F.broadcast(matrix.names_table()), ["block", "at"]).join(ok, "feature").select("perm", "feature", (F.col("u") / F.sqrt("of")).alias("z"))
