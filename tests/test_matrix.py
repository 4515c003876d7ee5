"""Feature matrices in blocks: storing, loading, batches, scans and concatenation against plain loops."""

import random
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import matrix, scores

DESIGN = "stratum long, row_idx int, is_case boolean, a double, b double, c double"


def design(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = []
    for s in range(n):
        for i in range(r.randrange(1, 7)):
            rows.append((s * 3, i, i == 0, r.gauss(0, 1), r.choice([1.0, 2.0, 3.0]), 1.0))
    return spark.createDataFrame(rows, DESIGN).repartition(5)


def names():
    return {c: F.col(c) for c in ("a", "b", "c")}


def rounded(df):
    return {tuple(r[:-1]) if len(df.columns) == 3 else r.feature: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}


@pytest.mark.parametrize("rows", [5, 2048])
def test_scan_equals_that_of_the_long_table(spark, monkeypatch, rows):
    monkeypatch.setattr(matrix, "ROWS", rows)
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = design(spark).cache()
    long = scores.melt(d, names())
    try:
        for batch in ("10000", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            m = matrix.of(d, names(), 2)
            sums = matrix.scan_sums(m, 25)
            assert rounded(matrix.observed(m, sums)) == rounded(scores.conditional_score(long).select(matrix.observed(m, sums).columns))
            assert rounded(matrix.null(m, sums).select("perm", "feature", "z")) == rounded(scores.permutations(long, 25).select("perm", "feature", "z"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)


def test_arrays_are_cut_into_blocks(spark):
    d = design(spark).withColumn("b", F.when(F.col("b") > 1, F.col("b")))
    x = d.select("*", F.array("a", "b", "c").alias("features"))
    got, want = matrix.of_arrays(x, ["a", "b", "c"], 2), matrix.of(d, names(), 2)
    assert got.names == want.names and sorted(map(str, got.blocks.collect())) == sorted(map(str, want.blocks.collect()))
    with pytest.raises(Exception, match="must have 2 features"):
        matrix.of_arrays(x, ["a", "b"], 2).blocks.count()


def test_missing_values_count_as_the_mean(spark):
    rows = [(1, 0, True, None, 1.0, 0.0), (1, 1, False, 2.0, 2.0, 0.0), (2, 0, True, 5.0, float("nan"), 0.0), (2, 1, False, 1.0, 4.0, 0.0)]
    m = matrix.of(spark.createDataFrame(rows, DESIGN), names(), 3)
    got = {r.feature: r for r in matrix.observed(m, matrix.scan_sums(m)).collect()}
    assert (got["a"].u, got["a"].v) == (2.0, 4.0) and (got["b"].u, got["b"].v) == (-0.5, 0.25) and not got["c"].testable


def test_no_rows(spark):
    m = matrix.of(design(spark).where("false"), names(), 2)
    sums = matrix.scan_sums(m, 3)
    assert matrix.observed(m, sums).count() == matrix.null(m, sums).count() == 0


def test_a_stored_matrix_is_checked(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    d = design(spark).cache()
    for _ in range(2):  # writing again replaces
        matrix.write(matrix.of(d, names(), 2), at)
    m = matrix.load(spark, at)
    assert m.n_rows == d.count() and [n for n, _, _ in m.names] == ["a", "b", "c"]
    part = matrix.select(m, ["c", "a"], (30, 90))
    plan = part.blocks._jdf.queryExecution().toString()
    assert "PartitionFilters: [block" in plan and "GreaterThanOrEqual(stratum,30)" in plan
    got = {(r.block, r.stratum, r.row_idx): r.x for r in part.blocks.collect()}
    want = {(k, r.stratum, r.row_idx): [r[c]] for r in d.where("stratum between 30 and 90").collect() for k, c in ((0, "a"), (1, "c"))}
    assert got == want
    with pytest.raises(ValueError, match="no such features"):
        matrix.select(m, ["z"])
    gone = sorted((tmp_path / "m/blocks/block=1").glob("*.parquet"))[0]
    gone.unlink()
    with pytest.raises(ValueError, match="block 1 must have"):
        matrix.load(spark, at)
    shutil.rmtree(tmp_path / "m/blocks/block=1")
    with pytest.raises(ValueError, match="block 1 must have"):
        matrix.load(spark, at)


def test_batches(spark):
    m = matrix.of(design(spark), names(), 2)

    def work(block, rows, x):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rows.num_rows], pa.int64()), pa.array([float(np.nansum(x))])], ["block", "n", "total"])

    got = {r.block: (r.n, round(r.total, 6)) for r in matrix.map_batches(m, work, "block int, n long, total double").groupBy("block").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    d = design(spark).toPandas()
    assert got == {0: (len(d), round(float(d.a.sum() + d.b.sum()), 6)), 1: (len(d), float(len(d)))}


def test_concatenation(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None]), (2, [9.0, 9.0]), (None, [7.0, 7.0]), (5, None)], "k long, x array<double>")
    b = spark.createDataFrame([(2, [4]), (3, [5])], "k long, x array<int>")
    out, own = matrix.concatenated([(a, ["p", "q"]), (b, ["r"])], ["k"])
    assert own == ["p", "q", "r"]
    assert {r.k: r.x for r in out.collect()} == {1: [1.0, 2.0, None], 2: [3.0, None, 4.0], 3: [None, None, 5.0], None: [7.0, 7.0, None]}
    with pytest.raises(ValueError, match="shared names"):
        matrix.concatenated([(a, ["p", "q"]), (b, ["p"])], ["k"])
    with pytest.raises(Exception, match="frame 1 must have 2"):
        matrix.concatenated([(a, ["p", "q"]), (b, ["r", "s"])], ["k"])[0].collect()


def test_scans_deal_rows_before_they_have_features(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(matrix, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or df.localCheckpoint())
    monkeypatch.setattr(matrix, "TASK", 500)  # several files a block
    d = design(spark).cache()
    want = matrix.of(d, names(), 2)
    got = matrix.made(d, [F.col(c) for c in ("a", "b", "c")], ["a", "b", "c"], lambda a, b, c: np.stack((a, b, c), axis=1), 2)
    assert got.names == want.names and sorted(map(str, got.blocks.collect())) == sorted(map(str, want.blocks.collect()))
    at = f"file://{tmp_path}/m"
    matrix.write(got, at)
    stored = matrix.load(spark, at)
    assert stored.n_strata == 60 and len(list((tmp_path / "m/blocks/block=0").glob("*.parquet"))) > 5
    scans = [rounded(matrix.null(m, sums)) | rounded(matrix.observed(m, sums)) for m in (want, got, stored) for sums in [matrix.scan_sums(m, 7)]]
    assert scans[0] == scans[1] == scans[2] and len(plans) == 3
    assert not any("rangepartitioning" in p for p in plans)
    split = matrix.Matrix(stored.blocks, stored.names, stored.n_rows, 59)  # as if a stratum had been split
    assert rounded(matrix.observed(split, matrix.scan_sums(split))) == rounded(matrix.observed(got, matrix.scan_sums(got)))
    assert "rangepartitioning" in plans[-2]
