"""Stored feature matrices of many columns: writing, checked loading, batches, scans, and features of several frames side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators import matrix
from tremorlake.operators.tables import shared_path
from tremorlake.plans.matched import _INDEXED, indexed, perm_sql, time_design
from tremorlake.plans.registry import query

#: Features of a design row that are exact in any engine; f0 to f<n-1>.
MANY, WIDTH = 300, 64
_EXACT = "((stratum * 7 + row_idx * 13 + j * (j + 3)) % (50 + j % 47))::DOUBLE"


def exact_features(stratum: np.ndarray, row_idx: np.ndarray) -> np.ndarray:
    """(row, feature), by the formula of _EXACT."""
    j = np.arange(MANY)
    return np.fmod((stratum * 7 + row_idx * 13)[:, None] + j * (j + 3), 50 + j % 47)


def stored(spark: SparkSession, sf_dir: str) -> matrix.Matrix:
    """The design's matrix, written and loaded again with its checks."""
    path = shared_path(spark, "matrix")
    inputs = [F.col("stratum"), F.col("row_idx")]
    matrix.write(matrix.made(indexed(time_design(spark, sf_dir)), inputs, [f"f{j}" for j in range(MANY)], exact_features, WIDTH), path)
    return matrix.load(spark, path)


PICKED = ("f0", "f63", "f64", "f130", "f299")


@query(
    "s11_matrix_batches",
    f"""WITH {_INDEXED}, long AS (SELECT stratum, row_idx, is_case, 'f' || j AS feature, {_EXACT} AS x FROM indexed, (VALUES (0), (63), (64), (130), (299)) v(j) WHERE stratum BETWEEN 500 AND 40000)
SELECT feature, count(*) AS n, sum(x) AS total, min(x) AS low, max(x) AS high, coalesce(sum(x) FILTER (is_case), 0.0::DOUBLE) AS of_cases, (SELECT count(*) FROM indexed) AS n_rows, {MANY}::BIGINT AS n_features FROM long GROUP BY feature""",
)
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five features of a range of strata, read as Arrow batches from the stored matrix and summed there."""
    whole = stored(spark, sf_dir)
    part = matrix.select(whole, list(PICKED), (500, 40000))
    names: dict[int, list[str]] = {}
    for feature, block, _ in part.names:
        names.setdefault(block, []).append(feature)

    def sums(block: int, rows: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        case = rows.column(2).to_numpy(zero_copy_only=False)
        made = [pa.array(names[block]), pa.array([len(x)] * x.shape[1], pa.int64()), *[pa.array(v, pa.float64()) for v in (x.sum(axis=0), x.min(axis=0), x.max(axis=0), x[case].sum(axis=0))]]
        yield pa.RecordBatch.from_arrays(made, ["feature", "n", "total", "low", "high", "of_cases"])

    out = matrix.map_batches(part, sums, "feature string, n long, total double, low double, high double, of_cases double")
    out = out.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("of_cases").alias("of_cases"))
    return out.withColumns({"n_rows": F.lit(whole.n_rows), "n_features": F.lit(len(whole.names)).cast("long")})


_WIDE = f"{_INDEXED}, long AS (SELECT stratum, row_idx, is_case, 'f' || j AS feature, {_EXACT} AS x FROM indexed, range({MANY}) t(j))"


@query("score_scan_matrix", f"WITH {_WIDE}, {perm_sql(10)}, t AS (SELECT perm, count(*) AS tested, max(abs(z)) AS top, sum(z) AS total FROM null_z GROUP BY perm), o AS (SELECT count(*) AS tested, max(abs(z)) AS top, sum(z) AS total FROM scored) SELECT perm::INTEGER AS perm, tested, round(top, 5) AS max_abs_z, round(total, 3) AS sum_z FROM t UNION ALL SELECT 0, tested, round(top, 5), round(total, 3) FROM o")
def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and summed z over 300 stored features, as observed (perm 0) and in ten permutations."""
    m = stored(spark, sf_dir)
    sums = matrix.scan_sums(m, 10)
    seen = matrix.observed(m, sums).where("testable").select(F.lit(0).alias("perm"), "feature", "z")
    out = seen.unionByName(matrix.null(m, sums)).groupBy("perm").agg(F.count("*").alias("tested"), F.max(F.abs("z")).alias("top"), F.sum("z").alias("total"))
    return out.select("perm", "tested", F.round("top", 5).alias("max_abs_z"), F.round("total", 3).alias("sum_z"))


@query("o7_concatenated", f"WITH {_INDEXED} SELECT stratum, row_idx, CASE WHEN stratum % 3 <> 0 THEN day END AS day, CASE WHEN stratum % 3 <> 0 THEN (stratum % 10)::DOUBLE END AS last_digit, CASE WHEN row_idx % 2 = 0 THEN (row_idx * row_idx)::DOUBLE END AS square FROM indexed WHERE stratum % 3 <> 0 OR row_idx % 2 = 0")
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature arrays of two frames by row; a row that one frame lacks has nulls there."""
    rows = indexed(time_design(spark, sf_dir))
    a = rows.where("stratum % 3 != 0").select("stratum", "row_idx", F.array("day", (F.col("stratum") % 10).cast("double")).alias("x"))
    b = rows.where("row_idx % 2 = 0").select("stratum", "row_idx", F.array((F.col("row_idx") * F.col("row_idx")).cast("double")).alias("x"))
    both, names = matrix.concatenated([(a, ["day", "last_digit"]), (b, ["square"])], ["stratum", "row_idx"])
    return both.select("stratum", "row_idx", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
