"""Matched case-control designs, their splits and filters.

A design has a row for each case and for each of its controls: (stratum, day, cell, lat_deg, lon_deg, is_case,
magnitude). Strata are keyed; no step relies on the order of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.geo import Grid
from tremorlake.functions.random import ROUNDS, M, gumbel, mix, mix2
from tremorlake.functions.time import checked_day, date_of

TRAIN_END, TEST_START = 3652.0, 6210.0


def cases(quakes: DataFrame, span: tuple[float, float], grid: Grid | None = None) -> DataFrame:
    """Events inside the span, placed at the centre of their cell; the stratum is the event's index."""
    inside = (grid or Grid()).cell_of(quakes.where(F.col("day").between(*span)))
    return inside.select(F.col("event_idx").alias("stratum"), "day", "cell", F.col("cell_lat").alias("lat_deg"), F.col("cell_lon").alias("lon_deg"), F.lit(True).alias("is_case"), "magnitude")


def _with_controls(kept: DataFrame, times: Column) -> DataFrame:
    controls = kept.withColumn("day", F.explode(times)).withColumns({"is_case": F.lit(False), "magnitude": F.lit(None).cast("double")})
    return kept.unionByName(controls)


def time_stratified(case_rows: DataFrame, span: tuple[float, float], spacing_days: int = 7) -> DataFrame:
    """Controls of the same calendar month, whole multiples of the spacing away; a case whose month leaves the span is dropped."""
    whole = F.floor("day")
    date = date_of(F.col("day"))
    first = F.datediff(F.trunc(date, "month"), F.lit("2000-01-01").cast("date"))
    last = F.datediff(F.last_day(date), F.lit("2000-01-01").cast("date"))
    kept = case_rows.where((first >= span[0]) & (last <= span[1]))
    step = max(1, spacing_days)
    at = F.transform(F.sequence(F.lit(-31), F.lit(31)), lambda k: whole + k * step)
    return _with_controls(kept, F.transform(F.filter(at, lambda t: (t != whole) & (t >= first) & (t <= last)), lambda t: t + (F.col("day") - whole)))


def year_stratified(case_rows: DataFrame, span: tuple[float, float], block_years: int = 6) -> DataFrame:
    """Controls on the same month and day of the other years of a block anchored at 1900; a clipped block drops the case."""
    by = max(1, block_years)
    date, whole = date_of(F.col("day")), F.floor("day")
    begin = (F.lit(1900) + F.floor((F.year(date) - 1900) / by) * by).cast("int")
    one = F.lit(1)
    start, end = checked_day(begin, one, one), checked_day(begin + by, one, one) - 1
    kept = case_rows.where((start >= span[0]) & (end <= span[1]))
    times = F.transform(F.sequence(begin, begin + by - 1), lambda y: F.when(y != F.year(date), checked_day(y, F.month(date), F.day(date))))
    times = F.transform(F.filter(times, lambda t: t.isNotNull()), lambda t: t + (F.col("day") - whole))
    return _with_controls(kept, F.filter(times, lambda t: (t >= span[0]) & (t <= span[1])))


def drawn(case_rows: DataFrame, span: tuple[float, float], scheme: str, k: int, reach: float = 0.0, seed: int = 20260822) -> DataFrame:
    """k controls a case by a counter hash. scheme: `offset` (whole days, 1 to reach, either sign, no repeats),
    `window` (uniform within reach days) or `uniform` (over the span). Draws outside the span are replaced; 4 k + 32 are tried."""
    if scheme not in ("offset", "window", "uniform"):
        raise ValueError(f"unknown scheme: {scheme}")
    keys = [mix(F.col("stratum"), seed + s) for s in (0, 2)]
    times = _draws(scheme, span, k, reach, seed)(F.col("day").cast("double"), *[F.coalesce(key, F.lit(0).cast("long")) for key in keys])
    return _with_controls(case_rows, F.when(F.col("stratum").isNotNull() & F.col("day").isNotNull(), times).otherwise(F.array().cast("array<double>")))


def _draws(scheme: str, span: tuple[float, float], k: int, reach: float, seed: int):
    """A function of (day, two keys of the stratum): the first k draws inside the span that differ, tried one by one for rows that lack some."""

    def draw(key: np.ndarray, j: int, seed: int) -> np.ndarray:
        """uniform(mix2(stratum, j, seed)), key being mix(stratum, seed); fmod has the sign of SQL's %."""
        v = np.fmod(np.fmod(key + j, M) * 48271 + seed + 1, M)
        for c in ROUNDS:
            v = np.fmod(v * (np.fmod(v, 65521) + c), M)
        return v / float(M)

    @F.arrow_udf("array<double>")
    def made(day: pa.Array, key: pa.Array, turn: pa.Array) -> pa.Array:
        day, key, turn = (x.to_numpy(zero_copy_only=False) for x in (day, key, turn))
        out, n = np.full((len(day), k), np.nan), np.zeros(len(day), np.int64)
        open_ = np.arange(len(day))
        for j in range(1, 4 * k + 33):
            u = draw(key[open_], j, seed)
            if scheme == "offset":
                t = day[open_] + (1 + np.floor(u * reach)) * np.where(draw(turn[open_], j, seed + 2) < 0.5, -1, 1)
            elif scheme == "window":
                t = day[open_] + (u * 2 - 1) * reach
            else:
                t = span[0] + u * (span[1] - span[0])
            new = (t >= span[0]) & (t <= span[1]) & ~(out[open_] == t[:, None]).any(axis=1)
            at = open_[new]
            out[at, n[at]] = t[new]
            n[at] += 1
            open_ = open_[n[open_] < k]
            if not len(open_):
                break
        held = np.arange(k) < n[:, None]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(out[held]))

    return made


def usable(design: DataFrame, before: float = TEST_START) -> DataFrame:
    """Rows of strata with exactly one case, more than one row, and the case before the sealed period."""
    s = design.groupBy("stratum").agg(F.sum(F.col("is_case").cast("int")).alias("k"), F.count("*").alias("n"), F.max(F.when(F.col("is_case"), F.col("day"))).alias("case_day"))
    return design.join(s.where((F.col("k") == 1) & (F.col("n") > 1) & (F.col("case_day") < before)).select("stratum"), "stratum", "left_semi")


def with_split(design: DataFrame, train_end: float = TRAIN_END, test_start: float = TEST_START) -> DataFrame:
    """Adds split (train, validate, test) by the case's day, never by the row's own."""
    case_day = F.max(F.when(F.col("is_case"), F.col("day"))).over(Window.partitionBy("stratum"))
    return design.withColumn("case_day", case_day).withColumn("split", F.when(F.col("case_day") < train_end, "train").when(F.col("case_day") < test_start, "validate").when(F.col("case_day").isNotNull(), "test"))


def first_controls(design: DataFrame, k: int) -> DataFrame:
    """The case and the first k controls of each stratum, in order of row_idx."""
    rank = F.row_number().over(Window.partitionBy("stratum", "is_case").orderBy("row_idx"))
    return design.withColumn("__r", rank).where(F.col("is_case") | (F.col("__r") <= k)).drop("__r")


def limit_strata(design: DataFrame, n: int) -> DataFrame:
    """The rows of the n strata with the smallest keys, whole."""
    keys = design.select("stratum").distinct().orderBy("stratum").limit(n)
    return design.join(keys, "stratum", "left_semi")


def sample_strata(design: DataFrame, n: int, seed: int = 20260823) -> DataFrame:
    """n whole strata without replacement, by a counter hash."""
    keys = design.select("stratum").distinct().orderBy(mix(F.col("stratum") % M, seed), "stratum").limit(n)
    return design.join(keys, "stratum", "left_semi")


def inherit_label(design: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Adds the label of the stratum's case to all of its rows; labels (event_idx, <name>)."""
    return design.join(labels.select(F.col("event_idx").alias("stratum"), name), "stratum", "left")


def of_label(design: DataFrame, name: str, value: str) -> DataFrame:
    """Whole strata whose label is the value."""
    keys = design.groupBy("stratum").agg(F.max(F.when(F.col("is_case"), F.col(name))).alias("__l")).where(F.col("__l") == value)
    return design.join(keys.select("stratum"), "stratum", "left_semi")


def plant(design: DataFrame, feature: str, beta: float, seed: int = 20260823, standardise: bool = True) -> DataFrame:
    """Redraws each stratum's case with softmax weights of beta times the feature (Gumbel maximum by a counter hash)."""
    x = F.col(feature).cast("double")
    if standardise:
        m, s = design.agg(F.avg(x), F.stddev_pop(x)).first()
        x = (x - F.lit(m)) / F.lit(s if s else 1.0)
    score = beta * x + gumbel(mix2(F.col("stratum") % M, F.col("row_idx") % M, seed))
    w = Window.partitionBy("stratum").orderBy(score.desc(), "row_idx")
    return design.withColumn("is_case", F.row_number().over(w) == 1)


def shuffle_labels(design: DataFrame, seed: int = 20260822) -> DataFrame:
    """Makes a random row of each stratum its case."""
    w = Window.partitionBy("stratum").orderBy(mix2(F.col("stratum") % M, F.col("row_idx") % M, seed), "row_idx")
    return design.withColumn("is_case", F.row_number().over(w) == 1)
