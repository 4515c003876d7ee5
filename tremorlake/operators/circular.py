"""Circular statistics of event phases, and resampling nulls that keep clustering.

Block-shift null: each block of max(4 periods, 30 days) is moved by its own offset within a period. A constituent's phase
is linear in time here, so moving a block turns its complex sum; events are summed once to (band, block) and all trials run on these
few rows instead of on the events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremorlake.functions.random import M, mix2, uniform
from tremorlake.operators import tides


def power(c: Column, s: Column, n: Column) -> Column:
    """Schuster power over N of sums of cosines and sines."""
    return (c * c + s * s) / n


def modulation(power_over_n: Column, n: Column) -> Column:
    """The rate modulation that a power stands for: 2 sqrt((D2 / N) / N)."""
    return 2 * F.sqrt(power_over_n / n)


def schuster(phases: DataFrame, by: list[str], phase: str = "phase", order: int = 1) -> DataFrame:
    """phases (by..., phase) -> n, power over N, mean phase in degrees, p = exp(-power)."""
    x = order * F.col(phase)
    g = phases.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.cos(x)).alias("c"), F.sum(F.sin(x)).alias("s"))
    return g.select(*by, "n", power(F.col("c"), F.col("s"), F.col("n")).alias("power"), F.degrees(F.atan2("s", "c")).alias("mean_phase"), F.exp(-power(F.col("c"), F.col("s"), F.col("n"))).alias("p_value"))


def band_phases(events: DataFrame, bands: DataFrame, longitude: str | None = None) -> DataFrame:
    """Each event at each constituent; bands is a table of 14 rows at most."""
    return events.crossJoin(F.broadcast(bands)).withColumn("phase", tides.phase(F.col("day"), F.col(longitude) if longitude else None))


def block_sums(events: DataFrame, bands: DataFrame, by: list[str], longitude: str | None = None) -> DataFrame:
    """(by..., band, block): sums of cosines and sines. Blocks count from the first event of each group."""
    start = events.groupBy(*by).agg(F.min("day").alias("t0")) if by else events.agg(F.min("day").alias("t0"))
    timed = events.join(start, by) if by else events.crossJoin(F.broadcast(start))
    x = band_phases(timed, bands, longitude)
    block = F.floor((F.col("day") - F.col("t0")) / F.greatest(4 * F.col("period"), F.lit(30.0)))
    return x.groupBy(*by, "band", "period", "rate", block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.cos("phase")).alias("c"), F.sum(F.sin("phase")).alias("s"))


def block_shift_null(sums: DataFrame, by: list[str], trials: int, seed: int = 11) -> DataFrame:
    """block sums -> (by..., band): n, observed power, the null's upper median and maximum, p = (k + 1) / (trials + 1), modulation and its limit."""
    keys = [*by, "band"]
    observed = sums.groupBy(*keys).agg(F.sum("n").alias("n"), power(F.sum("c"), F.sum("s"), F.sum("n")).alias("observed"), F.countDistinct("block").alias("blocks"))
    turn = F.radians(F.col("rate") * F.col("period") * uniform(mix2(F.col("trial"), F.col("block") % M, seed)))
    moved = sums.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumns({"cos": F.cos(turn), "sin": F.sin(turn)})
    null = moved.groupBy(*keys, "trial").agg(power(F.sum(F.col("c") * F.col("cos") - F.col("s") * F.col("sin")), F.sum(F.col("s") * F.col("cos") + F.col("c") * F.col("sin")), F.sum("n")).alias("null"))
    joined = null.join(observed, keys)  # a row for each group and constituent: Spark knows its size and picks the join
    ge = F.sum(F.when(F.col("null") >= F.col("observed") * (1 - 1e-9), 1).otherwise(0))  # a single block turns as a whole: a tie but for rounding
    middle = F.element_at(F.array_sort(F.collect_list("null")), F.lit(trials // 2 + 1))  # `trials` numbers
    out = joined.groupBy(*keys, "n", "observed", "blocks").agg(middle.alias("null_median"), F.max("null").alias("null_max"), ((ge + 1) / F.lit(trials + 1.0)).alias("p"))
    return out.withColumns({"eps": modulation(F.col("observed"), F.col("n")), "eps_limit": modulation(F.col("null_max"), F.col("n")), "few_blocks": F.col("blocks") < 8})


def empirical_p(null: Column, observed: Column, n: int, smaller: bool = False) -> Column:
    hit = null <= observed if smaller else null >= observed
    return (F.sum(F.when(hit, 1).otherwise(0)) + 1) / F.lit(n + 1.0)


def benjamini_hochberg(tests: DataFrame, p: str = "p", rate: float = 0.05, *ties: str) -> DataFrame:
    """Adds rank and survives: whether the test is among the first i, the largest with p(i) <= rate i / m. A table of tests is small."""
    m, k = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy(p, *ties))
    ranked = tests.withColumns({"rank": k, "__m": m})
    last = F.max(F.when(F.col(p) <= rate * F.col("rank") / F.col("__m"), F.col("rank"))).over(Window.partitionBy())
    return ranked.withColumn("survives", F.col("rank") <= F.coalesce(last, F.lit(0))).drop("__m")


def holm(tests: DataFrame, p: str = "p", *ties: str) -> DataFrame:
    """Adds Holm's adjusted p."""
    w = Window.orderBy(p, *ties)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1))
    return tests.withColumn("__step", step).withColumn("p_holm", F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def ensemble_sigma(hits: Column, n: Column, rate: float = 0.05) -> Column:
    return (hits - rate * n) / F.sqrt(n * rate * (1 - rate))


def ks_uniform(ranked: DataFrame, p: str = "p", rank: str = "rn") -> DataFrame:
    """p values with their rank -> n, the Kolmogorov-Smirnov distance to uniform, its critical value, rejection rates."""
    n = ranked.count()
    gap = F.greatest(F.abs(F.col(rank) / n - F.col(p)), F.abs(F.col(p) - (F.col(rank) - 1) / n))
    rate = [F.avg((F.col(p) < a).cast("double")).alias(f"below_{int(a * 100):02d}") for a in (0.01, 0.05, 0.10)]
    return ranked.agg(F.count("*").alias("n"), F.max(gap).alias("ks"), F.lit(1.36 / math.sqrt(max(n, 1))).alias("critical"), *rate)


def harmonic_fit(series: DataFrame, bands: DataFrame, value: str = "value", longitude: float | None = None) -> DataFrame:
    """Samples (day, value) -> each constituent's amplitude and the phase of its maximum, in degrees."""
    s = series if longitude is None else series.withColumn("lon", F.lit(longitude))
    x = band_phases(s, bands, None if longitude is None else "lon")
    g = x.groupBy("band", "period").agg(F.count("*").alias("n"), F.sum(F.col(value) * F.cos("phase")).alias("a"), F.sum(F.col(value) * F.sin("phase")).alias("b"))
    return g.select("band", "period", (2 * F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / F.col("n")).alias("amplitude"), F.degrees(F.atan2("b", "a")).alias("phase_max"))


def norm180(degrees: Column) -> Column:
    """An angle in [-180, 180], by truncated remainder."""
    d = degrees % 360.0
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def phase_lag(observed: DataFrame, forcing: DataFrame) -> DataFrame:
    """Lag of events' mean phase behind the forcing's maximum, degrees and minutes: observed (band, mean_phase), forcing (band, period, phase_max).

    lag_reference has the forcing's phase with its sign turned, which doubles it; it is kept for comparison only."""
    x = observed.join(forcing, "band")
    lag = norm180(F.col("mean_phase") - F.col("phase_max"))
    return x.select("band", "period", lag.alias("lag"), (lag / 360 * F.col("period") * 24 * 60).alias("minutes"), norm180(F.col("mean_phase") + F.col("phase_max")).alias("lag_reference"))


def band_spread(lags: DataFrame) -> DataFrame:
    """Mean and population sd of lags within the semidiurnal (period under 0.75 d) and the diurnal band, and their difference."""
    semi, diurnal = F.when(F.col("period") < 0.75, F.col("lag")), F.when(F.col("period") >= 0.75, F.col("lag"))
    out = lags.agg(F.avg(semi).alias("semi_mean"), F.stddev_pop(semi).alias("semi_sd"), F.avg(diurnal).alias("diurnal_mean"), F.stddev_pop(diurnal).alias("diurnal_sd"))
    return out.withColumn("difference", F.col("diurnal_mean") - F.col("semi_mean"))


def loglog_slope(bins: DataFrame, x: str, y: str) -> DataFrame:
    return bins.agg(F.regr_slope(F.log(y), F.log(x)).alias("slope"))


MOMENTS = 9  # of the events' times within a cell, the number of events included


def periodogram(events: DataFrame, shortest: float, longest: float, n: int, order: int = 1, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Schuster power at n log-spaced periods, from events folded once on a grid of time.

    A cell is half a radian of the shortest period wide and keeps the moments of its events' times about its middle; an event's phase is a
    Taylor series in them, off by (1/4)^9 / 9! at most, 1e-11. So the work after one aggregation is cells x periods, whatever the number of
    events; a task gives one row a group."""
    width = 0.5 * shortest / (2 * math.pi * order)
    step = math.log(longest / shortest) / max(1, n - 1)
    periods = shortest * np.exp(step * np.arange(n))
    turn = 2 * math.pi * order / periods
    off = F.col("day") - (F.col("cell") + 0.5) * width
    cells = events.select(*by, "day", F.floor(F.col("day") / width).alias("cell")).withColumn("off", off)
    power_of = lambda m: F.sum(F.pow("off", F.lit(m)) if m else F.lit(1.0))
    cells = cells.where("day is not null").groupBy(*by, "cell").agg(F.array(*[power_of(m) for m in range(MOMENTS)]).alias("moments"))
    keys = T.StructType([events.schema[c] for c in by])
    schema = T.StructType([*keys, T.StructField("n", T.DoubleType()), T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True)) or [()] * batch.num_rows
            cell = batch.column(len(by)).to_numpy()
            moments = batch.column(len(by) + 1).flatten().to_numpy().reshape(-1, MOMENTS)
            rows: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                rows.setdefault(name, []).append(i)
            for name, own in rows.items():
                t, m = (cell[own] + 0.5) * width, moments[own]
                got = sums.setdefault(name, [0.0, np.zeros(n, complex)])
                got[0] += m[:, 0].sum()
                for a in range(0, n, 256):
                    w = turn[a : a + 256]
                    folded = m.T @ np.exp(1j * np.outer(t, w))  # (moment, period)
                    term = np.ones(len(w), complex)
                    for k in range(MOMENTS):
                        got[1][a : a + 256] += term * folded[k]
                        term = term * 1j * w / (k + 1)
        if sums:
            made = [*[[name[i] for name in sums] for i in range(len(by))], [v[0] for v in sums.values()], [v[1].real for v in sums.values()], [v[1].imag for v in sums.values()]]
            kinds = to_arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, kinds, strict=True)], kinds.names)

    parts = cells.select(*by, "cell", "moments").mapInArrow(run, schema)
    each = parts.select(*by, "n", F.posexplode(F.arrays_zip("c", "s")).alias("k", "z"))
    g = each.groupBy(*by, "k").agg(F.sum("n").alias("n"), F.sum("z.c").alias("c"), F.sum("z.s").alias("s"))
    return g.select(*by, "k", (shortest * F.exp(step * F.col("k"))).alias("period"), power(F.col("c"), F.col("s"), F.col("n")).alias("power"))


def peaks(spectrum: DataFrame, least: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Points of a spectrum (a few thousand rows) above both neighbours and at `least` or more."""
    w = Window.partitionBy(*by).orderBy("k")
    x = spectrum.withColumns({"__a": F.lag("power").over(w), "__b": F.lead("power").over(w)})
    return x.where((F.col("power") > F.col("__a")) & (F.col("power") >= F.col("__b")) & (F.col("power") >= least)).drop("__a", "__b")


def nearest_known(found: DataFrame, known: DataFrame, within: float, log: bool = False) -> DataFrame:
    """known (name, known_period) with the found period nearest to it within a relative (or logarithmic) distance, or null."""
    gap = F.abs(F.log(F.col("period") / F.col("known_period"))) if log else F.abs(F.col("period") / F.col("known_period") - 1)
    met = F.broadcast(known).join(found, (F.col("period") > F.col("known_period") / (1 + 2 * within)) & (F.col("period") < F.col("known_period") * (1 + 2 * within)) & (gap <= within), "left")
    w = Window.partitionBy("name").orderBy(gap, "period")
    return met.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("name", "known_period", "period", "power")
