"""Nulls that shift all events of a group by whole days against a forcing, without a row for each event and shift.

The forcing's maxima are sent to the executors (MOST_TOPS at most, which is checked); a batch of events meets all shifts there as
arrays, and only sums by group, bin and shift leave it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.random import ROUNDS, M

MOST_TOPS = 1_000_000


def mix_int(key: int, seed: int = 1) -> int:
    """functions.random.mix of one number."""
    v = (key * 48271 + seed) % M
    for c in ROUNDS:
        v = (v * ((v % 65521) + c)) % M
    return v


def whole_days(n: int, low: int = 30, high: int = 3999, avoid: tuple[float, ...] = (), within: float = 2.0, seed: int = 5) -> list[float]:
    """n whole days of either sign, `low` to `high` in size, not within so many days of a multiple of a period to avoid."""
    out: list[float] = []
    key = 0
    while len(out) < n:
        key += 1
        d = low + mix_int(key, seed) % (high - low + 1)
        if all(abs(round(d / p) * p - d) >= within for p in avoid):
            out.append(float(d if mix_int(key, seed + 1) % 2 else -d))
    return out


def shifted_sums(events: DataFrame, tops: DataFrame, offsets: list[float], edges: list[float] | None = None, orders: int = 1) -> DataFrame:
    """events (grp string, bin int, day) and maxima (day, height) -> (grp, bin, k, trial, n, c, s, a): events, sums of the cosine and
    sine of k times the phase between maxima, and of the height before them. Trial 0 is not shifted.

    With edges, an event's bin is the number of edges at or under the height at its shifted time. Events outside the maxima drop out."""
    return shifted_sums_of(events, tops, offsets, [edges], orders).drop("which")


def shifted_sums_of(events: DataFrame, tops: DataFrame, offsets: list[float], ways: list[list[float] | None], orders: int = 1) -> DataFrame:
    """shifted_sums for each of some edges (or None), with `which`, its place among them; phases are made once for all.

    Events of a group and bin with the same time are one row with its number."""
    import pyarrow as pa

    found = tops.select("day", "height").orderBy("day").limit(MOST_TOPS + 1).toArrow()
    if found.num_rows > MOST_TOPS:
        raise ValueError("the forcing has too many maxima to be sent to the executors; cut its span")
    sent = events.sparkSession.sparkContext.broadcast((found.column(0).to_numpy(), found.column(1).to_numpy()))
    shifts, cuts = [0.0, *offsets], [None if e is None else np.array(e) for e in ways]

    def run(batches):
        marks, heights = sent.value
        for batch in batches:
            if not batch.num_rows or len(marks) < 2:
                continue
            names, code = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            own, day, many = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            order = np.argsort(day)  # neighbours in time are found at neighbouring maxima
            code, own, day, many = code[order], own[order].astype(np.int64), day[order], many[order].astype(np.float64)
            columns = [[] for _ in range(9)]
            for trial, shift in enumerate(shifts):
                t = day + shift
                i = np.searchsorted(marks, t, side="right") - 1
                first, last = np.searchsorted(i, (0, len(marks) - 1))  # i rises with the day
                ok = slice(int(first), int(last))
                i, t, m = i[ok], t[ok], many[ok]
                phase = 2 * np.pi * (t - marks[i]) / (marks[i + 1] - marks[i])
                waves = [(m * np.cos(k * phase), m * np.sin(k * phase)) for k in range(1, orders + 1)]
                height = heights[i]
                for which, cut in enumerate(cuts):
                    bins = int(own.max()) + 1 if cut is None else len(cut) + 1
                    size = len(names) * bins
                    key = code[ok] * bins + (own[ok] if cut is None else np.searchsorted(cut, height, side="right"))
                    n, a = np.bincount(key, m, size), np.bincount(key, m * height, size)
                    some = np.flatnonzero(n)
                    for k, (c, s) in enumerate(waves, 1):
                        made = (names[some // bins], some % bins, np.full(len(some), k), np.full(len(some), trial), np.full(len(some), which), n[some].astype(np.int64), np.bincount(key, c, size)[some], np.bincount(key, s, size)[some], a[some])
                        for column, x in zip(columns, made, strict=True):
                            column.append(x)
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(columns, types, strict=True)], ["grp", "bin", "k", "trial", "which", "n", "c", "s", "a"])

    rows = events.select(F.col("grp").cast("string"), F.col("bin").cast("int"), F.col("day").cast("double")).where("grp is not null and bin is not null and day is not null")
    rows = rows.groupBy("grp", "bin", "day").agg(F.count("*").alias("many")).repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = rows.mapInArrow(run, "grp string, bin int, k int, trial int, which int, n long, c double, s double, a double")
    return part.groupBy("grp", "bin", "k", "trial", "which").agg(*[F.sum(c).alias(c) for c in ("n", "c", "s", "a")])


def local_map(lat: float, lon: float) -> np.ndarray:
    """(local component, component): physics.to_local at a place, as a matrix from xx, xy, xz, yy, yz, zz to nn, ne, nd, ee, ed, dd."""
    p, q = np.radians(lat), np.radians(lon)
    axes = np.array([[-np.sin(p) * np.cos(q), -np.sin(p) * np.sin(q), np.cos(p)], [-np.sin(q), np.cos(q), 0.0], [-np.cos(p) * np.cos(q), -np.cos(p) * np.sin(q), -np.sin(p)]])
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    return np.array([[axes[a, i] * axes[b, j] + (axes[a, j] * axes[b, i] if i != j else 0.0) for i, j in upper] for a, b in upper])


def _moments(sums: np.ndarray) -> np.ndarray:
    """(..., 28) sums of 1, six components and their 21 products -> (..., 6, 6) population covariances."""
    mean = sums[..., 1:7] / sums[..., :1]
    out = np.empty((*sums.shape[:-1], 6, 6))
    for at, (i, j) in enumerate((i, j) for i in range(6) for j in range(i, 6)):
        out[..., i, j] = out[..., j, i] = sums[..., 7 + at] / sums[..., 0] - mean[..., i] * mean[..., j]
    return out


def uplift_counts(events: DataFrame, grid: DataFrame, start: float, step: float, cells: int, trials: int, block_days: float, reach: float, origin: float, seed: int = 4) -> DataFrame:
    """events (day, lat_deg, lon_deg, cell 0..cells-1) and a grid of tensors (k, xx ... zz) -> (cell, trial, n, known, up): events, those with
    a time and a place, and those at uplift then; trial 0 is not shifted, the others move blocks of days as joins.block_offsets.

    The grid is a parameter and is sent out. A task's events meet all trials as arrays, and a row for each cell and trial leaves it."""
    import pyarrow as pa

    from tremorlake.operators.physics import COMPONENTS

    found = grid.select(*COMPONENTS).orderBy("k").toArrow()
    tensors = np.stack([c.to_numpy() for c in found.columns], axis=1)
    sent = events.sparkSession.sparkContext.broadcast(np.concatenate((tensors[:-1], tensors[1:]), axis=1))
    doubled = np.array([1.0, 2.0, 2.0, 1.0, 2.0, 1.0])

    def mixed(key: np.ndarray, seed: int) -> np.ndarray:
        v = np.fmod(key * 48271 + seed, M)  # the sign of SQL's %
        for c in ROUNDS:
            v = np.fmod(v * (np.fmod(v, 65521) + c), M)
        return v

    def run(batches):
        pairs, total = sent.value, np.zeros((3, trials + 1, cells), np.int64)
        own = mixed(np.arange(trials + 1), seed)
        for batch in batches:
            day, lat, lon = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cell = batch.column(3).to_numpy(zero_copy_only=False)
            total[0] += np.bincount(cell, minlength=cells)
            order = np.argsort(day)  # neighbours in time share the grid's rows
            order = order[~np.isnan(day + lat + lon)[order]]
            day, p, q, cell = day[order], np.radians(lat[order]), np.radians(lon[order]), cell[order]
            total[1] += np.bincount(cell, minlength=cells)
            down = np.stack((-np.cos(p) * np.cos(q), -np.cos(p) * np.sin(q), -np.sin(p)), axis=1)
            weight = np.stack([down[:, i] * down[:, j] for i in range(3) for j in range(i, 3)], axis=1) * doubled
            block, at = np.unique(np.floor((day - origin) / block_days).astype(np.int64), return_inverse=True)
            offset = mixed(np.fmod(own[:, None] + np.fmod(block, M), M), seed + 1) / float(M) * reach
            offset[0] = 0.0
            for trial in range(trials + 1):
                x = (day + offset[trial][at] - start) / step
                k = np.clip(np.floor(x), 0, len(pairs) - 1).astype(np.int64)
                x -= k
                both = pairs[k]
                down_down = np.einsum("ij,ij->i", both[:, :6], weight) * (1 - x) + np.einsum("ij,ij->i", both[:, 6:], weight) * x
                total[2, trial] += np.bincount(cell[down_down > 0], minlength=cells)
        trial, cell = np.divmod(np.arange((trials + 1) * cells), cells)
        columns = [cell, trial, *total.reshape(3, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["cell", "trial", "n", "known", "up"])

    rows = events.select(*[F.col(c).cast("double") for c in ("day", "lat_deg", "lon_deg")], F.col("cell").cast("int")).where("cell is not null")
    # Dealt anew: a few megabytes of events are minutes of work, and would else be put together in a few tasks.
    part = rows.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "cell int, trial int, n long, known long, up long")
    return part.groupBy("cell", "trial").agg(*[F.sum(c).alias(c) for c in ("n", "known", "up")]).where("n > 0")


DRAWS = 1 << 18  # draws of a trial that are held at once
PART = 256  # trials whose scores at all planes are held at once


def uniform_draws(nest: int, trial: int, n_events: int, n: int, seed: int = 81, first: int = 0) -> np.ndarray:
    """A sample of the grid for each event of a nest in a trial: keyed by nest, then trial, then event; first: events left out before."""
    from tremorlake.operators.matrix import mix_array

    key = mix_int((mix_int(nest % M, seed) + trial) % M, seed + 1)
    return mix_array((key + np.arange(first + 1, n_events + 1)) % M, seed + 2) % n


def uniform_counts(nest: int, trial: int, n_events: int, n: int) -> np.ndarray:
    """How often uniform_draws gives each sample, from DRAWS of them at once."""
    count = np.zeros(n, np.int64)
    for first in range(0, n_events, DRAWS):
        count += np.bincount(uniform_draws(nest, trial, min(n_events, first + DRAWS), n, first=first), minlength=n)
    return count


def nest_scores(nests: DataFrame, series: np.ndarray, weights: np.ndarray, offsets: list[int], chunk: int = 20) -> DataFrame:
    """nests (nest int, lat, lon, places array<int>, counts array<long>) on a cyclic grid of tensors (sample, 6) -> (kind, nest, trial, score).

    A score is the least standard deviation over the weights' planes (plane, 6 local components), each relative to its own over all
    samples. `cyclic`: trial 0 as it is, and all events moved by each offset, from one Fourier product for all shifts; `uniform`: as many samples
    drawn for each trial. The grid and the planes are sent out: both are parameters, not data. Nests with trials dealt in chunks are the tasks."""
    import pyarrow as pa

    n, trials = len(series), len(offsets)
    flat = np.concatenate([np.ones((n, 1)), series, *[series[:, i : i + 1] * series[:, i:] for i in range(6)]], axis=1)

    def run(batches):
        spectrum = np.fft.rfft(flat, axis=0)
        upper = np.triu_indices(6)
        everything = _moments(flat.sum(axis=0))[upper]
        for batch in batches:
            for r in batch.to_pylist():
                w = weights @ local_map(r["lat"], r["lon"])
                squares = w[:, upper[0]] * w[:, upper[1]] * np.where(upper[0] == upper[1], 1.0, 2.0)  # a variance is their product with a covariance's upper half
                ref = squares @ everything
                relative = (squares[ref > 0] / ref[ref > 0, None]).T
                count = np.bincount(r["places"], weights=r["counts"], minlength=n)
                if r["first"] == 0:
                    # sum over i of count[i] * flat[i + shift], for all shifts at once
                    sums = np.fft.irfft(np.conj(np.fft.rfft(count))[:, None] * spectrum, n, axis=0)[np.array([0, *offsets]) % n]
                    sums[:, 0] = count.sum()
                    kind, names = "cyclic", list(range(trials + 1))
                else:
                    names = list(range(r["first"], min(r["first"] + chunk, trials + 1)))
                    total = int(count.sum())
                    sums = np.stack([uniform_counts(r["nest"], t, total, n) @ flat for t in names])
                    kind = "uniform"
                cov = _moments(sums)[:, upper[0], upper[1]]
                least = [(cov[i : i + PART] @ relative).min(axis=1, initial=np.inf) for i in range(0, len(cov), PART)]
                score = np.sqrt(np.maximum(np.concatenate(least), 0))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(names)), pa.array([r["nest"]] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(score)], ["kind", "nest", "trial", "score"])

    items = nests.withColumn("first", F.explode(F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.lit(trials), F.lit(chunk)))))
    # With a number of its own: these few rows are hours of work, and would else be put together in a task or two.
    return items.repartition(trials // chunk + 2, "nest", "first").mapInArrow(run, "kind string, nest int, trial int, score double")
