"""Stratum-wise models: ridge conditional logits, and boosted trees with the stratum softmax as their objective.

A stratum's rows are packed into one row, so that a scan needs no shuffle and no window: a task takes Arrow batches of whole strata and
adds up gradients or histograms, of which one row a task leaves it. Scans are the cost; they are counted in `scans`."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.random import M
from tremorlake.operators.matrix import mix_array
from tremorlake.operators.shifts import mix_int
from tremorlake.operators.tables import materialize, numbered


def scales(rows: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd of each feature; constant ones (sd at most 1e-9) are frozen by the fit."""
    got = rows.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (got[f"m_{c}"] or 0.0, got[f"s_{c}"] or 0.0) for c in names}


def standardised(names: list[str], by: dict[str, tuple[float, float]]) -> Column:
    """An array of standardised features; frozen ones are 0."""
    return F.array(*[(F.col(c).cast("double") - by[c][0]) / by[c][1] if by[c][1] > 1e-9 else F.lit(0.0) for c in names])


def packed(rows: DataFrame, x: Column) -> DataFrame:
    """rows (stratum, is_case, ...) and their features -> one row a stratum: (stratum, y, x), y an array, x the features row after row.

    The case comes first, the rest in the order of its features; missing features are NaN."""
    filled = F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    each = F.array_sort(F.collect_list(F.struct((~F.col("is_case")).alias("control"), filled.alias("x"))))
    strata = rows.groupBy("stratum").agg(each.alias("rows"))
    return strata.select("stratum", F.transform("rows", lambda r: ~r["control"]).alias("y"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column -> all values, and where each list begins."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    return flat, np.cumsum(sizes) - sizes


def softmax(score: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities within strata, and their logarithms; score may have columns."""
    sizes = np.diff(np.append(starts, len(score)))
    s = score - np.repeat(np.maximum.reduceat(score, starts, axis=0), sizes, axis=0)
    total = np.repeat(np.add.reduceat(np.exp(s), starts, axis=0), sizes, axis=0)
    return np.exp(s) / total, s - np.log(total)


SUMS = "key int, sums array<double>"


def _summed(data: DataFrame, work: Callable[[pa.RecordBatch, dict[int, np.ndarray]], None]) -> dict[int, np.ndarray]:
    """work adds a batch to arrays by key -> the arrays' sums over all tasks; they meet on executors, and one row a key comes back."""

    def out(state: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array([a.ravel() for a in state.values()], pa.list_(pa.float64()))], ["key", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                work(batch, state)
        if state:
            yield out(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                add(state, key, sums.values.to_numpy())
        yield out(state)

    found = data.mapInArrow(run, SUMS).groupBy("key").applyInArrow(merge, SUMS).collect()
    return {r.key: np.array(r.sums) for r in found}


def add(state: dict[int, np.ndarray], key: int, sums: np.ndarray) -> None:
    state[key] = state[key] + sums if key in state else np.array(sums, np.float64)


class _Descent:
    """L-BFGS for one ridge: proposes points and takes their values, so that many can share a scan."""

    def __init__(self, b: np.ndarray, iterations: int) -> None:
        self.b, self.left, self.pairs, self.done, self.f = b, iterations, [], False, None
        self.d, self.step, self.g = np.zeros_like(b), 1.0, None

    def point(self) -> np.ndarray:
        return self.b + self.step * self.d

    def take(self, f: float, g: np.ndarray) -> None:
        if self.f is None:
            self.f, self.g = f, g
        elif f <= self.f + 1e-4 * self.step * (self.g @ self.d):
            s, y = self.step * self.d, g - self.g
            if s @ y > 1e-12:
                self.pairs = [*self.pairs, (s, y)][-8:]
            self.left -= 1
            self.done = self.f - f < 1e-10 or self.left <= 0
            self.b, self.f, self.g = self.b + s, f, g
        else:
            self.step /= 2
            self.done = self.step <= 1e-6
            return
        self.done |= np.abs(self.g).max(initial=0) < 1e-7
        d, back = -self.g, []
        for s, y in reversed(self.pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            back.append((a, s, y))
        if self.pairs:
            d = d * (self.pairs[-1][0] @ self.pairs[-1][1]) / (self.pairs[-1][1] @ self.pairs[-1][1])
        for a, s, y in reversed(back):
            d = d + (a - (y @ d) / (s @ y)) * s
        self.d, self.step = d, 1.0


class LogitPath:
    """Conditional logits at several ridges: 0.5 * ridge * |b|^2 over the mean softmax log likelihood within strata.

    Each scan gives likelihoods and gradients of all ridges that are not done, so the path costs as many scans as its slowest ridge.
    Missing features count as the mean; constant ones are frozen at 0."""

    def __init__(self, ridges: list[float], iterations: int = 30) -> None:
        self.ridges, self.iterations, self.scans = ridges, iterations, 0

    def _sums(self, data: DataFrame, points: np.ndarray) -> np.ndarray:
        """points (ridge, feature) -> (ridge, 3 + feature): cases, their log likelihood and that of chance, and its gradient."""
        width = points.shape[1]
        self.scans += 1

        def work(batch: pa.RecordBatch, state: dict[int, np.ndarray]) -> None:
            y, starts = _lists(batch.column(1))
            x = np.nan_to_num(_lists(batch.column(2))[0].reshape(len(y), width), nan=0.0)
            p, log_p = softmax(x @ points.T, starts)
            chance = -np.log(np.repeat(np.diff(np.append(starts, len(y))), np.diff(np.append(starts, len(y)))))
            case = y.astype(bool)
            head = np.stack([np.full(len(points), case.sum()), log_p[case].sum(axis=0), np.full(len(points), chance[case].sum())], axis=1)
            add(state, 0, np.concatenate([head, (case[:, None] - p).T @ x], axis=1))

        got = _summed(data, work)
        return got[0].reshape(len(points), 3 + width) if got else np.zeros((len(points), 3 + width))

    def fit(self, rows: DataFrame, names: list[str]) -> LogitPath:
        """rows (stratum, is_case, <names>)."""
        self.names, self.scales = names, scales(rows, names)
        data = materialize(packed(rows, standardised(names, self.scales)), "logit")
        runs = [_Descent(np.zeros(len(names)), self.iterations) for _ in self.ridges]
        while live := [(r, ridge) for r, ridge in zip(runs, self.ridges, strict=True) if not r.done]:
            sums = self._sums(data, np.array([r.point() for r, _ in live]))
            for (r, ridge), s in zip(live, sums, strict=True):
                n, b = s[0] or 1.0, r.point()
                r.take(-s[1] / n + 0.5 * ridge * float(b @ b), -s[3:] / n + ridge * b)
        self.betas, self.losses = np.array([r.b for r in runs]), [r.f for r in runs]
        return self

    def gains(self, rows: DataFrame) -> list[float]:
        """Bits an event over chance at each ridge, in one scan."""
        s = self._sums(packed(rows, standardised(self.names, self.scales)), self.betas)
        return ((s[:, 1] - s[:, 2]) / np.maximum(s[:, 0], 1) / np.log(2)).tolist()

    def scores(self, rows: DataFrame, i: int = 0) -> DataFrame:
        """Adds score of the i-th ridge, to be used within strata."""
        x = standardised(self.names, self.scales)
        return rows.withColumn("score", F.aggregate(F.zip_with(x, F.array(*map(F.lit, self.betas[i].tolist())), lambda a, w: F.coalesce(a, F.lit(0.0)) * w), F.lit(0.0), lambda a, y: a + y))


class ConditionalLogit(LogitPath):
    """The path of one ridge."""

    def __init__(self, ridge: float, iterations: int = 30) -> None:
        super().__init__([ridge], iterations)

    @property
    def beta(self) -> np.ndarray:
        return self.betas[0]

    @property
    def loss(self) -> float:
        return self.losses[0]


def quantile_edges(rows: DataFrame, names: list[str], bins: int = 63) -> dict[str, list[float]]:
    """Inner edges of equal-count bins, exact: the values at ranks ceil(i n / bins); equal edges are one.

    All values of all features are numbered once over range partitions; only the values at the ranks asked for come back.
    Null and NaN have no rank."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(names)])
    long = materialize(rows.select(F.explode(pairs).alias("p")).select("p.i", "p.x").where("x is not null and not isnan(x)"), "values")
    counts = {r.i: r.n for r in long.groupBy("i").agg(F.count("*").alias("n")).collect()}  # a row a feature
    asked, before = [], 0
    for i in range(len(names)):
        n = counts.get(i, 0)
        asked += [(i, before + -(-k * n // bins)) for k in range(1, bins)] if n else []
        before += n
    if not asked:
        return {c: [] for c in names}
    wanted = rows.sparkSession.createDataFrame(sorted(set(asked)), "f int, rn long")  # features x bins
    got = numbered(long, F.col("i"), F.col("x")).join(F.broadcast(wanted), "rn").select("i", "x").distinct().collect()
    edges: dict[str, list[float]] = {c: [] for c in names}
    for r in got:
        edges[names[r.i]].append(r.x)
    return {c: sorted(e) for c, e in edges.items()}


def routed(tree: dict[int, tuple], bins: np.ndarray) -> np.ndarray:
    """The node that each row ends in; node k has the children 2 k and 2 k + 1."""
    at = np.ones(len(bins), np.int64)
    for node in sorted(k for k, t in tree.items() if t[0] == "split"):
        here = np.flatnonzero(at == node)
        at[here] = 2 * node + (bins[here, tree[node][1]] > tree[node][2])
    return at


def leaf_values(tree: dict[int, tuple], bins: np.ndarray) -> np.ndarray:
    at = routed(tree, bins)
    out = np.zeros(len(bins))
    for node in np.unique(at):
        out[at == node] = tree[node][1]
    return out


@dataclass
class Strata:
    """Strata that one task holds, with their score so far, and what a tree's scans share."""

    stratum: np.ndarray
    y: np.ndarray
    starts: np.ndarray
    bins: np.ndarray
    score: np.ndarray
    shared: tuple | None = None


class BoostedTrees:
    """Trees on binned features; gradient p - y, hessian max(p (1 - p), 1e-6), p the softmax within the stratum.

    leaves: at most so many a tree, best split first (2 ** depth: all splits with a gain, a level a scan). A split scans the
    smaller child only; its sibling's histogram is the parent's less that. bagging: the share of strata in each tree's sample, by a
    counter hash; features: the share of features that a tree may use. With `check` strata, fitting ends after `patience` trees
    without a better gain there, and the best number of trees is kept. Null and NaN fall into the first bin.

    A scan of few rows is all overhead: up to ALONE rows, training and check, a model is fitted in one task, and the models of a grid in as many."""

    FOLD = 10  # trees after which scores are written out
    ALONE = 1_500_000  # rows; some 100 bytes each

    def __init__(self, depth: int = 2, rate: float = 0.05, trees: int = 5, min_leaf: int = 20, bins: int = 63, leaves: int | None = None, bagging: float = 1.0, features: float = 1.0, patience: int | None = None, seed: int = 11) -> None:
        if not 2 <= bins <= 256:
            raise ValueError("a bin's number must fit a byte")
        self.depth, self.rate, self.n_trees, self.min_leaf, self.bins = depth, rate, trees, min_leaf, bins
        self.leaves, self.bagging, self.features, self.patience, self.seed, self.scans = leaves or 2**depth, bagging, features, patience, seed, 0

    def _packed(self, rows: DataFrame) -> DataFrame:
        """(stratum, y, bins: a byte a row and feature, score)."""
        edges, width = [np.array(self.edges[c]) for c in self.names], len(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, starts = _lists(batch.column(2))
                x = flat.reshape(-1, width)
                binned = np.stack([np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left")) for j, e in enumerate(edges)], axis=1).astype(np.uint8)
                at = np.append(starts, len(flat)) // width
                made = pa.array([binned[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
                zero = pa.array([np.zeros(b - a) for a, b in zip(at, at[1:], strict=False)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made, zero], ["stratum", "y", "bins", "score"])

        x = packed(rows.withColumn("stratum", F.col("stratum").cast("long")), F.array(*[F.col(c).cast("double") for c in self.names]))
        return materialize(x.mapInArrow(run, "stratum long, y array<boolean>, bins binary, score array<double>"), "boost")

    def _opened(self, batch: pa.RecordBatch | Strata) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """y, where strata begin, bins and scores, with the trees that are not written out yet."""
        if isinstance(batch, Strata):
            return batch.y, batch.starts, batch.bins, batch.score
        y, starts = _lists(batch.column(1))
        bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(y), len(self.names))
        score = _lists(batch.column(3))[0].copy()
        for tree in self.trees[self.folded :]:
            score += leaf_values(tree, bins)
        return y.astype(np.float64), starts, bins, score

    @staticmethod
    def _sums(data: DataFrame | Strata, work: Callable) -> dict[int, np.ndarray]:
        if not isinstance(data, Strata):
            return _summed(data, work)
        state: dict[int, np.ndarray] = {}
        work(data, state)
        return {key: sums.ravel() for key, sums in state.items()}

    def _histograms(self, data: DataFrame | Strata, tree: dict[int, tuple], nodes: list[int], used: list[int], number: int) -> dict[int, np.ndarray]:
        """node -> (feature, bin, 3): gradients, hessians, rows of the sample."""
        self.scans += 1
        wide, width = self.bins, len(used)

        def gradients(batch: pa.RecordBatch | Strata) -> tuple:
            if isinstance(batch, Strata) and batch.shared and batch.shared[0] == number:
                return batch.shared
            y, starts, bins, score = self._opened(batch)
            p, _ = softmax(score, starts)
            inside = np.ones(len(y), bool)
            if self.bagging < 1:
                stratum = (batch.stratum if isinstance(batch, Strata) else batch.column(0).to_numpy()) % M
                drawn = mix_array((mix_array(stratum, self.seed) + number) % M, self.seed + 1) < self.bagging * M
                inside = np.repeat(drawn, np.diff(np.append(starts, len(y))))
            out = number, bins, p - y, np.maximum(p * (1 - p), 1e-6), inside, bins[:, used].astype(np.int64) + wide * np.arange(width)
            if isinstance(batch, Strata):
                batch.shared = out
            return out

        def work(batch: pa.RecordBatch | Strata, state: dict[int, np.ndarray]) -> None:
            _, bins, g, h, inside, place = gradients(batch)
            at = np.where(inside, routed(tree, bins), 0)
            for node in nodes:
                rows = at == node
                own = place[rows].ravel()
                sums = [np.bincount(own, None if w is None else np.repeat(w[rows], width), wide * width) for w in (g, h, None)]
                add(state, node, np.stack(sums, axis=1))

        got = self._sums(data, work)
        return {n: got[n].reshape(width, wide, 3) if n in got else np.zeros((width, wide, 3)) for n in nodes}

    def _best(self, hist: np.ndarray, used: list[int]) -> tuple[float, int, int]:
        """(gain, feature, last bin on the left); gain 0 if no split leaves enough rows on both sides."""
        left = np.cumsum(hist, axis=1)[:, :-1]
        whole = hist[0].sum(axis=0)
        right = whole - left
        gain = left[..., 0] ** 2 / (left[..., 1] + 1e-9) + right[..., 0] ** 2 / (right[..., 1] + 1e-9) - whole[0] ** 2 / (whole[1] + 1e-9)
        # Where bins between are empty, splits are the same: the first is taken.
        gain = np.where((left[..., 2] >= self.min_leaf) & (right[..., 2] >= self.min_leaf), gain, 0.0)
        top = gain.max(initial=0.0)
        if top <= 1e-9:
            return 0.0, 0, 0
        f, b = np.argwhere(gain >= top * (1 - 1e-12))[0]
        return float(top), used[int(f)], int(b)

    def _grow(self, data: DataFrame | Strata, number: int) -> dict[int, tuple]:
        width = max(1, round(self.features * len(self.names)))
        used = sorted(sorted(range(len(self.names)), key=lambda j: (mix_int((number * 4093 + j) % M, self.seed + 7), j))[:width])
        tree: dict[int, tuple] = {}
        hist = self._histograms(data, tree, [1], used, number)
        best = {1: self._best(hist[1], used)}
        while len(hist) < self.leaves:
            able = sorted((n for n in hist if best[n][0] > 0 and n.bit_length() <= self.depth), key=lambda n: (-best[n][0], n))
            able = able if self.leaves >= 2**self.depth else able[:1]
            if not able:
                break
            small = []
            for n in able:
                _, feature, bin_ = best[n]
                tree[n] = ("split", feature, bin_)
                left = hist[n][used.index(feature), : bin_ + 1, 2].sum()
                small.append(2 * n + int(2 * left > hist[n][0, :, 2].sum()))
            found = self._histograms(data, tree, small, used, number)
            for n, child in zip(able, small, strict=True):
                parent = hist.pop(n)
                hist[child], hist[child ^ 1] = found[child], parent - found[child]
                for k in (child, child ^ 1):
                    best[k] = self._best(hist[k], used)
        for n, h in hist.items():
            g, weight, _ = h[0].sum(axis=0)
            tree[n] = ("leaf", float(-self.rate * g / (weight + 1e-9)))
        return tree

    def _folded(self, data: DataFrame) -> DataFrame:
        """data with the scores of all trees so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, starts, _, score = self._opened(batch)
                parts = np.split(score, starts[1:]) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(parts, pa.list_(pa.float64()))], ["stratum", "y", "bins", "score"])

        return materialize(data.mapInArrow(run, "stratum long, y array<boolean>, bins binary, score array<double>"), "boost")

    def _gain(self, data: DataFrame | Strata) -> float:
        """Bits an event over chance."""
        self.scans += 1

        def work(batch: pa.RecordBatch | Strata, state: dict[int, np.ndarray]) -> None:
            y, starts, _, score = self._opened(batch)
            _, log_p = softmax(score, starts)
            sizes = np.diff(np.append(starts, len(y)))
            add(state, 0, np.array([(log_p + np.log(np.repeat(sizes, sizes)))[y > 0].sum(), y.sum()]))

        bits, n = self._sums(data, work).get(0, np.zeros(2))
        return float(bits / max(n, 1) / np.log(2))

    def _boost(self, data: DataFrame | Strata, held: DataFrame | Strata | None) -> None:
        self.trees, self.folded, self.gains, self.scans = [], 0, [], 0
        for number in range(self.n_trees):
            self.trees.append(self._grow(data, number))
            for part in (data, held):
                if isinstance(part, Strata):
                    part.score = part.score + leaf_values(self.trees[-1], part.bins)
            if held is not None:
                self.gains.append(self._gain(held))
                if self.patience and number - int(np.argmax(self.gains)) >= self.patience:
                    break
            if not isinstance(data, Strata) and len(self.trees) - self.folded >= self.FOLD:
                data, held = self._folded(data), None if held is None else self._folded(held)
                self.folded = len(self.trees)
        if self.gains and self.patience:
            self.trees = self.trees[: int(np.argmax(self.gains)) + 1]

    def fit(self, rows: DataFrame, names: list[str], check: DataFrame | None = None) -> BoostedTrees:
        return fit_grid([self], rows, names, check)[0]

    def _binned(self, rows: DataFrame) -> DataFrame:
        cut = lambda c: F.size(F.filter(F.array(*map(F.lit, self.edges[c])), lambda e: (F.col(c) > e) & ~F.isnan(c))) if self.edges[c] else F.lit(0)
        return rows.withColumn("__bins", F.array(*[cut(c).cast("int") for c in self.names]))

    def scores(self, rows: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("double")
        def score(bins: pd.Series) -> pd.Series:
            x = np.stack(bins.to_numpy()) if len(bins) else np.zeros((0, 1), int)
            return pd.Series(sum((leaf_values(tree, x) for tree in trees), np.zeros(len(x))))

        return self._binned(rows).withColumn("score", score("__bins")).drop("__bins")


def fit_grid(grid: list[BoostedTrees], rows: DataFrame, names: list[str], check: DataFrame | None = None) -> list[BoostedTrees]:
    """Fits models of the same number of bins; edges and binned strata are made once for all."""
    first = grid[0]
    edges = quantile_edges(rows, names, first.bins)
    for m in grid:
        if m.bins != first.bins:
            raise ValueError("a grid has one number of bins")
        m.names, m.edges, m.trees, m.folded, m.gains = names, edges, [], 0, []
    data, held = first._packed(rows), None if check is None else first._packed(check)
    both = data.withColumn("held", F.lit(False))
    both = both if held is None else both.unionByName(held.withColumn("held", F.lit(True)))
    n = both.agg(F.sum(F.size("y")).alias("n")).first().n or 0
    if not 0 < n <= first.ALONE:
        with ThreadPoolExecutor(len(grid)) as pool:  # one model's short scans leave most of a cluster idle
            list(pool.map(lambda m: m._boost(data, held), grid))
        return grid

    def opened(parts: list[pa.RecordBatch]) -> Strata:
        own = pa.Table.from_batches(parts).combine_chunks().to_batches()
        if not own:
            return Strata(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, len(names)), np.uint8), np.zeros(0))
        y, starts = _lists(own[0].column(1))
        bins = np.frombuffer(b"".join(own[0].column(2).to_pylist()), np.uint8).reshape(len(y), len(names))
        return Strata(own[0].column(0).to_numpy(), y.astype(np.float64), starts, bins, np.zeros(len(y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for i in batch.column("model").unique().to_pylist():
                of.setdefault(i, []).append(batch.filter(pa.compute.equal(batch.column("model"), i)))
        for i, parts in of.items():
            m = grid[i]
            kinds = [[b.filter(pa.compute.equal(b.column("held"), k)) for b in parts] for k in (False, True)]
            m._boost(opened(kinds[0]), opened(kinds[1]) if held_too else None)
            found = json.dumps({"trees": [list(t.items()) for t in m.trees], "gains": m.gains, "scans": m.scans})
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([found])], ["model", "found"])

    held_too = check is not None
    each = both.drop("score").withColumn("model", F.explode(F.array(*map(F.lit, range(len(grid))))))
    each = each.repartitionByRange(len(grid), "model").sortWithinPartitions("model", "held", "stratum")
    for r in each.mapInArrow(run, "model int, found string").collect():  # a row a model
        found, m = json.loads(r.found), grid[r.model]
        m.trees, m.gains, m.scans = [{int(k): tuple(t) for k, t in tree} for tree in found["trees"]], found["gains"], found["scans"]
    return grid
