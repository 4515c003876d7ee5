"""Conditional logits and boosted trees against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import models, scores
from tremorlake.operators.matrix import mix_array
from tremorlake.operators.shifts import mix_int

M = 2147483647


def strata(n, seed, effect=1.0, noise=2):
    """[(stratum, is_case, a, b, ...)]: the case is drawn by softmax of `effect` times a."""
    r = random.Random(seed)
    rows = []
    for s in range(n):
        x = [[r.gauss(0, 1), r.choice([0.0, 1.0, 2.0]), *[r.gauss(0, 1) for _ in range(noise)]] for _ in range(r.randrange(2, 6))]
        w = [math.exp(effect * (v[0] + (v[1] == 2.0))) for v in x]
        case = r.choices(range(len(x)), w)[0]
        rows += [(s, i == case, *v) for i, v in enumerate(x)]
    return rows


def frame(spark, rows):
    names = ["a", "b", *[f"n{i}" for i in range(len(rows[0]) - 4)]]
    return spark.createDataFrame(rows, "stratum long, is_case boolean, " + ", ".join(f"{c} double" for c in names)).repartition(4), names


def test_eight_ridges_share_their_scans(spark):
    rows = strata(150, 2)
    df, names = frame(spark, rows)
    ridges = [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0]
    path = models.LogitPath(ridges, 25).fit(df, names)
    x = np.array([r[2:] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))

    def loss(b, ridge):
        return -models.softmax(x @ b, starts)[1][y].sum() / y.sum() + 0.5 * ridge * b @ b

    slopes = []
    for b, ridge, f in zip(path.betas, ridges, path.losses, strict=True):
        assert f == pytest.approx(loss(b, ridge), abs=1e-9)
        near = [(loss(b + h, ridge) - loss(b - h, ridge)) / 2e-5 for h in 1e-5 * np.eye(len(b))]
        slopes.append(np.abs(near).max())
    assert max(slopes) < 1e-4
    assert [b[0] for b in path.betas] == sorted((b[0] for b in path.betas), reverse=True)
    slowest = 0
    for ridge, b in zip(ridges[:3], path.betas, strict=False):
        one = models.ConditionalLogit(ridge, 25).fit(df, names)
        assert one.beta == pytest.approx(b, abs=1e-9)
        slowest = max(slowest, one.scans)
    assert path.scans <= slowest + 12
    before = path.scans
    gains = path.gains(df)
    assert path.scans == before + 1
    sizes = np.diff(np.append(starts, len(s)))
    assert gains[0] == pytest.approx(float(np.mean(models.softmax(x @ path.betas[0], starts)[1][y] + np.log(sizes)) / np.log(2)))


def test_edges_are_exact_quantiles(spark):
    r = random.Random(1)
    rows = [(r.choice([1.0, 2.0, 3.0]), r.gauss(0, 1), None, 5.0 if i % 2 else float("nan")) for i in range(257)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    got = models.quantile_edges(df, ["a", "b", "c", "d"], 16)
    for i, c in enumerate("abcd"):
        x = sorted(v[i] for v in rows if v[i] is not None and not math.isnan(v[i]))
        assert got[c] == sorted({x[math.ceil(k * len(x) / 16) - 1] for k in range(1, 16)} if x else set())
    assert models.quantile_edges(df.where("false"), ["a"], 4) == {"a": []}


def boosted(rows, names, check, depth, rate, trees, min_leaf, bins, leaves, bagging, features, patience, seed):
    """The same trees without histograms, subtraction or bins: every split of every leaf is tried on the rows themselves."""
    x, y, s = np.array([r[2:] for r in rows]), np.array([float(r[1]) for r in rows]), np.array([r[0] for r in rows])
    edges = []
    for j in range(x.shape[1]):
        v = np.sort(x[:, j])
        edges.append(sorted({v[math.ceil(k * len(v) / bins) - 1] for k in range(1, bins)}))
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    score, out = np.zeros(len(x)), []
    for number in range(trees):
        p = models.softmax(score, starts)[0]
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        inside = mix_array((mix_array(s % M, seed) + number) % M, seed + 1) < bagging * M if bagging < 1 else np.ones(len(s), bool)
        used = sorted(sorted(range(len(names)), key=lambda j: (mix_int((number * 4093 + j) % M, seed + 7), j))[: max(1, round(features * len(names)))])

        def best(rows, used=used, g=g, h=h, inside=inside):
            top = (0.0, 0, 0)
            rows = rows & inside
            for j in used:
                for k, e in enumerate(edges[j]):
                    left, right = rows & (x[:, j] <= e), rows & (x[:, j] > e)
                    if min(left.sum(), right.sum()) >= min_leaf:
                        gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1e-9) for m in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1e-9)
                        if gain > top[0] * (1 + 1e-10) + 1e-9:
                            top = (gain, j, k)
            return top

        tree, at = {}, {1: np.ones(len(x), bool)}
        while len(at) < leaves:
            able = sorted((-b[0], n, b) for n, rows in at.items() if n.bit_length() <= depth and (b := best(rows))[0] > 1e-9)
            if not able:
                break
            _, n, (_, j, k) = able[0]
            rows = at.pop(n)
            tree[n] = ("split", j, k)
            at[2 * n], at[2 * n + 1] = rows & (x[:, j] <= edges[j][k]), rows & (x[:, j] > edges[j][k])
        for n, rows in at.items():
            m = rows & inside
            tree[n] = ("leaf", -rate * g[m].sum() / (h[m].sum() + 1e-9))
            score = score + np.where(rows, tree[n][1], 0)
        out.append(tree)
    return out


@pytest.mark.parametrize("leaves,bagging,features", [(None, 1.0, 1.0), (3, 0.7, 0.5), (5, 0.8, 1.0)])
def test_trees_are_those_of_plain_loops(spark, monkeypatch, leaves, bagging, features):
    monkeypatch.setattr(models.BoostedTrees, "FOLD", 2)
    rows = strata(120, 7)
    df, names = frame(spark, rows)
    options = {"depth": 3, "rate": 0.3, "trees": 4, "min_leaf": 5, "bins": 8, "leaves": leaves, "bagging": bagging, "features": features, "patience": None, "seed": 11}
    got = models.BoostedTrees(**options).fit(df, names)
    want = boosted(rows, names, None, **{**options, "leaves": leaves or 8})
    assert [{n: t for n, t in tree.items() if t[0] == "split"} for tree in got.trees] == [{n: t for n, t in tree.items() if t[0] == "split"} for tree in want]
    for a, b in zip(got.trees, want, strict=True):
        assert {n: t[1] for n, t in a.items() if t[0] == "leaf"} == pytest.approx({n: t[1] for n, t in b.items() if t[0] == "leaf"})
    scored = got.scores(df).groupBy("stratum").agg(F.sum("score").alias("s")).agg(F.sum("s")).first()[0]
    x = np.array([r[2:] for r in rows])
    bins = np.stack([np.searchsorted(got.edges[c], x[:, j], side="left") for j, c in enumerate(names)], axis=1)
    assert scored == pytest.approx(sum(models.leaf_values(t, bins).sum() for t in got.trees))


def test_fitting_ends_when_the_check_gets_no_better(spark):
    df, names = frame(spark, strata(100, 3))
    check, _ = frame(spark, strata(80, 4))
    m = models.BoostedTrees(depth=3, rate=0.8, trees=30, min_leaf=2, bins=16, patience=3).fit(df, names, check)
    at = int(np.argmax(m.gains))
    assert len(m.gains) == at + 4 < 30 and len(m.trees) == at + 1 and m.gains[at] > 0


def test_a_grid_is_the_same_in_one_task_and_in_scans(spark, monkeypatch):
    """Each model of a grid as fitted by itself, whether strata stand in one task or are scanned; scores of hundreds of trees."""
    rows, held = strata(60, 3), strata(40, 4)
    (df, names), (check, _) = frame(spark, rows), frame(spark, held)
    made = lambda: [models.BoostedTrees(depth=d, rate=r, trees=4, min_leaf=4, bins=8, bagging=0.8, features=0.5, patience=2) for d, r in ((2, 0.3), (3, 0.1))]
    here = models.fit_grid(made(), df, names, check)
    alone = [m.fit(df, names, check) for m in made()]
    monkeypatch.setattr(models.BoostedTrees, "ALONE", 0)
    monkeypatch.setattr(models.BoostedTrees, "FOLD", 2)
    scanned = models.fit_grid(made(), df, names, check)
    for group in (alone, scanned):
        for a, b in zip(here, group, strict=True):
            assert a.gains == pytest.approx(b.gains) and len(a.trees) == len(b.trees)
            for s, t in zip(a.trees, b.trees, strict=True):
                assert s.keys() == t.keys() and all(s[n][0] == t[n][0] and s[n][1:] == pytest.approx(t[n][1:]) for n in s)
    with pytest.raises(ValueError):
        models.fit_grid([models.BoostedTrees(bins=8), models.BoostedTrees(bins=9)], df, names)
    m = here[1]
    best = max(m.gains)
    assert scores.information_gain(m.scores(check)).first()["bits_per_event"] == pytest.approx(best)
    m.trees = m.trees * 300
    assert m.scores(check).where("score is null").count() == 0


@pytest.mark.parametrize("program", ["train_gbt", "train_gbt_stream"])
def test_programs_boost_until_validation_stops_them(spark, monkeypatch, program):
    """Three depths at two rates, a thousand trees at most, and fifty without a better gain end a fit."""
    from tremorlake.plans import QUERIES

    seen, keep = [], models.fit_grid
    monkeypatch.setattr(models, "fit_grid", lambda grid, *x: (seen.extend(keep(grid, *x)), seen)[1])
    got = QUERIES[program](spark, "/root/testdata/sf0.001")
    assert {(r.depth, r.rate) for r in got.collect()} == {(d, r) for d in (2, 3, 4) for r in (0.01, 0.05)}
    assert {(m.n_trees, m.patience) for m in seen} == {(1000, 50)} and all(len(m.gains) == min(1000, len(m.trees) + 50) for m in seen)


def test_no_strata_and_odd_values(spark):
    df, names = frame(spark, strata(5, 3))
    none = df.where("false")
    assert models.LogitPath([0.1, 1.0], 3).fit(none, names).betas.tolist() == [[0.0] * 4] * 2
    assert models.BoostedTrees(trees=2).fit(none, names).trees[0] == {1: ("leaf", 0.0)}
    odd = df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))).withColumn("b", F.when(F.col("b") > 0, F.col("b")).otherwise(float("nan")))
    m = models.BoostedTrees(trees=2, min_leaf=1, bins=4).fit(odd, names)
    assert m.scores(odd).where("score is null or isnan(score)").count() == 0


def test_halves_are_split_once(spark):
    from tremorlake.plans.modelling import _halves

    rows = [(s, i, i == 0, -1500.0 + 7 * s + i) for s in range(300) for i in range(3)]
    d = spark.createDataFrame(rows, "stratum long, row_idx long, is_case boolean, day double")
    train, check = _halves(d)
    assert sorted(r.stratum for r in train.select("stratum").distinct().collect()) == [s for s in range(300) if -1500 + 7 * s < -500]
    assert sorted(r.stratum for r in check.select("stratum").distinct().collect()) == [s for s in range(300) if -500 <= -1500 + 7 * s < 731]
    assert not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in (train, check))
