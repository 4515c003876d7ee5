"""Nulls that shift events or tensors in time, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import physics, shifts
from tremorlake.plans import tidal

M = 2147483647


def phases(day, marks, heights, shift):
    """(inside, phase, height) of events between maxima."""
    out = []
    for t in day + shift:
        i = np.searchsorted(marks, t, side="right") - 1
        ok = 0 <= i < len(marks) - 1
        out.append((ok, 2 * math.pi * (t - marks[i]) / (marks[i + 1] - marks[i]) if ok else 0.0, heights[i] if ok else 0.0))
    return out


@pytest.fixture(scope="module")
def forcing():
    r = np.random.default_rng(4)
    marks = np.cumsum(r.uniform(0.4, 0.6, 900))
    return marks, r.uniform(1, 10, 900)


@pytest.mark.parametrize("edges", [None, [3.0, 6.0]])
def test_shifted_sums(spark, forcing, edges):
    marks, heights = forcing
    r = np.random.default_rng(1)
    events = [(str(r.choice(["a", "b"])), int(r.integers(3)), float(r.uniform(-5, 460))) for _ in range(200)]
    offsets = shifts.whole_days(7, 3, 60, avoid=(10.0,), within=1.5)
    assert len(offsets) == 7 and all(3 <= abs(o) <= 60 and abs(round(abs(o) / 10) * 10 - abs(o)) >= 1.5 for o in offsets)
    df = spark.createDataFrame([*events, (None, 1, 1.0), ("a", None, 1.0), ("a", 0, None)], "grp string, bin int, day double").repartition(3)
    tops = spark.createDataFrame(list(zip(marks.tolist(), heights.tolist(), strict=True)), "day double, height double")
    got = {(g.grp, g.bin, g.k, g.trial): (g.n, g.c, g.s, g.a) for g in shifts.shifted_sums(df, tops, offsets, edges, 2).collect()}
    want = {}
    for trial, shift in enumerate([0.0, *offsets]):
        found = phases(np.array([e[2] for e in events]), marks, heights, shift)
        for (grp, b, _), (ok, phase, height) in zip(events, found, strict=True):
            for k in (1, 2):
                if ok:
                    b_ = b if edges is None else sum(e <= height for e in edges)
                    n, c, s, a = want.get((grp, b_, k, trial), (0, 0.0, 0.0, 0.0))
                    want[grp, b_, k, trial] = (n + 1, c + math.cos(k * phase), s + math.sin(k * phase), a + height)
    assert set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x]) for x in want)


def test_shifted_tensors(spark):
    """Each block of 30 days has one offset a trial; the tensor is that of the shifted time, to the interpolation's error."""
    rows = [(-2000.3, 10.0, 20.0), (-1999.9, -40.0, 100.0), (-100.25, 60.0, -150.0), (500.75, 0.0, 0.0)]
    e = spark.createDataFrame(rows, "day double, lat_deg double, lon_deg double")
    got = {(r.day, r.trial): r for r in tidal._shifted_tensors(e, 3).collect()}
    assert len(got) == 16
    moved = []
    for day, lat, lon in rows:
        block = math.floor((day + 2191.0) / 30)
        for trial in range(4):
            v = shifts.mix_int((shifts.mix_int(trial, 4) + block % M) % M, 5)
            moved.append((day, trial, day + (v / M * 1.03505 if trial else 0.0), lat, lon))
            assert got[day, trial].offset == pytest.approx(moved[-1][2] - day, abs=1e-9)
    exact = physics.to_local(physics.tidal_tensor(spark.createDataFrame(moved, "day double, trial int, at double, lat double, lon double"), F.col("at")), "lat", "lon").collect()
    names = ("nn", "ne", "nd", "ee", "ed", "dd")
    size = max(abs(r[c]) for r in exact for c in names)
    for r in exact:
        assert [got[r.day, r.trial][c] for c in names] == pytest.approx([r[c] for c in names], abs=0.01 * size)


def test_amplitude_law(spark, forcing):
    marks, heights = forcing
    r = np.random.default_rng(2)
    day = r.uniform(80, 360, 600)
    bins, trials = 3, 12
    events = spark.createDataFrame([(i, float(d)) for i, d in enumerate(day)], "event_idx long, day double")
    tops = spark.createDataFrame(list(zip(marks.tolist(), heights.tolist(), strict=True)), "day double, height double")
    got = {r.bin: r for r in tidal.amplitude_law_of(events, tops, bins, trials, 10).collect()}
    own = phases(day, marks, heights, 0.0)
    order = sorted((h, i) for i, (ok, _, h) in enumerate(own) if ok)
    per = len(order) // bins
    of = {i: min(at // per, bins - 1) for at, (_, i) in enumerate(order)}
    edges = [min(h for h, i in order if of[i] == b) for b in range(1, bins)]
    power = lambda p: (sum(map(math.cos, p)) ** 2 + sum(map(math.sin, p)) ** 2) / len(p)
    fixed, slopes = {}, []
    for trial, shift in enumerate([0.0, *shifts.whole_days(trials)]):
        found = phases(day, marks, heights, shift)
        by_bin, by_edge = {}, {}
        for i, (ok, p, h) in enumerate(found):
            if ok and i in of:
                by_bin.setdefault(of[i], []).append((p, h))
                by_edge.setdefault(sum(e <= h for e in edges), []).append((p, h))
        fixed[trial] = {b: power([p for p, _ in v]) for b, v in by_bin.items()}
        if len(by_edge) == bins and min(map(len, by_edge.values())) >= 10:
            x, y = zip(*[(math.log(abs(np.mean([h for _, h in v]))), math.log(power([p for p, _ in v]))) for v in by_edge.values()], strict=True)
            slopes.append((trial, np.polyfit(x, y, 1)[0]))
    seen = slopes[0][1]
    assert slopes[0][0] == 0
    for b in range(bins):
        null = [f[b] for t, f in fixed.items() if t and b in f]
        assert got[b].observed == pytest.approx(fixed[0][b]) and got[b].p == pytest.approx((sum(x >= fixed[0][b] for x in null) + 1) / (trials + 1))
        assert got[b].slope == pytest.approx(seen) and got[b].p_slope == pytest.approx((sum(s >= seen for t, s in slopes if t) + 1) / (len(slopes)))


def test_nest_scores(spark):
    """Both nulls of the nests: tensors rotated one by one, standard deviations taken directly."""
    r = np.random.default_rng(8)
    n, series, planes = 64, r.normal(size=(64, 6)), r.normal(size=(9, 6))
    nests = [(3, 40.0, -120.0, [1, 5, 60], [4, 1, 2]), (70, -10.0, 30.0, [0, 63], [10, 3])]
    offsets = [7, 19, 64 + 3, 1, 5]
    df = spark.createDataFrame(nests, "nest int, lat double, lon double, places array<int>, counts array<long>")
    got = {(x.kind, x.nest, x.trial): x.score for x in shifts.nest_scores(df, series, planes, offsets, chunk=2).collect()}
    assert len(got) == 2 * (6 + 5)
    for nest, lat, lon, places, counts in nests:
        rows = spark.createDataFrame([(*map(float, v), lat, lon) for v in series], ", ".join(f"{c} double" for c in (*physics.COMPONENTS, "lat", "lon")))
        local = np.array([[x[c] for c in ("nn", "ne", "nd", "ee", "ed", "dd")] for x in physics.to_local(rows, "lat", "lon").collect()])
        stress = local @ planes.T
        score = lambda at: (stress[at].std(axis=0) / stress.std(axis=0)).min()  # noqa: B023,E731
        own = np.repeat(places, counts)
        for trial, off in enumerate([0, *offsets]):
            assert got["cyclic", nest, trial] == pytest.approx(score((own + off) % n))
            if trial:
                assert got["uniform", nest, trial] == pytest.approx(score(shifts.uniform_draws(nest, trial, len(own), n)))
    assert not np.array_equal(shifts.uniform_draws(64, 1, 50, 1000), shifts.uniform_draws(0, 2, 50, 1000))


def test_nests_search_the_whole_grid(spark, monkeypatch):
    """Strikes and dips every 15 degrees, rakes every 30, five frictions; trials in pieces have the same scores."""
    seen, keep = {}, shifts.nest_scores
    monkeypatch.setattr(tidal.shifts, "nest_scores", lambda nests, series, planes, offsets: seen.update(planes=planes, offsets=offsets) or keep(nests.limit(1), series, planes, offsets[:3]))
    tidal.nest_coulomb(spark, "/root/testdata/sf0.001")
    assert seen["planes"].shape == (24 * 6 * 12 * 5, 6) and len(seen["offsets"]) == 2000
    assert len(np.unique(seen["planes"].round(9), axis=0)) > 24 * 6 * 12
    series = np.random.default_rng(5).normal(size=(64, 6))
    nests = spark.createDataFrame([(3, 40.0, -120.0, [1, 5, 60], [4, 1, 2])], "nest int, lat double, lon double, places array<int>, counts array<long>")
    scores = lambda: sorted((x.kind, x.trial, x.score) for x in keep(nests, series, seen["planes"], list(range(1, 20))).collect())
    one = scores()
    monkeypatch.setattr(shifts, "PART", 3)
    two = scores()
    assert [x[:2] for x in one] == [x[:2] for x in two] and [x[2] for x in one] == pytest.approx([x[2] for x in two])


def test_nests_are_many_tasks_and_draws_come_in_pieces(spark, monkeypatch):
    """A few nests are dealt with their trials to more tasks than there are shuffle partitions; draws in pieces are the same draws."""
    want = np.bincount(shifts.uniform_draws(3, 7, 1000, 64), minlength=64)
    monkeypatch.setattr(shifts, "DRAWS", 37)
    assert (shifts.uniform_counts(3, 7, 1000, 64) == want).all()
    nests = spark.createDataFrame([(i, 10.0 * i, 20.0, [1, 5, 9], [4, 3, 2]) for i in range(4)], "nest int, lat double, lon double, places array<int>, counts array<long>")
    series = np.random.default_rng(1).normal(size=(64, 6))
    got = shifts.nest_scores(nests, series, np.eye(6), list(range(1, 201)))
    assert got.select(F.spark_partition_id()).distinct().count() > 6
    assert got.count() == 4 * (201 + 200)


def test_uplift_counts_equal_those_of_shifted_rows(spark):
    r = np.random.default_rng(6)
    rows = [(float(d), float(a), float(o), int(c)) for d, a, o, c in zip(r.uniform(-2190, 700, 300), r.uniform(-80, 80, 300), r.uniform(-180, 180, 300), r.integers(0, 3, 300), strict=True)]
    e = spark.createDataFrame([*rows, (None, 1.0, 1.0, 0), (5.0, None, 1.0, 2)], "day double, lat_deg double, lon_deg double, cell int").repartition(3)
    grid, start, step, _ = tidal._tensor_grid(spark)
    got = {(x.cell, x.trial): (x.n, x.known, x.up) for x in shifts.uplift_counts(e, grid, start, step, 4, 5, 30, 1.03505, -2191.0).collect()}
    want = tidal._shifted_tensors(e, 5).groupBy("cell", "trial").agg(F.count("*").alias("n"), F.count("dd").alias("known"), F.count_if(F.col("dd") > 0).alias("up"))
    assert len(got) == 18 and got == {(x.cell, x.trial): (x.n, x.known, x.up) for x in want.collect()}


def test_ways_to_bin_share_their_phases(spark, forcing):
    marks, heights = forcing
    r = np.random.default_rng(9)
    rows = [(g, b, d) for g, b, d in [(str(r.choice(["a", "b"])), int(r.integers(2)), float(r.uniform(-5, 460))) for _ in range(60)] for _ in range(3)]
    e = spark.createDataFrame(rows, "grp string, bin int, day double").repartition(3)
    tops = spark.createDataFrame(list(zip(marks.tolist(), heights.tolist(), strict=True)), "day double, height double")
    offsets, edges = shifts.whole_days(5, 3, 60), [3.0, 6.0]
    got = {(x.which, x.grp, x.bin, x.trial): (x.n, x.c, x.s, x.a) for x in shifts.shifted_sums_of(e, tops, offsets, [None, edges]).collect()}
    want = {}
    for trial, shift in enumerate([0.0, *offsets]):
        for (grp, b, _), (ok, phase, height) in zip(rows, phases(np.array([x[2] for x in rows]), marks, heights, shift), strict=True):
            for which, at in enumerate((b, sum(x <= height for x in edges)) if ok else ()):
                own = want.get((which, grp, at, trial), (0, 0.0, 0.0, 0.0))
                want[which, grp, at, trial] = (own[0] + 1, own[1] + math.cos(phase), own[2] + math.sin(phase), own[3] + height)
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
