"""Operators against plain Python, and known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tremorlake.functions import distributions, geo, labels
from tremorlake.functions.time import civil_day, iso_day
from tremorlake.operators import circular, decluster, design, models, physics, scores, tables, tides
from tremorlake.sources import catalogues


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_day_numbers(spark):
    for y, m, d, want in ((2000, 1, 1, 0), (1999, 12, 31, -1), (1976, 1, 1, -8766), (2024, 12, 31, 9131), (2010, 2, 31, 3714)):
        assert one(spark, civil_day(F.lit(y), F.lit(m), F.lit(d))) == want
    assert one(spark, iso_day(F.lit("2010-06-15T12:30:00Z"))) == 3818 + 12.5 / 24
    assert one(spark, iso_day(F.lit("2010-13-15T12:30:00Z"))) is None


def test_windows_and_distance(spark):
    assert 52 < one(spark, geo.window_km(F.lit(6.0))) < 55 and 70 < one(spark, geo.window_km(F.lit(7.0))) < 73
    assert 490 < one(spark, geo.window_days(F.lit(6.0))) < 520 and 905 < one(spark, geo.window_days(F.lit(7.0))) < 925
    assert abs(one(spark, geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) - 111.19) < 0.01
    assert abs(one(spark, geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - math.pi * 6371) < 1e-6


def test_grid(spark):
    g = geo.Grid(100.0)
    t = g.table(spark)
    total = t.select(F.sum(g.area_km2(F.col("band"), F.col("n_lon")) * F.col("n_lon"))).first()[0]
    assert abs(total / (4 * math.pi * 6371**2) - 1) < 1e-12 and g.n_lon[0] == g.n_lon[-1] == 3
    pts = spark.createDataFrame([(90.0, 0.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (10.0, 359.9), (95.0, 720.0)], "lat_deg double, lon_deg double")
    out = g.cell_of(pts).collect()
    assert all(0 <= r.cell < g.cells for r in out)
    centres = g.cell_of(pts).select("cell", F.col("cell_lat").alias("lat_deg"), F.col("cell_lon").alias("lon_deg")).withColumnRenamed("cell", "was")
    assert all(r.was == r.cell for r in g.cell_of(centres).collect())


def test_labels(spark):
    mech = lambda r: one(spark, labels.mechanism(F.lit(float(r))))
    assert [mech(r) for r in (90, 70, -90, -110, 0, 180, -180, 45)] == ["thrust", "thrust", "normal", "normal", "strike-slip", "strike-slip", "strike-slip", "strike-slip"]
    assert one(spark, labels.depth_class(F.lit(70.0))) == "deep" and one(spark, labels.depth_class(F.lit(70.0), inclusive=True)) == "shallow"


@pytest.mark.parametrize("seed", [1, 2])
def test_declustering_equals_greedy(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, 3000), r.uniform(-3, 3), r.uniform(-3, 3), 10.0, round(r.uniform(4, 7.5), 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_idx long, day double, lat_deg double, lon_deg double, depth_km double, magnitude double")
    order = sorted(rows, key=lambda e: (-e[5], e[1], e[0]))
    claimed, main = set(), set()
    for e in order:
        if e[0] in claimed:
            continue
        claimed.add(e[0])
        main.add(e[0])
        days = 10 ** (0.032 * e[5] + 2.7389) if e[5] >= 6.5 else 10 ** (0.5409 * e[5] - 0.547)
        reach = 10 ** (0.1238 * e[5] + 0.983)
        claimed |= {o[0] for o in rows if abs(o[1] - e[1]) <= days and km(e[2:4], o[2:4]) <= reach}
    size = F.col("magnitude")
    pieces = decluster.greedy(df, decluster.window_days(size), decluster.window_km(size), -size, F.col("day"), two_sided=True, few=10)
    assert {x.event_idx for x in pieces.where("is_main").collect()} == main and pieces.count() == 400
    got = decluster.gardner_knopoff(df)
    assert {x.event_idx for x in got.where("is_main").collect()} == main and got.count() == 400


def test_thinning_equals_greedy(spark):
    r = random.Random(3)
    rows = [(i, float(r.randint(0, 900)), r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_idx long, day double, lat_deg double, lon_deg double")
    kept = []
    for e in sorted(rows, key=lambda e: (e[1], e[0])):
        if all(e[1] - k[1] > 365 or km(e[2:], k[2:]) > 500 for k in kept):
            kept.append(e)
    assert {x.event_idx for x in decluster.thin(df, 500, 365).where("is_main").collect()} == {k[0] for k in kept}
    assert decluster.thin(df, 0, 0).where("is_main").count() == 300
    assert decluster.thin(df.where("false"), 500, 365).count() == 0


def _greedy(rows, days, reach, flat):
    """Ids that stay, by a loop over (id, day, lat, lon) in order of time."""
    kept = []
    for e in sorted(rows, key=lambda e: (e[1], e[0])):
        far = lambda k: math.hypot((e[2] - k[2]) * 111.19, (e[3] - k[3]) * 111.19 * math.cos(math.radians(e[2]))) >= reach if flat else km(e[2:], k[2:]) > reach
        if all(e[1] - k[1] > days or far(k) for k in kept):
            kept.append(e)
    return {k[0] for k in kept}


@pytest.mark.parametrize("flat", [False, True])
def test_thinning_in_pieces(spark, flat):
    """Cells, dense places, the date line and the poles: the same as one event after the other."""
    r = random.Random(11)
    rows = [(i, float(r.randint(0, 4000)), r.uniform(-88, 88), r.choice([r.uniform(-180, 180), r.uniform(175, 185) - 360 * (r.random() < 0.5)])) for i in range(500)]
    rows += [(1000 + i, float(r.randint(0, 900)), r.gauss(10, 0.3), r.gauss(20, 0.3)) for i in range(400)]
    rows += [(2000 + i, float(r.randint(0, 900)), r.uniform(87, 90), r.uniform(-180, 180)) for i in range(60)]
    rows = [(i, d, lat, (lon + 180) % 360 - 180) for i, d, lat, lon in rows]
    df = spark.createDataFrame([*rows, (5000, None, 1.0, 1.0), (5001, 3.0, float("nan"), 1.0)], "event_idx long, day double, lat_deg double, lon_deg double")
    got = decluster.greedy(df, F.lit(40.0), F.lit(120.0), F.col("day"), F.lit(0.0), two_sided=False, flat=flat, few=5)
    assert {x.event_idx for x in got.where("is_main").collect()} == _greedy(rows, 40, 120, flat) | {5000, 5001}
    assert got.count() == len(rows) + 2


def test_declustering_writes_no_more_in_dense_places(spark, monkeypatch):
    """Rows written by all rounds: at most a few for each event, whatever their number in one place."""
    written = []
    keep = decluster.materialize
    monkeypatch.setattr(decluster, "materialize", lambda df, name: (out := keep(df, name), written.append(out.count()))[0])
    sums = []
    for n in (400, 800, 1600):
        r = random.Random(5)
        rows = [(i, r.uniform(0, 300), r.gauss(0, 0.2), r.gauss(0, 0.2), 4 + min(3.0, r.expovariate(2))) for i in range(n)]
        df = spark.createDataFrame(rows, "event_idx long, day double, lat_deg double, lon_deg double, magnitude double")
        written.clear()
        size = F.col("magnitude")
        got = decluster.greedy(df, decluster.window_days(size), decluster.window_km(size), -size, F.col("day"), two_sided=True, few=0)
        assert got.count() == n
        sums.append(sum(written) / n)
    assert max(sums) < 5 and sums[2] < 1.3 * sums[0]


def test_dense_chains_over_cells(spark):
    """Long chains of claims over several cells: the greedy choice."""
    r = random.Random(8)
    rows = [(i, r.uniform(0, 330), r.uniform(-14, 14), r.uniform(-14, 14)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_idx long, day double, lat_deg double, lon_deg double")
    got = decluster.greedy(df, F.lit(40.0), F.lit(300.0), F.col("day"), F.lit(0.0), two_sided=False, few=0)
    assert {x.event_idx for x in got.where("is_main").collect()} == _greedy(rows, 40, 300, False)


@pytest.mark.parametrize("few", [0, 300, None])
def test_a_sweep_shares_its_rounds(spark, monkeypatch, few):
    """Each setting's own greedy choice, in cells, in one task, or some in each; events are written once for all settings."""
    written, keep = [], decluster.materialize
    monkeypatch.setattr(decluster, "materialize", lambda df, name: (written.append(name), keep(df, name))[1])
    r = random.Random(17)
    rows = [(i, r.uniform(0, 900), r.uniform(-20, 20), r.uniform(-20, 20)) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0)], "event_idx long, day double, lat_deg double, lon_deg double")
    settings = [(0, 0), (200, 40), (500, 90), (1500, 30)]
    got = [tuple(x) for x in decluster.thin_sweep(df, settings, flat=True, few=few).collect()]
    want = {(0, e[0]) for e in rows} | {(i, e) for i, (km_, days) in enumerate(settings) if km_ for e in _greedy(rows, days, km_, True)} | {(i, 900) for i in range(4)}
    assert len(got) == len(want) and set(got) == want
    assert written.count("events") == 1 and written.count("found") < 15
    assert decluster.thin_sweep(df, [(0, 0)]).count() == 401 and decluster.thin_sweep(df.where("false"), settings).count() == 0


def test_edges_equal_all_pairs_and_events_stand_in_few_cells(spark):
    """Dense and lonely places, the date line and poles: the pairs of a double loop; an event meets the cells of its window only."""
    r = random.Random(21)
    spots = [(0.0, 0.0, 3.0), (0.0, 179.9, 3.0), (88.0, 0.0, 1.9), (-60.0, -179.0, 4.0)]
    rows = [(i, r.uniform(-100, 100), max(-90.0, min(90.0, a + r.uniform(-w, w))), (b + r.uniform(-w, w) * (30 if a > 80 else 1) + 180) % 360 - 180, r.uniform(3, 30), r.uniform(20, 200)) for i, (a, b, w) in ((i, spots[i % 4]) for i in range(400))]
    df = spark.createDataFrame(rows, "event_idx long, day double, lat_deg double, lon_deg double, days double, km double")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    near = b("day").between(a("day") - a("__days"), a("day") + a("__days")) & (decluster.distance_km(a("lat_deg"), a("lon_deg"), b("lat_deg"), b("lon_deg")) <= a("__km"))
    got = [tuple(x) for x in decluster.window_edges(df, F.col("days"), F.col("km"), a("event_idx") < b("event_idx"), near).collect()]
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] - x[4] <= y[1] <= x[1] + x[4] and km(x[2:4], y[2:4]) <= x[5]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    line = spark.createDataFrame([(i, 64.0 * i + 8, 0.1, 0.1) for i in range(20)], "event_idx long, day double, lat_deg double, lon_deg double")
    assert decluster.window_edges(line, F.lit(17.0), F.lit(9.0), F.lit(True), F.lit(True)).count() < 20


@pytest.mark.parametrize("most", [1 << 20, 50])
@pytest.mark.parametrize("two_sided", [True, False])
def test_claims_equal_all_pairs_and_events_are_shuffled_a_few_times(spark, monkeypatch, two_sided, most):
    """Dense and lonely places, the date line, poles, ties, repeated ids, values that are missing; groups of a dense cell are cut in pieces."""
    met, keep = [], decluster.Cells.reached
    monkeypatch.setattr(decluster.Cells, "reached", lambda *x: (met.append(keep(*x)), met[-1])[1])
    monkeypatch.setattr(decluster, "PAIRS", most)
    r = random.Random(22)
    spots = [(0.0, 0.0, 3.0), (0.0, 179.9, 3.0), (88.0, 0.0, 1.9), (-60.0, -179.0, 4.0), (20.0, 40.0, 40.0)]
    place = lambda a, b, w: (max(-90.0, min(90.0, a + r.uniform(-w, w))), (b + r.uniform(-w, w) * (30 if a > 80 else 1) + 180) % 360 - 180)
    rows = [(i % 480, float(r.randint(-100, 100)), *place(*spots[i % 5]), r.choice([3.0, 20.0, 30.0]), r.uniform(20, 200), r.choice([4.0, 5.0, 6.0])) for i in range(500)]
    df = spark.createDataFrame([*rows, (900, None, 0.0, 0.0, 30.0, 200.0, 9.0), (901, 0.0, 0.0, 0.0, 30.0, 200.0, None)], "event_idx long, day double, lat_deg double, lon_deg double, days double, km double, magnitude double")
    p0, p1 = (-F.col("magnitude"), F.col("day")) if two_sided else (F.col("day"), F.lit(0.0))
    order = (lambda e: (-e[6], e[1], e[0])) if two_sided else (lambda e: (e[1], 0.0, e[0]))
    df = df if two_sided else df.where("magnitude is not null")
    got = [tuple(x) for x in decluster.claim_edges(df, F.col("days"), F.col("km"), p0, p1, two_sided).collect()]
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and order(x) < order(y) and abs(y[1] - x[1]) <= x[4] and km(x[2:4], y[2:4]) <= x[5]]
    assert sorted(got) == sorted(want) and len(want) > 500
    assert met[0].where("abs(lat) < 80").count() < 3.5 * len(rows)
    assert decluster.claim_edges(df.where("false"), F.col("days"), F.col("km"), p0, p1, two_sided).count() == 0


def test_windows_end_as_in_sql(spark):
    """Days whose difference rounds to 365, though the later one is past the first one's day + 365: BETWEEN says no."""
    a, b = -366 + 1 / 86400, -1 + 1 / 86400
    assert b - a <= 365 and b > a + 365
    df = spark.createDataFrame([(1, a, 0.0, 0.0), (2, b, 0.0, 0.0)], "event_idx long, day double, lat_deg double, lon_deg double")
    assert decluster.thin(df, 500, 365).where("is_main").count() == 2


def test_designs(spark):
    # 1977, 1983 and 2012, in blocks of five years; the first block begins before the span
    days = (-8338.5, -6070.25, 4604.75)
    cases = spark.createDataFrame([(i, day, 1, 0.0, 0.0, True, 6.0) for i, day in enumerate(days, 1)], "stratum long, day double, cell long, lat_deg double, lon_deg double, is_case boolean, magnitude double")
    n = {r.stratum: r["count"] for r in design.year_stratified(cases, (-8766.0, 9132.0), 5).groupBy("stratum").count().collect()}
    assert n == {2: 5, 3: 5}
    t = design.time_stratified(cases, (-8766.0, 9132.0), 7).where("stratum = 3 and not is_case").collect()
    assert sorted(r.day - days[2] for r in t) == [-7.0, 7.0, 14.0, 21.0]
    d = design.drawn(cases, (-8766.0, 9132.0), "offset", 10, 60).where("not is_case").collect()
    assert len(d) == 30 and all(abs((r.day * 4) % 1) < 1e-9 for r in d)


def test_draws_equal_a_loop_and_many_are_quick(spark):
    """The first draws inside the span that differ, tried in order; tens of thousands of cases in one task within seconds."""
    import time

    from tremorlake.operators.shifts import mix_int

    M = 2147483647
    u = lambda s, j, seed: mix_int((mix_int(s, seed) + j) % M, seed + 1) / M
    at = {
        "offset": lambda s, d, j: d + (1 + math.floor(u(s, j, 7) * 6)) * (-1 if u(s, j, 9) < 0.5 else 1),
        "window": lambda s, d, j: d + (u(s, j, 7) * 2 - 1) * 6,
        "uniform": lambda s, d, j: 0.0 + u(s, j, 7) * 9.5,
    }
    schema = "stratum long, day double, cell long, lat_deg double, lon_deg double, is_case boolean, magnitude double"
    rows = [(s * 7919, s % 10 * 0.95, 1, 0.0, 0.0, True, 5.0) for s in range(60)] + [(None, 3.0, 1, 0.0, 0.0, True, 5.0), (8, None, 1, 0.0, 0.0, True, 5.0)]
    for scheme, t in at.items():
        want = set()
        for s, d, *_ in rows:
            if s is not None and d is not None:
                tried = [x for x in (t(s, d, j) for j in range(1, 57)) if 0 <= x <= 9.5]
                want |= {(s, x) for x in list(dict.fromkeys(tried))[:6]}
        got = design.drawn(spark.createDataFrame(rows, schema), (0.0, 9.5), scheme, 6, 6, 7).where("not is_case").select("stratum", "day").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    cases = spark.range(30000).coalesce(1).select(F.col("id").alias("stratum"), (F.col("id") % 900).cast("double").alias("day"), F.lit(1).cast("long").alias("cell"), F.lit(0.0).alias("lat_deg"), F.lit(0.0).alias("lon_deg"), F.lit(True).alias("is_case"), F.lit(5.0).alias("magnitude"))
    began = time.perf_counter()
    assert design.drawn(cases, (0.0, 900.0), "window", 10, 30.0).where("not is_case").count() == 300000
    assert time.perf_counter() - began < 15


def test_scores_find_what_is_planted(spark):
    base = spark.range(400 * 6).select(F.floor(F.col("id") / 6).alias("stratum"), (F.col("id") % 6).alias("row_idx")).withColumns({"is_case": F.col("row_idx") == 0, "x": ((F.col("stratum") * 31 + F.col("row_idx") * 17) % 23).cast("double")})
    z = lambda d: scores.conditional_score(scores.melt(d, {"x": F.col("x")})).first().z
    assert abs(z(base)) < 4 and z(design.plant(base, "x", 1.0)) > 8 and abs(z(design.shuffle_labels(base))) < 4


def test_bins_and_numbers(spark):
    df = spark.range(103).select(((F.col("id") * 37) % 103).alias("v"))
    got = {r.bin: r["count"] for r in tables.equal_count_bins(df, F.col("v"), 5).groupBy("bin").count().collect()}
    assert got == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}
    assert all(r.rn == r.v + 1 for r in tables.numbered(df, F.asc("v")).collect())


def test_constituents():
    for name, days in (("M2", 0.517525), ("S2", 0.5), ("N2", 0.527431), ("K1", 0.997270), ("O1", 1.075806), ("Q1", 1.119515), ("Mf", 13.660791), ("Mm", 27.554550), ("Ssa", 182.6211)):
        assert abs(tides.constituent(name).period_days / days - 1) < 1e-4


def test_block_shift_equals_direct(spark):
    """The collapsed null against phases evaluated anew for each event and trial."""
    r = random.Random(5)
    days = sorted(r.uniform(0, 400) for _ in range(200))
    df = spark.createDataFrame([(d,) for d in days], "day double")
    sums = circular.block_sums(df, tides.table(spark, ["M2"]), [])
    c = tides.constituent("M2")

    def mix(v, s):
        v = (v * 48271 + s) % 2147483647
        for k in (12345, 67891, 424243):
            v = (v * ((v % 65521) + k)) % 2147483647
        return v

    null = []
    for t in range(1, 21):
        off = lambda b, t=t: mix((mix(t, 11) + b) % 2147483647, 12) / 2147483647 * c.period_days
        a = [math.radians(c.start + c.rate * (d + off(int((d - days[0]) // 30)))) for d in days]
        null.append((sum(map(math.cos, a)) ** 2 + sum(map(math.sin, a)) ** 2) / len(a))
    got = circular.block_shift_null(sums, [], 20).first()
    assert abs(got.null_max - max(null)) < 1e-6 and abs(got.null_median - sorted(null)[10]) < 1e-6


def test_tensor_and_sky(spark):
    d = physics.series(spark, 0.0, 1.0, 60)
    x = physics.tidal_tensor(d, F.col("day"), ("moon",)).select((F.col("xx") + F.col("yy") + F.col("zz")).alias("t"), F.sqrt(F.col("xx") ** 2 + F.col("yy") ** 2 + F.col("zz") ** 2 + 2 * F.col("xy") ** 2 + 2 * F.col("xz") ** 2 + 2 * F.col("yz") ** 2).alias("n")).collect()
    assert max(abs(r.t) for r in x) < 1e-25
    assert all(6e-14 * 2 < r.n < 1.2e-13 * 2.5 for r in x)  # sqrt(6) GM / d^3 between apogee and perigee


def test_tails(spark):
    assert abs(one(spark, distributions.normal_sf(F.lit(1.96))) - 0.0249979) < 1e-6
    assert abs(one(spark, distributions.chi2_sf(F.lit(67.505), F.lit(50.0))) - 0.05) < 2e-3


def test_conditional_logit_recovers(spark):
    r = random.Random(2)
    rows = []
    for s in range(300):
        xs = [[r.gauss(0, 1), r.gauss(0, 1)] for _ in range(5)]
        w = [math.exp(1.0 * x[0]) for x in xs]
        case = r.choices(range(5), w)[0]
        rows += [(s, i == case, *x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "stratum long, is_case boolean, a double, b double")
    m = models.ConditionalLogit(1e-4, 15).fit(df, ["a", "b"])
    assert 0.7 < m.beta[0] < 1.3 and abs(m.beta[1]) < 0.25
    assert scores.information_gain(m.scores(df)).first().bits_per_event > 0.2


def test_readers_take_what_is_missing(spark):
    empty = catalogues.comcat(spark.createDataFrame([("x",)], "wrong string"))
    assert empty.count() == 0 and empty.columns == ["day", "lat_deg", "lon_deg", "depth_km", "magnitude"]
    lines = [
        "MLI  2017/09/13 21:04:30.0 -12.25   88.75  33.0 5.9 6.1 OPEN OCEAN",
        "B201709132104A   B: 41   77  40 S: 52   90  50 M:  0    0   0 CMT: 1 TRIHD:  2.1",
        "CENTROID:      4.5 0.2 -12.40 0.01   88.60 0.02  18.5  0.4 FREE O-00000000000000",
        "25  1.100 0.010 -0.400 0.010 -0.700 0.010  0.200 0.020 -0.100 0.020  0.900 0.020",
        "V10   1.300 70  10   0.100  5 200  -1.400 19 292   1.350 200 26   95  14 64   88",
    ]
    got = catalogues.ndk(spark.createDataFrame([("f", i, s) for i, s in enumerate(["", *lines, "short tail"])], "source string, line_no long, value string")).collect()
    assert len(got) == 1 and (got[0].lat_deg, got[0].lon_deg, got[0].depth_km) == (-12.4, 88.6, 18.5) and abs(got[0].mw - 6.0202) < 1e-3
    assert [tuple(p) for p in got[0].planes] == [(200, 26, 95), (14, 64, 88)] and abs(got[0].day - (6465 + (21 * 3600 + 4 * 60 + 34.5) / 86400)) < 1e-9


def test_periodogram_by_grid_equals_the_direct_sums(spark):
    import numpy as np

    r = np.random.default_rng(3)
    day = r.uniform(-50, 4000, 3000)
    grp = r.integers(2, size=3000)
    df = spark.createDataFrame([(float(d), "ab"[g]) for d, g in zip(day, grp, strict=True)], "day double, grp string").repartition(5)
    n, order = 2000, 2
    got = {(x.grp, x.k): x for x in circular.periodogram(df, 0.2, 900.0, n, order, ["grp"]).collect()}
    assert len(got) == 2 * n
    period = 0.2 * np.exp(math.log(900 / 0.2) / (n - 1) * np.arange(n))
    for g in range(2):
        z = np.exp(2j * np.pi * order * day[grp == g][:, None] / period).sum(axis=0)
        want = np.abs(z) ** 2 / (grp == g).sum()
        assert max(abs(got["ab"[g], k].power - want[k]) for k in range(n)) < 1e-6
    assert circular.periodogram(df.where("false"), 1.0, 2.0, 5).count() == 0
    assert circular.periodogram(df, 1.0, 2.0, 5).count() == 5


def test_principal_axes(spark):
    import numpy as np

    r = np.random.default_rng(6)
    rows = [tuple(map(float, r.normal(size=6))) for _ in range(50)] + [(1.0, 0.0, 0.0, 1.0, 0.0, 1.0), (0.0,) * 6, (3.0, 0.0, 0.0, 1.0, 0.0, 1.0), (1.0, 0.0, 0.0, 1.0, 0.0, 3.0), (2.0, 0.0, 0.0, 2.0, 0.0, -1.0), (3e-14, 1e-14, 0.0, -1e-14, 2e-14, -2e-14)]
    a = tuple(F.col(c) for c in physics.COMPONENTS)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in physics.COMPONENTS))
    got = df.select(*a, F.array(*physics.eigenvalues(a)).alias("e")).withColumn("axis", physics.axis_of(a, F.col("e")[0])).collect()
    for g in got:
        m = np.array([[g.xx, g.xy, g.xz], [g.xy, g.yy, g.yz], [g.xz, g.yz, g.zz]])
        size = max(np.abs(m).max(), 1e-300)
        values, vectors = np.linalg.eigh(m)
        assert np.allclose(np.array(g.e) / size, values[::-1] / size, atol=1e-7)
        if values[2] - values[1] > 1e-3 * size:
            assert abs(abs(np.dot(g.axis, vectors[:, 2])) - 1) < 1e-6 and g.axis[2] >= 0
        elif values[2] - values[1] < 1e-9 * size:
            assert g.axis is None


def test_sky_of_known_dates():
    """Longitudes on 2024-04-08 (a solar eclipse, 18:20 UTC) and at the equinox of 2024."""
    import numpy as np

    from tremorlake.operators import charts

    lon, lat = charts.places(np.array([8864 + 18.35 / 24, 8845 + 3.1 / 24]))
    gap = np.degrees(np.angle(np.exp(1j * (lon[0] - lon[1]))))
    assert abs(gap[0]) < 0.4 and abs(np.degrees(lat[1, 0])) < 0.6
    assert abs(np.degrees(np.angle(np.exp(1j * lon[0, 1])))) < 0.05
    jupiter = np.degrees(lon[5, 0]) % 360
    assert 46 < jupiter < 51


def test_settled_runs_take_mains_of_other_cells_in_their_order(spark):
    """Runs are packed once, in order of precedence; a main from outside claims what comes after it, and only that."""
    day = lambda i, at, p0: (i, p0, at, at, 0.0, 0.0, 10.0, 50.0, 0, 0, 0)
    events = spark.createDataFrame([day(1, 0.0, -5.0), day(2, 30.0, -6.0), day(3, 62.0, -4.0), day(4, 65.0, float("nan"))], decluster.EVENT)
    others = spark.createDataFrame([day(7, 5.0, -5.5), day(8, 25.0, -5.9), day(9, 60.0, -3.0)], decluster.EVENT)
    runs = decluster._packed(events).withColumn("outside", F.lit(False))
    assert [len(r.events) for r in runs.collect()] == [4 * 64]
    assert {r.event_idx for r in decluster._local(runs, False).collect()} == {1, 2, 3}
    theirs = decluster._packed(others).withColumn("outside", F.lit(True))
    assert {r.event_idx for r in decluster._local(runs.unionByName(theirs), False).collect()} == {2, 3}
