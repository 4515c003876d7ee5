"""Tidal response: phases, circular statistics, block-shift nulls, periodograms, fields and fault stress."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import labels
from tremorlake.functions.random import M, mix_sql
from tremorlake.operators import circular, joins, physics, shifts, tides
from tremorlake.operators.tables import equal_count_bins, materialize, numbered
from tremorlake.plans.catalogue import binomial_tail, select_events
from tremorlake.plans.fixtures import CMT_SQL, QUAKE_SQL, TREMOR_SQL, cmt, load, quake, tremor
from tremorlake.plans.registry import query

BANDS = ["M2", "S2", "N2", "K1", "O1", "Q1", "Mf", "Mm", "Ssa"]
TRIALS = 400
_BANDS = f"bands(band, species, start, rate, period) AS (VALUES {tides.values_sql(BANDS)})"


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded, without a negative zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


@query("c1_constituents")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constituents, and the whole cycles of each between the epoch and the first and last event."""
    span = quake(spark, sf_dir).agg(F.min("day").alias("low"), F.max("day").alias("high"))
    cycles = lambda c: F.floor(F.col(c) / F.col("period")).cast("long")
    return span.crossJoin(F.broadcast(tides.table(spark, BANDS))).select("band", "species", F.round("period", 6).alias("period"), cycles("low").alias("first_cycle"), cycles("high").alias("last_cycle"))


_PHASED = f"{QUAKE_SQL}, {_BANDS}, ph AS (SELECT *, radians(start + rate * day + species * lon_deg) AS phase FROM quake, bands)"


@query("a8_schuster", f"WITH {_PHASED} SELECT band, count(*) AS n, round((pow(sum(cos(phase)), 2) + pow(sum(sin(phase)), 2)) / count(*), 5) AS power FROM ph GROUP BY band")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(circular.schuster(circular.band_phases(quake(spark, sf_dir), tides.table(spark, BANDS), "lon_deg"), ["band"]).select("band", "n", "power"), 5, "power")


@query("a8_schuster_orders", f"WITH {_PHASED} SELECT k::INTEGER AS k, band, round((pow(sum(cos(k * phase)), 2) + pow(sum(sin(k * phase)), 2)) / count(*), 5) AS power FROM ph, range(1, 5) r(k) WHERE band = 'M2' GROUP BY ALL")
def a8o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 1 to 4 of one constituent, from phases that are made once."""
    x = circular.band_phases(quake(spark, sf_dir), tides.table(spark, ["M2"]), "lon_deg").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).withColumn("phase", F.col("k") * F.col("phase"))
    return _r(circular.schuster(x, ["k", "band"]).select("k", "band", "power"), 5, "power")


@query("a9_modulation", f"WITH {_PHASED}, p AS (SELECT band, count(*) AS n, (pow(sum(cos(phase)), 2) + pow(sum(sin(phase)), 2)) / count(*) AS power FROM ph GROUP BY band) SELECT band, round(2 * sqrt(power / n), 6) AS eps FROM p")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = circular.schuster(circular.band_phases(quake(spark, sf_dir), tides.table(spark, BANDS), "lon_deg"), ["band"])
    return s.select("band", F.round(circular.modulation(F.col("power"), F.col("n")), 6).alias("eps"))


_FORCING = "series AS (SELECT k, k * 0.05::DOUBLE - 300 AS day, cos(k * 0.05::DOUBLE * 12.1::DOUBLE) + 0.3 * sin(k * 0.05::DOUBLE * 5.8::DOUBLE) AS value FROM range(0, 20000) r(k))"


def forcing(spark: SparkSession) -> DataFrame:
    """A synthetic forcing (k, day, value) of two periods near half a day and a day."""
    t = F.col("k") * F.lit(0.05)
    return spark.range(20000).select(F.col("id").alias("k")).select("k", (t - 300).alias("day"), (F.cos(t * 12.1) + 0.3 * F.sin(t * 5.8)).alias("value"))


@query("a10_harmonic_amplitude", f"WITH {QUAKE_SQL}, {_BANDS}, f AS (SELECT band, sum(magnitude * cos(radians(start + rate * day))) AS a, sum(magnitude * sin(radians(start + rate * day))) AS b, count(*) AS n FROM quake, bands GROUP BY band) SELECT band, round(2 * sqrt(a * a + b * b) / n, 6) AS amplitude FROM f")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude of the events' magnitudes at each constituent."""
    samples = quake(spark, sf_dir).select("day", F.col("magnitude").alias("value"))
    return circular.harmonic_fit(samples, tides.table(spark, BANDS)).select("band", F.round("amplitude", 6).alias("amplitude"))


@query("a11_phase_lag", f"""WITH {_PHASED}, {_FORCING}, o AS (SELECT band, degrees(atan2(sum(sin(phase)), sum(cos(phase)))) AS obs FROM ph GROUP BY band),
f AS (SELECT band, any_value(period) AS period, degrees(atan2(sum(value * sin(radians(start + rate * day))), sum(value * cos(radians(start + rate * day))))) AS ref FROM series, bands GROUP BY band),
l AS (SELECT band, period, fmod(obs - ref, 360) AS lag, fmod(obs + ref, 360) AS other FROM o JOIN f USING (band)),
w AS (SELECT band, period, CASE WHEN lag > 180 THEN lag - 360 WHEN lag < -180 THEN lag + 360 ELSE lag END AS lag, CASE WHEN other > 180 THEN other - 360 WHEN other < -180 THEN other + 360 ELSE other END AS other FROM l)
SELECT band, round(lag, 3) AS lag, round(lag / 360 * period * 1440, 2) AS minutes, round(other, 3) AS lag_reference FROM w""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = tides.table(spark, BANDS)
    seen = circular.schuster(circular.band_phases(quake(spark, sf_dir), bands, "lon_deg"), ["band"])
    lag = circular.phase_lag(seen, circular.harmonic_fit(forcing(spark), bands))
    return lag.select("band", F.round("lag", 3).alias("lag"), F.round("minutes", 2).alias("minutes"), F.round("lag_reference", 3).alias("lag_reference"))


@query("phase_lag_consistency")
def phase_lag_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = tides.table(spark, ["M2", "N2", "O1", "Q1", "K1"])
    seen = circular.schuster(circular.band_phases(quake(spark, sf_dir), bands, "lon_deg"), ["band"])
    return _r(circular.band_spread(circular.phase_lag(seen, circular.harmonic_fit(forcing(spark), bands))), 3, "semi_mean", "semi_sd", "diurnal_mean", "diurnal_sd", "difference")


@query("a33_band_spread", f"WITH {CMT_SQL}, l AS (SELECT (40 + event_idx % 80)::DOUBLE / 100 AS period, strike1 AS lag FROM cmt) SELECT round(avg(lag) FILTER (period < 0.75), 6) AS semi_mean, round(stddev_pop(lag) FILTER (period < 0.75), 6) AS semi_sd, round(avg(lag) FILTER (period >= 0.75), 6) AS diurnal_mean, round(stddev_pop(lag) FILTER (period >= 0.75), 6) AS diurnal_sd, round(avg(lag) FILTER (period >= 0.75) - avg(lag) FILTER (period < 0.75), 6) AS difference FROM l")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strikes in the place of lags, at periods by event."""
    rows = cmt(spark, sf_dir).select(((40 + F.col("event_idx") % 80).cast("double") / 100).alias("period"), F.col("planes")[0]["strike"].alias("lag"))
    return _r(circular.band_spread(rows), 6, "semi_mean", "semi_sd", "diurnal_mean", "diurnal_sd", "difference")


@query("a12_positive_fraction", f"WITH {TREMOR_SQL} SELECT round(avg(CASE WHEN magnitude - 5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction, round(avg(magnitude - 5), 6) AS mean FROM tremor WHERE magnitude IS NOT NULL")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tremor(spark, sf_dir).where("magnitude is not null").select((F.col("magnitude") - 5).alias("x"))
    return x.agg(F.round(F.avg(F.when(F.col("x") > 0, 1.0).otherwise(0.0)), 6).alias("fraction"), F.round(F.avg("x"), 6).alias("mean"))


def _null_sql(source: str, longitude: str, by: str = "") -> str:
    """CTEs up to `nulled`: block sums, trials, and the summary of each band (and group)."""
    b, g = (f"{by}, ", f", {by}") if by else ("", "")
    t0 = f"(SELECT {b}min(day) AS t0 FROM {source} {'GROUP BY ' + by if by else ''})"
    return f"""{_BANDS}, timed AS (SELECT s.*, t0 FROM {source} s JOIN {t0} t {'USING (' + by + ')' if by else 'ON TRUE'}),
sums AS (SELECT {b}band, period, rate, floor((day - t0) / greatest(4 * period, 30.0))::BIGINT AS block, count(*) AS n, sum(cos(radians(start + rate * day + species * {longitude}))) AS c, sum(sin(radians(start + rate * day + species * {longitude}))) AS s FROM timed, bands GROUP BY ALL),
observed AS (SELECT {b}band, sum(n) AS n, (pow(sum(c), 2) + pow(sum(s), 2)) / sum(n) AS observed, count(DISTINCT block) AS blocks FROM sums GROUP BY ALL),
keyed AS (SELECT *, ({mix_sql('trial', 11)} + block % {M}) % {M} AS key FROM sums, range(1, {TRIALS + 1}) r(trial)),
turned AS (SELECT *, radians(rate * period * ({mix_sql('key', 12)} / {float(M)}::DOUBLE)) AS turn FROM keyed),
trials AS (SELECT {b}band, trial, (pow(sum(c * cos(turn) - s * sin(turn)), 2) + pow(sum(s * cos(turn) + c * sin(turn)), 2)) / sum(n) AS v FROM turned GROUP BY ALL),
nulled AS (SELECT {b}band, any_value(n) AS n, any_value(observed) AS observed, any_value(blocks) AS blocks, list_sort(list(v))[{TRIALS // 2 + 1}] AS null_median, max(v) AS null_max, (count(*) FILTER (v >= observed * (1 - 1e-9)) + 1)::DOUBLE / {TRIALS + 1} AS p FROM trials JOIN observed USING (band{g}) GROUP BY ALL)"""


_NULL_OUT = "n, round(observed, 4) AS observed, blocks, round(null_median, 4) AS null_median, round(null_max, 4) AS null_max, round(p, 6) AS p"


def _null(events: DataFrame, bands: list[str], by: list[str], longitude: str | None = None) -> DataFrame:
    sums = materialize(circular.block_sums(events, tides.table(events.sparkSession, bands), by, longitude), "sums")
    return circular.block_shift_null(sums, by, TRIALS)


def _null_out(df: DataFrame, *by: str) -> DataFrame:
    return _r(_r(df, 4, "observed", "null_median", "null_max"), 6, "p").select(*by, "band", "n", "observed", "blocks", "null_median", "null_max", "p")


@query("n1_block_shift", f"WITH {QUAKE_SQL}, {_null_sql('quake', 'lon_deg')} SELECT band, {_NULL_OUT} FROM nulled")
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null_out(_null(quake(spark, sf_dir), BANDS, [], "lon_deg"))


@query("two_site_comparison", f"WITH {TREMOR_SQL}, two AS (SELECT *, CASE WHEN lat_deg < 45 THEN 'south' ELSE 'north' END AS site FROM tremor), {_null_sql('two', '0', 'site')} SELECT site, band, {_NULL_OUT} FROM nulled")
def two_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = tremor(spark, sf_dir).withColumn("site", F.when(F.col("lat_deg") < 45, "south").otherwise("north"))
    return _null_out(_null(sites, BANDS, ["site"]), "site")


@query("a34_site_agreement", f"WITH {TREMOR_SQL}, two AS (SELECT *, CASE WHEN lat_deg < 45 THEN 'south' ELSE 'north' END AS site FROM tremor), {_null_sql('two', '0', 'site')}, s AS (SELECT band, count(*) FILTER (p < 0.05) AS k FROM nulled GROUP BY band) SELECT count(*) FILTER (k = 2) AS both_sites, count(*) FILTER (k = 1) AS one_site, count(*) FILTER (k = 0) AS neither FROM s")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = two_site(spark, sf_dir).groupBy("band").agg(F.sum((F.col("p") < 0.05).cast("int")).alias("k"))
    return s.agg(*[F.sum((F.col("k") == k).cast("long")).alias(n) for k, n in ((2, "both_sites"), (1, "one_site"), (0, "neither"))])


@query("depth_stratified_test", f"WITH {QUAKE_SQL}, two AS (SELECT *, CASE WHEN depth_km <= 70 THEN 'shallow' ELSE 'deep' END AS depthclass FROM quake WHERE magnitude >= 5), {_null_sql('two', 'lon_deg', 'depthclass')} SELECT depthclass, band, {_NULL_OUT} FROM nulled")
def depth_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = select_events(quake(spark, sf_dir), 5.0).withColumn("depthclass", labels.depth_class(F.col("depth_km"), inclusive=True))
    return _null_out(_null(x, BANDS, ["depthclass"], "lon_deg"), "depthclass")


@query("depth_sign_test")
def depth_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many bands shallow events are modulated more strongly, and the binomial tail of that."""
    x = depth_stratified(spark, sf_dir).withColumn("eps", circular.modulation(F.col("observed"), F.col("n")))
    pair = x.groupBy("band").agg(F.max(F.when(F.col("depthclass") == "shallow", F.col("eps"))).alias("a"), F.max(F.when(F.col("depthclass") == "deep", F.col("eps"))).alias("b"))
    return pair.agg(F.sum((F.col("a") > F.col("b")).cast("int")).alias("stronger")).withColumn("tail", F.round(binomial_tail(F.col("stronger"), len(BANDS)), 6))


@query("detection_bias_test", f"""WITH {TREMOR_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY magnitude, event_idx) AS rn, count(*) OVER () AS total FROM tremor WHERE magnitude IS NOT NULL),
binned AS (SELECT *, least((rn - 1) // (total // 5), 4)::INTEGER AS bin FROM ranked), {_null_sql('binned', '0', 'bin')} SELECT bin, band, {_NULL_OUT} FROM nulled""")
def detection_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = equal_count_bins(tremor(spark, sf_dir).where("magnitude is not null"), F.col("magnitude"), 5, F.col("event_idx"))
    return _null_out(_null(x, BANDS, ["bin"]), "bin")


@query("band_prediction_test")
def band_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of modulation of ordinary events against tremor's, by band, with the verdict over short and long periods."""
    eq, tr = _null(select_events(quake(spark, sf_dir), 5.5), BANDS, [], "lon_deg"), _null(tremor(spark, sf_dir), BANDS, [])
    period = tides.table(spark, BANDS).select("band", "period")
    x = eq.select("band", F.col("p").alias("eq_p"), F.col("eps_limit").alias("eq_limit")).join(tr.select("band", F.col("p").alias("tremor_p"), F.col("eps").alias("tremor_eps")), "band").join(F.broadcast(period), "band")
    counts = x.agg(F.sum(((F.col("eq_p") < 0.05) & (F.col("period") < 2)).cast("int")).alias("short"), F.sum(((F.col("eq_p") < 0.05) & (F.col("period") >= 2)).cast("int")).alias("long"))
    verdict = F.when((F.col("short") == 0) & (F.col("long") == 0), "inconclusive").when(F.col("short") == 0, "consistent").when(F.col("long") == 0, "refuted").otherwise("needs interpretation")
    return _r(x, 6, "eq_p", "eq_limit", "tremor_p", "tremor_eps", "period").crossJoin(F.broadcast(counts.select(verdict.alias("verdict"))))


@query("parkfield_constituents", f"""WITH {TREMOR_SQL}, b(band, species, start, rate, period) AS (VALUES {tides.values_sql(['S1', 'M2', 'S2', 'O1', 'K1'])}),
p AS (SELECT band, (pow(sum(cos(radians(start + rate * day))), 2) + pow(sum(sin(radians(start + rate * day))), 2)) / count(*) AS power FROM tremor, b GROUP BY band)
SELECT band, round(power / (SELECT power FROM p WHERE band = 'S1'), 4) AS to_s1, (SELECT power FROM p WHERE band = 'M2') > (SELECT power FROM p WHERE band = 'S2') AS gate FROM p""")
def parkfield_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power against the solar floor S1, and the gate that M2 exceeds S2, a purely solar line."""
    s = circular.schuster(circular.band_phases(tremor(spark, sf_dir), tides.table(spark, ["S1", "M2", "S2", "O1", "K1"])), ["band"])
    at = lambda b: F.max(F.when(F.col("band") == b, F.col("power")))
    floor = s.agg(at("S1").alias("s1"), (at("M2") > at("S2")).alias("gate"))
    return s.crossJoin(F.broadcast(floor)).select("band", F.round(F.col("power") / F.col("s1"), 4).alias("to_s1"), "gate")


@query("parkfield_constituent_response")
def constituent_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modulation per unit of forcing by band, with Benjamini-Hochberg survivors and the few-block flag."""
    null = _null(tremor(spark, sf_dir), BANDS, [])
    amp = circular.harmonic_fit(forcing(spark), tides.table(spark, BANDS)).select("band", "amplitude")
    x = null.join(F.broadcast(amp), "band").withColumn("response", F.col("eps") / F.col("amplitude")).withColumn("ratio", F.col("observed") / F.col("null_median"))
    out = circular.benjamini_hochberg(x, "p", 0.05, "band").select("band", "n", "blocks", "few_blocks", "p", "eps", "response", "ratio", "rank", "survives")
    return _r(_r(_r(out, 6, "p", "eps"), 5, "response"), 4, "ratio")


@query("a15_benjamini_hochberg", f"WITH {QUAKE_SQL}, {_null_sql('quake', 'lon_deg')}, r AS (SELECT band, p, row_number() OVER (ORDER BY p, band) AS rank, count(*) OVER () AS m FROM nulled) SELECT band, rank::INTEGER AS rank, rank <= coalesce((SELECT max(rank) FROM r WHERE p <= 0.5 * rank / m), 0) AS survives FROM r")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circular.benjamini_hochberg(_null(quake(spark, sf_dir), BANDS, [], "lon_deg"), "p", 0.5, "band").select("band", "rank", "survives")


@query("holm", f"WITH {QUAKE_SQL}, {_null_sql('quake', 'lon_deg')}, r AS (SELECT band, p, row_number() OVER (ORDER BY p, band) AS k, count(*) OVER () AS m FROM nulled) SELECT band, round(max(least(1.0, p * (m - k + 1))) OVER (ORDER BY k), 6) AS p_holm FROM r")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circular.holm(_null(quake(spark, sf_dir), BANDS, [], "lon_deg"), "p", "band").select("band", F.round("p_holm", 6).alias("p_holm"))


_P = "p AS (SELECT k, {u} / {m}::DOUBLE AS p FROM range(1, 501) r(k))".format(u=mix_sql("k", 3), m=float(M))


@query("a17_ks_uniform", f"WITH {TREMOR_SQL}, p AS (SELECT day - floor(day) AS p FROM tremor), r AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p) SELECT count(*) AS n, round(max(greatest(abs(i / m::DOUBLE - p), abs(p - (i - 1) / m::DOUBLE))), 6) AS ks, round(1.36 / sqrt(any_value(m)), 6) AS critical, round(avg((p < 0.01)::INTEGER), 6) AS below_01, round(avg((p < 0.05)::INTEGER), 6) AS below_05, round(avg((p < 0.1)::INTEGER), 6) AS below_10 FROM r")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the events spread evenly over the day?"""
    p = tremor(spark, sf_dir).select((F.col("day") - F.floor("day")).alias("p"))
    return _r(circular.ks_uniform(numbered(p, F.asc("p"))), 6, "ks", "critical", "below_01", "below_05", "below_10")


@query("null_calibration")
def null_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and power of the block-shift null on 60 synthetic catalogues: Poisson, clustered, and with an injected M2 effect."""
    c = materialize(synthetic(spark, 60, 600, 2000.0), "synthetic")
    p = _null(c, ["M2"], ["kind", "trial_id"])
    return p.groupBy("kind").agg(F.count("*").alias("catalogues"), *[F.avg((F.col("p") < a).cast("double")).alias(f"below_{int(a * 100):02d}") for a in (0.01, 0.05, 0.10)])


def synthetic(spark: SparkSession, catalogues: int, events: int, span: float, effect: float = 0.4) -> DataFrame:
    """(kind, trial_id, day): uniform times, parents with Omori offspring, and times thinned by the M2 phase. Counter hashes draw."""
    from tremorlake.functions.random import mix2, uniform

    base = spark.range(catalogues * events).select((F.col("id") / events).cast("long").alias("trial_id"), F.col("id").alias("i"))
    u = lambda s: uniform(mix2(F.col("i"), F.col("trial_id"), s))
    poisson = base.select(F.lit("poisson").alias("kind"), "trial_id", (u(21) * span).alias("day"))
    parent = base.where(F.col("i") % 5 == 0).withColumn("t", u(31) * span)
    child = parent.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    wait = F.when(F.col("j") == 0, 0.0).otherwise(0.01 * (F.pow(1 - uniform(mix2(F.col("i"), F.col("j"), 41)) * 0.999, -1.0) - 1))
    hawkes = child.select(F.lit("hawkes").alias("kind"), "trial_id", (F.col("t") + wait).alias("day"))
    m2 = tides.constituent("M2")
    keep = 1 + effect * F.cos(F.radians(m2.start + m2.rate * F.col("day")))
    injected = base.withColumn("day", u(51) * span).where(uniform(mix2(F.col("i"), F.col("trial_id"), 61)) * (1 + effect) < keep).select(F.lit("injected").alias("kind"), "trial_id", "day")
    return poisson.unionByName(hawkes).unionByName(injected)


@query("periodogram", f"WITH {QUAKE_SQL} SELECT k::INTEGER AS k, round(5 * exp({math.log(600 / 5) / 199!r}::DOUBLE * k), 6) AS period, round((pow(sum(cos({2 * math.pi!r}::DOUBLE * day / (5 * exp({math.log(600 / 5) / 199!r}::DOUBLE * k)))), 2) + pow(sum(sin({2 * math.pi!r}::DOUBLE * day / (5 * exp({math.log(600 / 5) / 199!r}::DOUBLE * k)))), 2)) / count(*), 4) AS power FROM quake, range(0, 200) r(k) GROUP BY k")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_r(circular.periodogram(quake(spark, sf_dir), 5, 600, 200), 6, "period"), 4, "power")


@query("moonquake_periodogram")
def moonquake_periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of 20,000 log-spaced periods, the found period within 1 % of each known one, and whether that is too long for the span."""
    e = tremor(spark, sf_dir)
    x = materialize(circular.periodogram(e, 0.2, 30, 20000), "spectrum")
    known = spark.createDataFrame([("day", 1.0), ("half day", 0.5), ("lunar day", 1.03505), ("week", 7.0), ("synodic", 29.531)], "name string, known_period double")
    half = e.agg(((F.max("day") - F.min("day")) / 2).alias("half"))
    out = circular.nearest_known(circular.peaks(x, 1.0), known, 0.01).crossJoin(F.broadcast(half))
    return _r(_r(out.withColumn("too_long", F.col("known_period") > F.col("half")).drop("half"), 6, "period"), 3, "power")


@query("moonquake_validation")
def moonquake_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest peak to each known period and beat, within 10 % on a log scale."""
    x = materialize(circular.periodogram(tremor(spark, sf_dir), 0.2, 30, 1000), "spectrum")
    single = {"anomalistic": 27.555, "synodic": 29.531, "draconic": 27.212, "half day": 0.5}
    beats = [(f"{a} and {b}", 1 / abs(1 / single[a] - 1 / single[b])) for a, b in (("anomalistic", "synodic"), ("anomalistic", "draconic"), ("synodic", "half day"))]
    known = spark.createDataFrame([*single.items(), *beats], "name string, known_period double")
    return _r(_r(circular.nearest_known(circular.peaks(x, 0.5), known, 0.1, log=True), 6, "period"), 3, "power")


@query("j6_station_timing", f"""WITH {QUAKE_SQL}, marks AS (SELECT body, k * (20.0::DOUBLE + 13 * body) - 2000 AS mark FROM range(0, 3) b(body), range(0, 200) r(k)),
e AS (SELECT event_idx, day, body FROM quake, range(0, 3) b(body)),
p AS (SELECT e.*, m.mark AS prev FROM e ASOF LEFT JOIN marks m ON e.body = m.body AND e.day >= m.mark),
n AS (SELECT p.*, m.mark AS next FROM p ASOF LEFT JOIN marks m ON p.body = m.body AND p.day < m.mark)
SELECT event_idx, body::INTEGER AS body, round(day - coalesce(prev, -2191), 8) AS since, round(coalesce(next, 731) - day, 8) AS until, round(least(day - coalesce(prev, -2191), coalesce(next, 731) - day), 8) AS nearest FROM n""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since and until marks of three bodies."""
    marks = spark.range(600).select((F.col("id") % 3).cast("int").alias("body"), F.floor(F.col("id") / 3).alias("k")).select("body", (F.col("k") * (20.0 + 13 * F.col("body")) - 2000).alias("day"))
    e = quake(spark, sf_dir).select("event_idx", "day", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("body"))
    x = joins.mark_timing(joins.as_of_both(e, marks, ["body"]), (-2191.0, 731.0))
    return _r(x, 8, "since", "until", "nearest").select("event_idx", "body", "since", "until", "nearest")


@query("j8_interpolation", f"WITH {QUAKE_SQL}, {_FORCING}, e AS (SELECT event_idx, day, least(greatest(floor((day + 300) / 0.05::DOUBLE), 0), 19998)::BIGINT AS k FROM quake WHERE day BETWEEN -299 AND 690) SELECT event_idx, round(a.value * (1 - ((e.day + 300) / 0.05::DOUBLE - e.k)) + b.value * ((e.day + 300) / 0.05::DOUBLE - e.k), 6) + 0.0 AS value FROM e JOIN series a ON a.k = e.k JOIN series b ON b.k = e.k + 1")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = quake(spark, sf_dir).where(F.col("day").between(-299, 690)).select("event_idx", "day")
    x = joins.interpolated(e, forcing(spark).select("k", "value"), -300.0, 0.05, 20000, F.col("day"), ["value"])
    return x.select("event_idx", (F.round("value", 6) + 0.0).alias("value"))


@query("j9_nearest_sample", f"WITH {QUAKE_SQL} SELECT event_idx, least(greatest(round((day + 300) / 0.05::DOUBLE), 0), 19999)::BIGINT AS k FROM quake")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_sample(quake(spark, sf_dir), forcing(spark).select("k"), -300.0, 0.05, 20000, F.col("day")).select("event_idx", "k")


@query("j10_block_offsets", f"WITH {QUAKE_SQL}, x AS (SELECT event_idx, trial, floor((day + 2191) / 30)::BIGINT AS block FROM quake, range(1, 4) r(trial)), y AS (SELECT *, ({mix_sql('trial', 4)} + block % {M}) % {M} AS key FROM x) SELECT event_idx, trial::INTEGER AS trial, round({mix_sql('key', 5)} / {float(M)}::DOUBLE * 1.03505, 6) AS shift FROM y")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.block_offsets(quake(spark, sf_dir), 30, 1.03505, 3, -2191.0).select("event_idx", "trial", F.round("offset", 6).alias("shift"))


@query("j13_planes", f"WITH {CMT_SQL} SELECT event_idx, 0 AS which, strike1 AS strike, dip1 AS dip, rake1 AS rake FROM cmt UNION ALL SELECT event_idx, 1, strike2, dip2, rake2 FROM cmt")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmt(spark, sf_dir).select("event_idx", F.posexplode("planes").alias("which", "p")).select("event_idx", "which", "p.strike", "p.dip", "p.rake")


@query("j14_nearest_period", f"WITH {QUAKE_SQL}, f AS (SELECT 0.4::DOUBLE + event_idx::DOUBLE / 10000 AS period, magnitude AS power FROM quake), k(name, known_period) AS (VALUES ('half', 0.51753::DOUBLE), ('one', 1.002738::DOUBLE), ('two', 1.934713::DOUBLE), ('far', 99.0::DOUBLE)) SELECT name, known_period, round(period, 6) AS period, round(power, 6) AS power FROM (SELECT k.*, f.*, row_number() OVER (PARTITION BY name ORDER BY abs(period / known_period - 1)) AS r FROM k LEFT JOIN f ON abs(period / known_period - 1) <= 0.01) WHERE r = 1")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event nearest to each known period, on a scale of periods by event."""
    found = quake(spark, sf_dir).select((0.4 + F.col("event_idx").cast("double") / 10000).alias("period"), F.col("magnitude").alias("power"))
    known = spark.createDataFrame([("half", 0.51753), ("one", 1.002738), ("two", 1.934713), ("far", 99.0)], "name string, known_period double")
    return _r(circular.nearest_known(found, known, 0.01), 6, "period", "power")


# Physics. The SQL twins take a tensor of exact numbers; the ephemeris itself is checked by the tests.
_TENSOR = "t AS (SELECT *, (event_idx % 7 - 3)::DOUBLE AS xx, (event_idx % 5 - 2)::DOUBLE AS xy, (event_idx % 3 - 1)::DOUBLE AS xz, (event_idx % 11 - 5)::DOUBLE AS yy, (event_idx % 4 - 1)::DOUBLE AS yz, -((event_idx % 7 - 3) + (event_idx % 11 - 5))::DOUBLE AS zz, radians(lat_deg) AS p, radians(lon_deg) AS q FROM cmt)"
_ROT = "r AS (SELECT *, -sin(p) * cos(q) AS n1, -sin(p) * sin(q) AS n2, cos(p) AS n3, -sin(q) AS e1, cos(q) AS e2, 0.0::DOUBLE AS e3, -cos(p) * cos(q) AS d1, -cos(p) * sin(q) AS d2, -sin(p) AS d3 FROM t)"


def _quad(a: str, b: str) -> str:
    m = {(1, 1): "xx", (1, 2): "xy", (1, 3): "xz", (2, 2): "yy", (2, 3): "yz", (3, 3): "zz"}
    return " + ".join(f"{a}{i} * {m[min(i, j), max(i, j)]} * {b}{j}" for i in (1, 2, 3) for j in (1, 2, 3))


_LOCAL = f"local AS (SELECT *, {', '.join(f'{_quad(a, b)} AS {a}{b}' for a, b in ('nn', 'ne', 'nd', 'ee', 'ed', 'dd'))} FROM r)"
_VECTORS = "v AS (SELECT *, radians(strike1) AS f, radians(dip1) AS di, radians(rake1) AS ra FROM local), w AS (SELECT *, -sin(di) * sin(f) AS a1, sin(di) * cos(f) AS a2, -cos(di) AS a3, cos(ra) * cos(f) + sin(ra) * cos(di) * sin(f) AS s1, cos(ra) * sin(f) - sin(ra) * cos(di) * cos(f) AS s2, -sin(ra) * sin(di) AS s3 FROM v)"
_TA = ("nn * a1 + ne * a2 + nd * a3", "ne * a1 + ee * a2 + ed * a3", "nd * a1 + ed * a2 + dd * a3")


def _tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_idx")
    xx, yy = (k % 7 - 3).cast("double"), (k % 11 - 5).cast("double")
    t = cmt(spark, sf_dir).withColumns({"xx": xx, "xy": (k % 5 - 2).cast("double"), "xz": (k % 3 - 1).cast("double"), "yy": yy, "yz": (k % 4 - 1).cast("double"), "zz": -(xx + yy)})
    return physics.to_local(t, "lat_deg", "lon_deg")


@query("p1_local_tensor", f"WITH {CMT_SQL}, {_TENSOR}, {_ROT}, {_LOCAL} SELECT event_idx, round(nn, 5) + 0.0 AS nn, round(ne, 5) + 0.0 AS ne, round(dd, 5) + 0.0 AS dd, round(nn + ee + dd, 5) + 0.0 AS trace FROM local")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _tensor(spark, sf_dir).withColumn("trace", F.col("nn") + F.col("ee") + F.col("dd"))
    return _r(x, 5, "nn", "ne", "dd", "trace").select("event_idx", "nn", "ne", "dd", "trace")


@query("p2_coulomb", f"WITH {CMT_SQL}, {_TENSOR}, {_ROT}, {_LOCAL}, {_VECTORS} SELECT event_idx, round(s1 * ({_TA[0]}) + s2 * ({_TA[1]}) + s3 * ({_TA[2]}) + 0.4 * (a1 * ({_TA[0]}) + a2 * ({_TA[1]}) + a3 * ({_TA[2]})), 4) + 0.0 AS cfs FROM w")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("planes")[0]
    return _tensor(spark, sf_dir).select("event_idx", (F.round(physics.coulomb(p["strike"], p["dip"], p["rake"], 0.4), 4) + 0.0).alias("cfs"))


_EIGEN = """q AS (SELECT *, (xx + yy + zz) / 3 AS third FROM t), s AS (SELECT *, sqrt((pow(xx - third, 2) + pow(yy - third, 2) + pow(zz - third, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM q),
u AS (SELECT *, CASE WHEN s > 0 THEN acos(least(greatest(((xx - third) * ((yy - third) * (zz - third) - yz * yz) - xy * (xy * (zz - third) - yz * xz) + xz * (xy * yz - (yy - third) * xz)) / (2 * s * s * s), -1.0::DOUBLE), 1.0::DOUBLE)) / 3 ELSE 0 END AS turn FROM s),
v AS (SELECT *, third + 2 * s * cos(turn) AS l1, third + 2 * s * cos(turn + 2 * pi() / 3) AS l3 FROM u)"""


@query("p3_principal_axes", f"WITH {CMT_SQL}, {_TENSOR}, {_EIGEN} SELECT event_idx, round(l1, 5) + 0.0 AS top, round(3 * third - l1 - l3, 5) + 0.0 AS middle, round(l3, 5) + 0.0 AS low, 0.0::DOUBLE AS off, round(xx * yy * zz + 2 * xy * yz * xz - xx * yz * yz - yy * xz * xz - zz * xy * xy, 3) + 0.0 AS determinant FROM v")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of each event's tensor; by how much its principal axis misses being an eigenvector; the product of the eigenvalues,
    which the SQL takes from the tensor itself."""
    a = tuple(F.col(c) for c in physics.COMPONENTS)
    top, middle, low = physics.eigenvalues(a)
    x = _tensor(spark, sf_dir).select("event_idx", *physics.COMPONENTS, top.alias("top"), middle.alias("middle"), low.alias("low"))
    x = x.withColumn("axis", physics.axis_of(a, F.col("top")))
    v = [F.get("axis", F.lit(i)) for i in range(3)]
    xx, xy, xz, yy, yz, zz = a
    miss = [xx * v[0] + xy * v[1] + xz * v[2] - F.col("top") * v[0], xy * v[0] + yy * v[1] + yz * v[2] - F.col("top") * v[1], xz * v[0] + yz * v[1] + zz * v[2] - F.col("top") * v[2]]
    off = F.coalesce(F.greatest(*map(F.abs, miss)), F.lit(0.0))
    return x.select("event_idx", *[(F.round(c, 5) + 0.0).alias(c) for c in ("top", "middle", "low")], (F.round(off, 5) + 0.0).alias("off"), (F.round(F.col("top") * F.col("middle") * F.col("low"), 3) + 0.0).alias("determinant"))


@query("j12_plane_grid", f"WITH {TREMOR_SQL}, n AS (SELECT family, count(*) AS n FROM tremor GROUP BY family) SELECT family, n, (i * 6 + j) * 12 + k AS plane, (i * 15)::DOUBLE AS strike, ((j + 1) * 15)::DOUBLE AS dip, (k * 30 - 180)::DOUBLE AS rake FROM n, range(0, 24) a(i), range(0, 6) b(j), range(0, 12) c(k)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family with every plane to be tried."""
    families = tremor(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"))
    planes = physics.plane_grid(spark).select("plane", *[F.col(c).cast("double").alias(c) for c in ("strike", "dip", "rake")])
    return families.crossJoin(F.broadcast(planes))  # the planes are a parameter


@query("a22_covariance", f"WITH {CMT_SQL}, {_TENSOR}, {_ROT}, {_LOCAL} SELECT round(covar_pop(nn, nn), 4) AS nn_nn, round(covar_pop(nn, ee), 4) AS nn_ee, round(covar_pop(ed, dd), 4) AS ed_dd, count(*) AS n FROM local")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(physics.covariance(_tensor(spark, sf_dir), []), 4, "nn_nn", "nn_ee", "ed_dd").select("nn_nn", "nn_ee", "ed_dd", "n")


@query("moonquake_nest_coulomb")
def nest_coulomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nest, at its own place, the plane and friction whose stress varies least at its events, relative to all times;
    against 2,000 cyclic shifts of the events and 2,000 draws of as many times; Benjamini-Hochberg on the first."""
    n, step, trials, mu_grid = 4096, 0.02, 2000, (0.0, 0.2, 0.4, 0.6, 0.8)
    grid = physics.tidal_tensor(physics.series(spark, 8760.0, step, n), F.col("day")).orderBy("k").select(*physics.COMPONENTS)
    series = np.array([list(r) for r in grid.collect()]) * 1e12  # n samples, of a size that squares well
    weights = physics.coulomb_coefficients(F.col("strike"), F.col("dip"), F.col("rake"), F.col("mu"))
    planes = physics.plane_grid(spark, 15, 15, 30).crossJoin(spark.createDataFrame([(m,) for m in mu_grid], "mu double"))
    planes = np.array([list(r) for r in planes.orderBy("plane", "mu").select(*weights).collect()])  # 1,728 planes at five frictions
    nest = F.substring("family", 2, 2).cast("int").alias("nest")
    at = F.least(F.greatest(F.round((F.col("day") - 8760.0) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    sums = tremor(spark, sf_dir).groupBy(nest, at.alias("i")).agg(F.count("*").alias("c"), F.sum("lat_deg").alias("lat"), F.sum("lon_deg").alias("lon"))
    total = F.sum("c")
    nests = sums.groupBy("nest").agg((F.sum("lat") / total).alias("lat"), (F.sum("lon") / total).alias("lon"), total.alias("n_events"), F.array_sort(F.collect_list(F.struct("i", "c"))).alias("x")).where("n_events >= 20")  # n entries a nest at most
    nests = materialize(nests.select("nest", "lat", "lon", F.col("x.i").alias("places"), F.col("x.c").alias("counts")), "nests")
    best = materialize(shifts.nest_scores(nests, series, planes, [t * 977 % n for t in range(1, trials + 1)]), "best")
    own = best.where("trial = 0").select("nest", F.col("score").alias("observed"))
    ps = best.where("trial > 0").join(own, "nest").groupBy("nest", "observed", "kind").agg(circular.empirical_p(F.col("score"), F.col("observed"), trials, smaller=True).alias("p"))
    both = ps.groupBy("nest", "observed").agg(*[F.max(F.when(F.col("kind") == k, F.col("p"))).alias(v) for k, v in (("cyclic", "p"), ("uniform", "p_uniform"))])
    return circular.benjamini_hochberg(both, "p", 0.05, "nest")


@query("gcmt_coulomb_sign")
def gcmt_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share and mean of tidal stress on events' own planes, against 400 block shifts of the tensors."""
    t = materialize(_shifted_tensors(cmt(spark, sf_dir).where(F.col("magnitude") >= 5.5), 400).select("trial", F.posexplode("planes").alias("which", "pl"), "nn", "ne", "nd", "ee", "ed", "dd").withColumn("cfs", physics.stress_pa(physics.coulomb(F.col("pl.strike"), F.col("pl.dip"), F.col("pl.rake"), 0.4))).groupBy("which", "trial").agg(F.avg(F.when(F.col("cfs") > 0, 1.0).otherwise(0.0)).alias("fraction"), F.avg("cfs").alias("mean")), "signs")
    own = t.where("trial = 0").select("which", F.col("fraction").alias("observed"), F.col("mean").alias("observed_mean"))
    return t.where("trial > 0").join(own, "which").groupBy("which", "observed", "observed_mean").agg(circular.empirical_p(F.col("fraction"), F.col("observed"), 400).alias("p_fraction"), circular.empirical_p(F.col("mean"), F.col("observed_mean"), 400).alias("p_mean"))


def _shifted_tensors(e: DataFrame, trials: int) -> DataFrame:
    """Events of the fixtures' span with their local tidal tensor at their own time (trial 0) and at times that move by blocks of 30
    days, 0 to 1.03505 days each. The tensor is interpolated in a grid of 0.02 days: within 1 % of its semidiurnal part."""
    moved = joins.block_offsets(e, 30, 1.03505, trials, -2191.0).unionByName(e.withColumns({"trial": F.lit(0), "block": F.lit(0).cast("long"), "offset": F.lit(0.0)}))
    grid, start, step, n = _tensor_grid(e.sparkSession)
    return physics.to_local(joins.interpolated(moved, grid, start, step, n, F.col("day") + F.col("offset"), list(physics.COMPONENTS)), "lat_deg", "lon_deg")


def _tensor_grid(spark: SparkSession) -> tuple[DataFrame, float, float, int]:
    """Tensors over the fixtures' span, with start, step and number."""
    start, step, n = -2195.0, 0.02, 151_250
    return materialize(physics.tidal_tensor(physics.series(spark, start, step, n), F.col("day")).select("k", *physics.COMPONENTS), "grid"), start, step, n


@query("metivier_reproduction")
def metivier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of events at uplift overall and by quartiles of depth and magnitude, from a tensor grid that is interpolated, with
    the p of each share among 400 block shifts of the tensors. Events are counted by both quartiles at once, as they meet the shifts."""
    trials = 400
    q = quake(spark, sf_dir)
    for key in ("depth_km", "magnitude"):
        q = equal_count_bins(q, F.col(key), 4, F.col("event_idx"), name=f"{key}_bin")
    q = q.select("day", "lat_deg", "lon_deg", (F.col("depth_km_bin") * 4 + F.col("magnitude_bin")).alias("cell"))
    grid, start, step, _ = _tensor_grid(spark)
    x = shifts.uplift_counts(q, grid, start, step, 16, trials, 30, 1.03505, -2191.0)
    names = {"all": F.lit(0), "depth_km": F.floor(F.col("cell") / 4).cast("int"), "magnitude": F.col("cell") % 4}
    bins = F.array(*[F.struct(F.lit(k).alias("by"), b.alias("bin")) for k, b in names.items()])
    s = materialize(x.withColumn("b", F.explode(bins)).groupBy("b.by", "b.bin", "trial").agg(F.sum("n").alias("n"), (F.sum("up") / F.sum("known")).alias("up")), "uplift")
    own = s.where("trial = 0").select("by", "bin", "n", F.col("up").alias("uplift"))
    return s.where("trial > 0").select("by", "bin", "up").join(own, ["by", "bin"]).groupBy("by", "bin", "n", "uplift").agg(circular.empirical_p(F.col("up"), F.col("uplift"), trials).alias("p"))


def _stress(spark: SparkSession, start: float, days: int) -> DataFrame:
    """(k, day, value): Coulomb stress of a vertical strike-slip plane at a site, every 0.02 days."""
    grid = physics.tidal_tensor(physics.series(spark, start, 0.02, days * 50), F.col("day")).withColumns({"lat": F.lit(35.9), "lon": F.lit(-120.5)})
    return physics.to_local(grid, "lat", "lon").select("k", "day", physics.stress_pa(physics.coulomb(F.lit(320.0), F.lit(90.0), F.lit(180.0), 0.4)).alias("value"))


LUNAR = (27.555, 29.531)  # days, of which shifts are no multiples


def _site_maxima(spark: SparkSession) -> DataFrame:
    """Maxima of the site's stress over the events' time and 4,000 days on either side."""
    return materialize(physics.maxima(_stress(spark, 4600.0, 8400)), "maxima")


@query("parkfield_coulomb_phase")
def coulomb_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schuster power of the twelve largest families on the phase between stress maxima, against 400 whole-day shifts of 30 to 3,999
    days that avoid lunar multiples; Benjamini-Hochberg."""
    families = tremor(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family").limit(12).select("family")
    e = tremor(spark, sf_dir).join(F.broadcast(families), "family", "left_semi").select(F.col("family").alias("grp"), F.lit(0).alias("bin"), "day")
    s = materialize(shifts.shifted_sums(e, _site_maxima(spark), shifts.whole_days(400, avoid=LUNAR)).withColumn("power", circular.power(F.col("c"), F.col("s"), F.col("n"))), "powers")
    own = s.where("trial = 0").select("grp", F.col("power").alias("observed"), F.degrees(F.atan2("s", "c")).alias("mean_phase"))
    p = s.where("trial > 0").select("grp", "power").join(own, "grp").groupBy(F.col("grp").alias("family"), "observed", "mean_phase").agg(circular.empirical_p(F.col("power"), F.col("observed"), 400).alias("p"))
    return circular.benjamini_hochberg(p, "p", 0.05, "family")


@query("parkfield_amplitude_law")
def amplitude_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power in six equal-count bins of cycle height with its p, and the slope of its logarithm with a p: against 2,000 whole-day
    shifts of 30 to 3,999 days, for which the slope's bins keep their edges. A slope needs 100 events in each bin."""
    return amplitude_law_of(tremor(spark, sf_dir), _site_maxima(spark), 6, 2000, 100)


def amplitude_law_of(events: DataFrame, tops: DataFrame, bins: int, trials: int, least: int) -> DataFrame:
    x = physics.forcing_phase(joins.as_of_both(events.select("event_idx", "day", F.lit(1).alias("site")), tops.select("day", F.lit(1).alias("site")), ["site"], 30.0))
    x = x.join(tops.select(F.col("day").alias("prev"), "height"), "prev")
    b = materialize(equal_count_bins(x, F.col("height"), bins, F.col("event_idx")).select("event_idx", "day", "height", "bin"), "binned")
    edges = [r.low for r in b.groupBy("bin").agg(F.min("height").alias("low")).orderBy("bin").collect()][1:]  # a row a bin
    offsets = shifts.whole_days(trials)
    e = b.select(F.lit("").alias("grp"), "bin", "day")
    power, height = circular.power(F.col("c"), F.col("s"), F.col("n")), F.abs(F.col("a") / F.col("n"))
    both = materialize(shifts.shifted_sums_of(e, tops, offsets, [None, edges]).select("which", "bin", "trial", "n", power.alias("power"), height.alias("amplitude")), "shifted")
    fixed, binned = both.where("which = 0").drop("which"), both.where("which = 1").drop("which")
    slopes = materialize(binned.groupBy("trial").agg(F.min("n").alias("least"), F.count("*").alias("bins"), F.regr_slope(F.log("power"), F.log("amplitude")).alias("slope")).where((F.col("least") >= least) & (F.col("bins") == bins)), "slopes")
    own = fixed.where("trial = 0").select("bin", "n", "amplitude", F.col("power").alias("observed"))
    ps = fixed.where("trial > 0").select("bin", "power").join(own, "bin").groupBy("bin", "n", "amplitude", "observed").agg(F.max("power").alias("null_max"), circular.empirical_p(F.col("power"), F.col("observed"), trials).alias("p"))
    seen = F.max(F.when(F.col("trial") == 0, F.col("slope")))
    tests = slopes.agg(seen.alias("slope"), F.sum((F.col("trial") > 0).cast("int")).alias("valid"))
    ge = slopes.where("trial > 0").select(F.col("slope").alias("x")).crossJoin(F.broadcast(tests)).agg(F.sum((F.col("x") >= F.col("slope")).cast("int")).alias("ge"))
    both = tests.crossJoin(ge).select("slope", F.when(F.col("slope").isNotNull(), (F.coalesce("ge", F.lit(0)) + 1) / (F.coalesce("valid", F.lit(0)) + 1.0)).alias("p_slope"))
    return ps.crossJoin(F.broadcast(both))


@query("lunar_tidal_field")
def tidal_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of the Moon's and the Sun's tide over a year, their ratio, and the trace, which must vanish."""
    days = physics.series(spark, 0.0, 0.5, 730)
    norm = F.sqrt(sum((F.col(c) * F.col(c) * (1 if c[0] == c[1] else 2) for c in physics.COMPONENTS), F.lit(0.0)))
    parts = [physics.tidal_tensor(days, F.col("day"), (b,)).agg(F.avg(norm).alias(b), F.max(F.abs(F.col("xx") + F.col("yy") + F.col("zz"))).alias(f"{b}_trace")) for b in ("moon", "sun")]
    return parts[0].crossJoin(parts[1]).withColumn("ratio", F.col("moon") / F.col("sun"))


@query("parkfield_ta_estimate", "SELECT a AS a_sigma_pa, round(2 * pi() * a / (1.0::DOUBLE / 365.25), 2) AS rate_pa_year, round(2 * pi() * a / 3000 * 365.25, 4) AS critical_days FROM (VALUES (600.0::DOUBLE), (10000.0), (100000.0)) t(a)")
def ta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit arithmetic between background stress, stressing rate and critical period."""
    a = spark.createDataFrame([(600.0,), (10000.0,), (100000.0,)], "a_sigma_pa double")
    return a.select("a_sigma_pa", F.round(physics.stressing_rate(F.col("a_sigma_pa"), F.lit(1.0)), 2).alias("rate_pa_year"), F.round(physics.critical_period_days(F.col("a_sigma_pa"), F.lit(3000.0)), 4).alias("critical_days"))


@query("demodulation", f"WITH {QUAKE_SQL}, g AS (SELECT floor(day / 50)::BIGINT AS \"window\", avg(magnitude * cos({2 * math.pi!r}::DOUBLE * day / 0.52)) AS a, avg(magnitude * sin({2 * math.pi!r}::DOUBLE * day / 0.52)) AS b FROM quake GROUP BY 1) SELECT \"window\", round(2 * sqrt(a * a + b * b), 6) AS amplitude FROM g")
def demodulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The magnitudes' half-day signal in windows of 50 days."""
    samples = quake(spark, sf_dir).select("day", F.col("magnitude").alias("value"))
    return physics.demodulate(samples, 0.52, 50.0).select("window", F.round("amplitude", 6).alias("amplitude"))


@query("forcing_maxima", "WITH series AS (SELECT event_id AS k, event_id * 0.05::DOUBLE AS day, value FROM events), n AS (SELECT *, lag(value) OVER (ORDER BY k) AS a, lead(value) OVER (ORDER BY k) AS c FROM series) SELECT round(day + 0.5 * (a - c) / (a - 2 * value + c) * 0.05, 4) AS day, round(value - 0.25 * (a - c) * (0.5 * (a - c) / (a - 2 * value + c)), 5) AS height FROM n WHERE value > a AND value >= c")
def forcing_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima of the events' values as a sampled series."""
    samples = load(spark, sf_dir, "events").select(F.col("event_id").alias("k"), (F.col("event_id") * 0.05).alias("day"), "value")
    return physics.maxima(samples, per=4096).select(F.round("day", 4).alias("day"), F.round("height", 5).alias("height"))


# Loading strain amplitudes (nanostrain) and phases (degrees) of two sites, east-east component.
LOADING = (("Parkfield", -120.5, "M2", 3.8956, 24.39), ("Parkfield", -120.5, "O1", 0.7448, -110.22), ("Cascadia", -123.0, "M2", 11.0051, 15.81), ("Cascadia", -123.0, "O1", 2.8530, -104.93))


@query("s17_loading_constants", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {lon}::DOUBLE, '{b}', {a}::DOUBLE, {p}::DOUBLE)" for s, lon, b, a, p in LOADING) + ") t(site, lon, band, amplitude, phase_deg)")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(LOADING), "site string, lon double, band string, amplitude double, phase_deg double")


@query("d23_loading_strain", f"WITH {QUAKE_SQL}, days AS (SELECT DISTINCT day FROM quake), b(band, species, start, rate, period) AS (VALUES {tides.values_sql(['M2', 'O1'])}), l(site, lon, band, amplitude, phase_deg) AS (VALUES " + ", ".join(f"('{s}', {lon}::DOUBLE, '{b}', {a}::DOUBLE, {p}::DOUBLE)" for s, lon, b, a, p in LOADING) + ") SELECT site, round(day, 8) AS day, round(sum(amplitude * cos(radians(start + rate * day + species * lon + phase_deg + 10.97))), 5) AS strain FROM l JOIN b USING (band), days GROUP BY site, day")
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading strain of both sites at the times of the events."""
    coefficients = s17(spark, sf_dir).join(F.broadcast(tides.table(spark, ["M2", "O1"])), "band")
    x = physics.loading_strain(coefficients, quake(spark, sf_dir).select("day").distinct())
    return x.select("site", F.round("day", 8).alias("day"), F.round("strain", 5).alias("strain"))


# Hourly strain from day 7305 at longitude -120.150, computed outside, and the M2 amplitude and phase it stands for.
TRUTH = (-2.61715, -2.68867, -2.26031, -1.38144, -0.20627, 1.04126, 2.11910, 2.82257, 3.03018, 2.72902, 2.01411, 1.06245)
TRUTH_LON, TRUTH_AMPLITUDE, TRUTH_PHASE = -120.150, 2.7008, 130.43
_M2 = tides.constituent("M2")
_ARGUMENT = f"{_M2.start!r}::DOUBLE + {_M2.rate!r}::DOUBLE * (7305 + k / 24.0::DOUBLE) + 2 * {TRUTH_LON}::DOUBLE"


@query("verify_loading_phase", "WITH truth(k, x) AS (VALUES " + ", ".join(f"({k}, {x}::DOUBLE)" for k, x in enumerate(TRUTH)) + f"), m AS (SELECT x, {TRUTH_AMPLITUDE}::DOUBLE * cos(radians({_ARGUMENT} + {TRUTH_PHASE} + 10.97)) AS plus, {TRUTH_AMPLITUDE}::DOUBLE * cos(radians({_ARGUMENT} - {TRUTH_PHASE} + 10.97)) AS minus FROM truth) SELECT round(corr(plus, x), 6) AS r_plus, round(corr(minus, x), 6) AS r_minus, round(max(abs(plus - x)), 5) AS worst FROM m")
def verify_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sign conventions of the loading phase against twelve hours of strain that another program computed."""
    c = spark.createDataFrame([("truth", TRUTH_LON, "M2", TRUTH_AMPLITUDE, TRUTH_PHASE)], "site string, lon double, band string, amplitude double, phase_deg double").join(F.broadcast(tides.table(spark, ["M2"])), "band")
    days = physics.series(spark, 7305.0, 1 / 24, 12)
    a = physics.loading_strain(c, days.select("day")).withColumnRenamed("strain", "plus")
    b = physics.loading_strain(c.withColumn("phase_deg", -F.col("phase_deg")), days.select("day")).withColumnRenamed("strain", "minus")
    truth = days.join(spark.createDataFrame(list(enumerate(TRUTH)), "k long, truth double"), "k").select("day", "truth")
    x = a.join(b, ["site", "day"]).join(truth, "day")
    return x.agg(F.round(F.corr("plus", "truth"), 6).alias("r_plus"), F.round(F.corr("minus", "truth"), 6).alias("r_minus"), F.round(F.max(F.abs(F.col("plus") - F.col("truth"))), 5).alias("worst"))
