"""Further end-to-end programs built from the operators."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.random import M, mix2, uniform
from tremorlake.operators import charts, circular, design, joins, matrix, models, physics, scores, shifts, tides
from tremorlake.operators.tables import materialize
from tremorlake.plans.fixtures import QUAKE_SQL, quake, tremor
from tremorlake.plans.matched import indexed, score_features, time_design
from tremorlake.plans.modelling import FEATURES, _halves, boosted_grid, with_features
from tremorlake.plans.registry import query
from tremorlake.plans.tidal import LOADING, _null, _stress, synthetic


@query("chart_aspects", f"WITH {QUAKE_SQL} SELECT event_idx, 1.0::DOUBLE AS one FROM quake")
def chart_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and ranges of the chart features of each event: cosines stay within 1, and every value is finite."""
    x, names = charts.chart_features(quake(spark, sf_dir), "day", "lat_deg", "lon_deg", 2)
    aspects = [i for i, n in enumerate(names) if n.startswith("aspect.")]
    fine = F.forall(F.slice("features", aspects[0] + 1, len(aspects)), lambda v: F.abs(v) <= 1.000001) & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size("features") == len(names))
    return x.select("event_idx", fine.cast("int").cast("double").alias("one"))


@query("chart_families", "SELECT * FROM (VALUES ('aspect', 720), ('declination', 55), ('fixed', 80), ('resonance', 112), ('motion', 18), ('lunar', 10), ('shape', 2), ('eclipse', 3)) t(family, n)")
def chart_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features a family at eight harmonics."""
    return spark.createDataFrame([(k, len(v[0])) for k, v in charts.families(np.zeros(1), 8).items()], "family string, n int")


@query("chart_score_scan")
def chart_score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional scores of all chart features over the matched design: features are made and summed in the tasks that strata were dealt to."""
    m = matrix.made(indexed(time_design(spark, sf_dir)), [F.col("day")], charts.names(2), lambda day: charts.values(day, 2))
    return matrix.observed(m, matrix.scan_sums(m))


@query("score_scan")
def score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with at most four controls a stratum, and the number of independent tests that its null amounts to."""
    m = matrix.of(design.first_controls(design.usable(indexed(time_design(spark, sf_dir))), 4), score_features())
    sums = matrix.scan_sums(m, 100)
    out = scores.family_wise(matrix.observed(m, sums), matrix.null(m, sums))
    rounded = {c: F.round(c, 5) for c in ("max_abs_z", "perm_threshold_95", "perm_median")} | {"family_wise_p": F.round("family_wise_p", 6)}
    return out.withColumn("effective_tests", F.round(scores.effective_tests(F.col("perm_median")), 2)).withColumns(rounded)


@query("train_gbt")
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over depth and rate on a planted effect: gain in validation and each model as JSON."""
    train, check = _halves(with_features(design.plant(with_features(indexed(time_design(spark, sf_dir))), "f_hash", 0.8)))
    model = lambda m: json.dumps({"features": m.names, "trees": [{str(k): v for k, v in t.items()} for t in m.trees]})
    out = [(m.depth, m.rate, max(m.gains), model(m)) for m in models.fit_grid(boosted_grid(), train, FEATURES, check)]
    return spark.createDataFrame(out, "depth int, rate double, bits_per_event double, model string")


@query("k3_model_table")
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conditional logit's coefficients and scales, one row a feature."""
    train, _ = _halves(with_features(design.plant(with_features(indexed(time_design(spark, sf_dir))), "f_hash", 0.6)))
    m = models.ConditionalLogit(1e-2, 8).fit(train, FEATURES)
    return spark.createDataFrame([(n, float(b), *m.scales[n]) for n, b in zip(m.names, m.beta, strict=True)], "feature string, beta double, mean double, sd double")


@query("s14_synthetic_catalogues", "SELECT 'poisson' AS kind, 20 AS catalogues, 4000 AS n UNION ALL SELECT 'hawkes', 20, 4000")
def synthetic_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the Poisson and the clustered catalogues; the thinned kind has a random size."""
    x = synthetic(spark, 20, 200, 2000.0).where("kind != 'injected'")
    return x.groupBy("kind").agg(F.countDistinct("trial_id").cast("int").alias("catalogues"), F.count("*").cast("int").alias("n"))


@query("s15_synthetic_design")
def synthetic_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sd of a synthetic design's normal features."""
    base = spark.range(3000 * 11).select(F.floor(F.col("id") / 11).alias("stratum"), (F.col("id") % 11).alias("row_idx"))
    u = lambda s: uniform(mix2(F.col("stratum") % M, F.col("row_idx"), s))
    x = base.select(*[(F.sqrt(-2 * F.log(u(200 + 2 * i) + 1e-12)) * F.cos(2 * math.pi * u(201 + 2 * i))).alias(f"x{i}") for i in range(4)])
    return x.agg(*[F.round(f(f"x{i}"), 6).alias(f"{n}_{i}") for i in range(4) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


@query("moonquake_tidal_phase")
def moonquake_tidal_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schuster power of orders 1 to 4 on the phase between forcing maxima, against 200 whole-day shifts of the whole sequence of 40 to
    1,200 days that avoid the month of the Moon's distance and half the period of its node's meeting with the Sun."""
    tops = materialize(physics.maxima(_stress(spark, 7500.0, 2700)), "maxima")
    e = tremor(spark, sf_dir).select(F.lit("").alias("grp"), F.lit(0).alias("bin"), "day")
    offsets = shifts.whole_days(200, 40, 1200, avoid=(27.555, 205.89))
    power = circular.power(F.col("c"), F.col("s"), F.col("n"))
    s = materialize(shifts.shifted_sums(e, tops, offsets, orders=4).select("k", "trial", power.alias("power"), F.degrees(F.atan2("s", "c")).alias("mean_phase")), "powers")
    own = s.where("trial = 0").select("k", F.col("power").alias("observed"), "mean_phase")
    return s.where("trial > 0").select("k", "power").join(own, "k").groupBy("k", "observed", "mean_phase").agg(circular.empirical_p(F.col("power"), F.col("observed"), 200).alias("p"))


@query("parkfield_transfer_function")
def transfer_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demodulated amplitude of the stress in three bands. The sham-frequency null of this program is known to be invalid and not offered."""
    stress = materialize(_stress(spark, 8650.0, 120), "stress")
    out = None
    for name in ("M2", "O1", "K1"):
        part = physics.demodulate(stress, tides.constituent(name).period_days, 29.53).withColumn("band", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("total_tide_lag")
def total_tide_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase lags behind the solid tide alone and behind solid tide and ocean loading, of two constituents at one site."""
    bands = tides.table(spark, ["M2", "O1"])
    solid = materialize(_stress(spark, 8650.0, 120), "stress")
    rows = [r for r in LOADING if r[0] == "Parkfield"]
    loads = spark.createDataFrame(rows, "site string, lon double, band string, amplitude double, phase_deg double").join(F.broadcast(bands), "band")
    strain = physics.loading_strain(loads, solid.select("day")).select("day", (F.col("strain") * 1e-9 * 2 * physics.SHEAR / 0.75).alias("load"))
    both = solid.join(strain, "day").withColumn("value", F.col("value") + F.col("load"))
    seen = circular.schuster(circular.band_phases(tremor(spark, sf_dir).withColumn("lon", F.lit(-120.5)), bands, "lon"), ["band"])
    out = None
    for name, series in (("solid", solid), ("total", both)):
        part = circular.phase_lag(seen, circular.harmonic_fit(series, bands, longitude=-120.5)).withColumn("tide", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("band_prediction_rw")
def band_prediction_rw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response per Pascal of the tide by band: the observed one where it is significant, else its bound, with the verdict."""
    names = ["M2", "N2", "O1", "Q1", "Mf", "Mm"]
    amp = circular.harmonic_fit(_stress(spark, 8650.0, 240), tides.table(spark, names), longitude=-120.5).select("band", "amplitude", "period")
    x = _null(tremor(spark, sf_dir), names, []).join(F.broadcast(amp), "band")
    x = x.withColumns({"significant": F.col("p") < 0.05, "response": F.when(F.col("p") < 0.05, F.col("eps")).otherwise(F.col("eps_limit")) / F.col("amplitude")})
    long_, short = F.max(F.when(F.col("period") > 2, F.col("significant"))), F.max(F.when(F.col("period") <= 2, F.col("significant")))
    verdict = x.agg(F.when(short & ~long_, "refuted").otherwise("unconstrained").alias("verdict"))
    return x.select("band", "period", "amplitude", "significant", "response").crossJoin(F.broadcast(verdict))
