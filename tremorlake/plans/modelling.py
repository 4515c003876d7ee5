"""Feature matrices, conditional models and boosted trees over matched designs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.random import M, mix2, uniform
from tremorlake.operators import decluster, design, joins, models, physics, scores
from tremorlake.operators.tables import materialize
from tremorlake.plans.fixtures import QUAKE_SQL, SPAN, quake
from tremorlake.plans.matched import _INDEXED, indexed, mainshocks, time_design
from tremorlake.plans.registry import query

FEATURES = ["f_day", "f_month", "f_hash", "f_flat"]


def with_features(d: DataFrame) -> DataFrame:
    """Four exact features of a row; the last is constant, to be frozen."""
    k = F.col("stratum") * 7 + F.col("row_idx") * 13
    return d.withColumns({"f_day": F.col("day"), "f_month": F.col("day") - F.floor(F.col("day") / 30.44) * 30.44, "f_hash": (k % 11).cast("double"), "f_flat": F.lit(1.0)})


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(with_features(indexed(time_design(spark, sf_dir))), "features")


_FEATURED = f"{_INDEXED}, featured AS (SELECT *, day AS f_day, day - floor(day / 30.44::DOUBLE) * 30.44::DOUBLE AS f_month, ((stratum * 7 + row_idx * 13) % 11)::DOUBLE AS f_hash, 1.0::DOUBLE AS f_flat FROM indexed)"


@query("a29_scales", f"WITH {_FEATURED} SELECT name, round(m, 4) AS mean, round(s, 4) AS sd FROM (SELECT 'f_day' AS name, avg(f_day) AS m, stddev_pop(f_day) AS s FROM featured UNION ALL SELECT 'f_month', avg(f_month), stddev_pop(f_month) FROM featured UNION ALL SELECT 'f_hash', avg(f_hash), stddev_pop(f_hash) FROM featured UNION ALL SELECT 'f_flat', avg(f_flat), stddev_pop(f_flat) FROM featured)")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = models.scales(_features(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(k, round(m, 4), round(s, 4)) for k, (m, s) in by.items()], "name string, mean double, sd double")


@query("m2_standardised", f"WITH {_FEATURED}, s AS (SELECT avg(f_month) AS m, stddev_pop(f_month) AS d FROM featured) SELECT stratum, row_idx, round((f_month - m) / d, 4) + 0.0 AS x FROM featured, s")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    by = models.scales(rows, ["f_month"])
    return rows.select("stratum", "row_idx", (F.round(F.get(models.standardised(["f_month"], by), F.lit(0)), 4) + 0.0).alias("x"))


@query("w2_stratum_softmax", f"WITH {_FEATURED}, e AS (SELECT *, exp(f_hash / 5 - max(f_hash / 5) OVER (PARTITION BY stratum)) AS w FROM featured) SELECT stratum, row_idx, round(w / sum(w) OVER (PARTITION BY stratum), 6) AS p FROM e")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("stratum")
    x = _features(spark, sf_dir).withColumn("w", F.exp(F.col("f_hash") / 5 - F.max(F.col("f_hash") / 5).over(w)))
    return x.select("stratum", "row_idx", F.round(F.col("w") / F.sum("w").over(w), 6).alias("p"))


@query("a28_information_gain", f"WITH {_FEATURED}, g AS (SELECT stratum, max(f_hash / 5) AS top, count(*) AS n FROM featured GROUP BY stratum), s AS (SELECT stratum, n, top, sum(exp(f_hash / 5 - top)) AS z, max(f_hash / 5) FILTER (is_case) AS c FROM featured JOIN g USING (stratum) GROUP BY ALL) SELECT count(*) AS n_strata, round(avg(c - top - ln(z) + ln(n)) / ln(2), 6) AS bits_per_event FROM s")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _features(spark, sf_dir).select("stratum", "is_case", (F.col("f_hash") / 5).alias("score"))
    return scores.information_gain(x).select("n_strata", F.round("bits_per_event", 6).alias("bits_per_event"))


@query(
    "m4_quantile_bins",
    f"""WITH {_FEATURED}, q AS (SELECT f AS feature, unnest(quantile_disc(x, list_transform(range(1, 64), lambda k: k / 64.0::DOUBLE))) AS edge FROM (SELECT 'f_day' AS f, f_day AS x FROM featured UNION ALL SELECT 'f_month', f_month FROM featured UNION ALL SELECT 'f_hash', f_hash FROM featured UNION ALL SELECT 'f_flat', f_flat FROM featured) GROUP BY f),
e AS (SELECT DISTINCT feature, edge FROM q)
SELECT feature, round(edge, 8) AS edge, row_number() OVER (PARTITION BY feature ORDER BY edge)::INTEGER AS place FROM e""",
)
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner edges of 64 equal-count bins of each feature; equal edges are one."""
    edges = models.quantile_edges(_features(spark, sf_dir), FEATURES, 64)
    rows = [(c, float(e), i) for c, own in edges.items() for i, e in enumerate(own, 1)]
    return spark.createDataFrame(rows, "feature string, edge double, place int").withColumn("edge", F.round("edge", 8))


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and validation strata, by a split of the case's day in the middle of the span; rows are written with it, once for both."""
    split = materialize(design.with_split(rows, train_end=-500.0, test_start=SPAN[1]), "split")
    return split.where("split = 'train'"), split.where("split = 'validate'")


@query("train_conditional_logit")
def train_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information gain in validation of a planted effect at eight ridge strengths, fitted in shared scans; best and median strengths."""
    rows = with_features(design.plant(with_features(indexed(time_design(spark, sf_dir))), "f_hash", 0.6))
    train, check = _halves(rows)
    path = models.LogitPath([1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0], 12).fit(train, FEATURES)
    n = check.where("is_case").count()
    out = [(ridge, float(b[2]), gain, n, path.scans) for ridge, b, gain in zip(path.ridges, path.betas, path.gains(check), strict=True)]
    grid = spark.createDataFrame(out, "ridge double, beta_hash double, bits_per_event double, n_strata long, scans int")
    summary = grid.agg(F.max_by("ridge", "bits_per_event").alias("best_ridge"), F.median("bits_per_event").alias("median_bits"))
    return grid.crossJoin(F.broadcast(summary))


@query("a32_best_of_grid", f"WITH {QUAKE_SQL}, g AS (SELECT event_idx % 7 AS config, avg(magnitude) AS bits FROM quake GROUP BY 1) SELECT arg_max(config, bits) AS best_config, round(median(bits), 9) AS median_bits FROM g")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and the median of seven groups of events, by their mean magnitude."""
    g = quake(spark, sf_dir).groupBy((F.col("event_idx") % 7).alias("config")).agg(F.avg("magnitude").alias("bits"))
    return g.agg(F.max_by("config", "bits").alias("best_config"), F.round(F.median("bits"), 9).alias("median_bits"))


def boosted_grid() -> list[models.BoostedTrees]:
    """Depths and rates; up to 1,000 trees each, until 50 in a row are no better in validation."""
    return [models.BoostedTrees(depth=depth, rate=rate, trees=1000, min_leaf=20, bins=127, bagging=0.8, features=0.5, patience=50) for depth in (2, 3, 4) for rate in (0.01, 0.05)]


@query("train_gbt_stream")
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on a planted effect, train and validation strata thinned apart; gain in validation by depth and rate."""
    rows = with_features(design.plant(with_features(indexed(time_design(spark, sf_dir))), "f_hash", 0.8))

    def thinned(part: DataFrame) -> DataFrame:
        cases = part.where("is_case").select(F.col("stratum").alias("event_idx"), "day", "lat_deg", "lon_deg")
        return part.join(decluster.thin(cases, 50, 30, flat=True).where("is_main").select(F.col("event_idx").alias("stratum")), "stratum", "left_semi")

    train, check = (materialize(thinned(p), "thinned") for p in _halves(rows))
    n = check.where("is_case").select("stratum").distinct().count()
    out = [(m.depth, m.rate, len(m.trees), m.scans, max(m.gains), n) for m in models.fit_grid(boosted_grid(), train, FEATURES, check)]
    return spark.createDataFrame(out, "depth int, rate double, trees int, scans int, bits_per_event double, n_strata long")


@query("power_check")
def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planted effect of rising strength on one feature, and the same spread over four (each beta / 2): the gain that a fit recovers."""
    base = indexed(time_design(spark, sf_dir))
    k = F.col("stratum")
    spread = {f"g{i}": uniform(mix2(k % M, F.col("row_idx"), 71 + i)) for i in range(4)}
    base = materialize(base.select("stratum", "row_idx", "is_case", "day").withColumns(spread).withColumn("total", sum((F.col(c) for c in spread), F.lit(0.0))), "base")
    out = []
    for name, feature, beta in (("one", "g0", 0.0), ("one", "g0", 0.2), ("one", "g0", 0.4), ("one", "g0", 0.8), ("spread", "total", 0.8)):
        train, check = _halves(design.plant(base, feature, beta).drop("total"))
        model = models.ConditionalLogit(1e-2, 12).fit(train, list(spread))
        got = scores.information_gain(model.scores(check)).first()
        out.append((name, beta, got["bits_per_event"], got["bits_per_event"] > 0))
    return spark.createDataFrame(out, "effect string, strength double, bits_per_event double, recovered boolean")


@query("test_pipeline_null")
def pipeline_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks on a synthetic design of ten controls: no signal gains nothing, a planted one is found, shuffled labels lose it."""
    base = spark.range(600 * 11).select(F.floor(F.col("id") / 11).alias("stratum"), (F.col("id") % 11).alias("row_idx"))
    u = lambda s: uniform(mix2(F.col("stratum"), F.col("row_idx"), s))
    normal = lambda s: F.sqrt(-2 * F.log(u(s) + 1e-12)) * F.cos(2 * math.pi * u(s + 1))
    base = materialize(base.withColumns({"is_case": F.col("row_idx") == 0, **{f"x{i}": normal(100 + 2 * i) for i in range(4)}}), "synthetic")
    out = []
    for name in ("null", "planted", "shuffled"):
        d = design.plant(base, "x0", 1.0) if name != "null" else base
        d = materialize(design.shuffle_labels(d) if name == "shuffled" else d, "labelled")
        train, check = d.where("stratum % 2 = 0"), d.where("stratum % 2 = 1")
        model = models.ConditionalLogit(1e-2, 12).fit(train, [f"x{i}" for i in range(4)])
        bits = scores.information_gain(model.scores(check)).first()["bits_per_event"]
        out.append((name, bits, float(model.beta[0]), bits >= 0.02 if name == "planted" else bits <= 0.01))
    return spark.createDataFrame(out, "design string, bits_per_event double, beta double, passed boolean")


@query("featurise")
def featurise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue to feature table: declustered cases, calendar-matched controls, aspects of Sun and Moon, station timing, as one array a row."""
    main = mainshocks(spark, sf_dir, 5.0).where("is_main").drop("is_main")
    rows = indexed(design.time_stratified(design.cases(main, SPAN), SPAN, 7))
    d = F.col("day") - 0.5
    sun, moon = physics._sun(d)[0], physics._moon(d)[0]
    aspects = [f(n * (moon - sun)) for n in range(1, 5) for f in (F.cos, F.sin)]
    marks = spark.range(400).select(F.lit(1).alias("body"), (F.col("id") * 14.765 - 2300).alias("day"))
    timed = joins.mark_timing(joins.as_of_both(rows.withColumn("body", F.lit(1)), marks, ["body"]), SPAN)
    features = F.array(*[x.cast("float") for x in [*aspects, F.col("since"), F.col("until"), F.col("nearest"), F.col("fraction")]])
    return timed.select("stratum", "row_idx", F.round("day", 6).alias("day"), "cell", "is_case", features.alias("features"))


@query("s10_matrix_size")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, values and totals of a feature table written as Parquet and read again."""
    x = materialize(_features(spark, sf_dir).select(F.array(*FEATURES).alias("f")), "matrix")
    return x.agg(F.count("*").alias("n_rows"), F.sum(F.size("f")).alias("n_values"), *[F.round(F.sum(F.get("f", F.lit(i))), 3).alias(f"total_{n[2:]}") for i, n in enumerate(FEATURES)])


@query("d22_timing_span")
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing without marks: the span's ends stand in."""
    e = quake(spark, sf_dir).select("event_idx", "day", F.lit(1).alias("body"))
    none = e.where("false").select("body", "day")
    return joins.mark_timing(joins.as_of_both(e, none, ["body"]), SPAN).select("event_idx", *[F.round(c, 8).alias(c) for c in ("since", "until", "nearest", "fraction")])
