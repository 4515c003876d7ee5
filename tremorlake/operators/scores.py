"""Conditional score tests over matched strata, with permutation nulls.

Features come as a long table (stratum, row_idx, is_case, feature, x). U sums the case's deviation from its stratum's mean, V the
stratum variances; z = U / sqrt(V). Permutations pick a row of each stratum by a counter hash, so the null keeps all
correlations between features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.distributions import normal_sf
from tremorlake.functions.random import M, mix2


def melt(design: DataFrame, features: dict[str, F.Column]) -> DataFrame:
    """Design rows -> the long table of the given features."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("x")) for k, v in features.items()])
    return design.select("stratum", "row_idx", "is_case", F.explode(pairs).alias("p")).select("stratum", "row_idx", "is_case", "p.feature", "p.x")


def calendar_features() -> dict[str, F.Column]:
    """Functions of the date alone, which an unbiased design must not respond to."""
    d = F.col("day")
    turn = 2 * 3.141592653589793 * d / 181000
    return {"date": d, "date2": F.pow(d / 1000, 2), "slow_cos": F.cos(turn), "slow_sin": F.sin(turn), "day_of_month": F.pmod(d, F.lit(30.44))}


def strata_moments(long: DataFrame) -> DataFrame:
    """(feature, stratum) -> n, mean, v (mean squared deviation) and the case's deviation u."""
    g = long.groupBy("feature", "stratum").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.sum(F.when(F.col("is_case"), F.col("x"))).alias("case_x"), F.sum("x").alias("t1"), F.sum(F.col("x") * F.col("x")).alias("t2"))
    return g.withColumn("u", F.col("case_x") - F.col("mean"))


def conditional_score(long: DataFrame) -> DataFrame:
    """feature -> U, V, z, total variance, leverage, whether it can be tested."""
    f = strata_moments(long).groupBy("feature").agg(F.sum("u").alias("u"), F.sum("v").alias("v"), F.count("*").alias("n_strata"), F.sum("n").alias("n_rows"), F.sum("t1").alias("t1"), F.sum("t2").alias("t2"))
    total = F.greatest(F.col("t2") / F.col("n_rows") - F.pow(F.col("t1") / F.col("n_rows"), 2), F.lit(0.0))
    f = f.withColumn("total_var", total).withColumn("leverage", F.when(F.col("total_var") > 0, F.col("v") / F.col("n_strata") / F.col("total_var")).otherwise(0.0))
    f = f.withColumn("testable", (F.col("v") > 1e-12) & (F.col("leverage") > 1e-8))
    return f.withColumn("z", F.when(F.col("testable"), F.col("u") / F.sqrt("v")).otherwise(0.0)).select("feature", "u", "v", "z", "n_strata", "total_var", "leverage", "testable")


def permutations(long: DataFrame, n: int, seed: int = 20260822) -> DataFrame:
    """(perm, feature) -> z of a random row of each stratum in the case's place. Rows of a feature are numbered in their strata by row_idx."""
    scores = conditional_score(long).where("testable").select("feature", "v")
    means = strata_moments(long).select("feature", "stratum", "mean")
    centred = long.join(means, ["feature", "stratum"]).select("feature", "stratum", "row_idx", (F.col("x") - F.col("mean")).alias("d"))
    # A stratum is small and stays together as one row, so draws need no join and their sums are combined before the shuffle.
    strata = centred.groupBy("stratum").agg(F.array_sort(F.collect_set("row_idx")).alias("rows"), F.collect_list(F.struct("row_idx", "feature", "d")).alias("entries"))
    draw = mix2(F.col("stratum") % M, F.col("perm"), seed)
    picks = strata.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("pick", F.get("rows", (draw % F.size("rows")).cast("int")))
    drawn = picks.select("perm", F.explode(F.filter("entries", lambda e: e["row_idx"] == F.col("pick"))).alias("e"))
    u = drawn.groupBy("perm", F.col("e.feature").alias("feature")).agg(F.sum("e.d").alias("u"))
    return u.join(scores, "feature").select("perm", "feature", (F.col("u") / F.sqrt("v")).alias("z"))


def family_wise(observed: DataFrame, null: DataFrame) -> DataFrame:
    """One row: the largest |z|, its p among the permutations' largest, their median and 95 % point; p is never under 1 / (n + 1)."""
    top = observed.where("testable").agg(F.max(F.abs("z")).alias("max_abs_z"))
    each = null.groupBy("perm").agg(F.max(F.abs("z")).alias("m"))
    hits = F.sum(F.when(F.col("m") >= F.col("max_abs_z") - 1e-12, 1).otherwise(0))
    return each.crossJoin(F.broadcast(top)).groupBy("max_abs_z").agg(((hits + 1) / (F.count("*") + 1)).alias("family_wise_p"), F.percentile("m", F.lit(0.95)).alias("perm_threshold_95"), F.median("m").alias("perm_median"), F.count("*").alias("perms"))


def z_spread(observed: DataFrame) -> DataFrame:
    """Mean and population sd of z over testable features, and exceedances of 2, 3 and 4 against the normal tail."""
    ok = observed.where("testable")
    over = [F.sum((F.abs("z") > t).cast("int")).alias(f"over_{t}") for t in (2, 3, 4)]
    expect = [(F.count("*") * 2 * normal_sf(F.lit(float(t)))).alias(f"expect_{t}") for t in (2, 3, 4)]
    return ok.agg(F.count("*").alias("n"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_sd"), *over, *expect)


def effective_tests(median_max: F.Column) -> F.Column:
    """Independent tests that would give the same median of the largest |z|."""
    return F.log(F.lit(0.5)) / F.log(1 - 2 * normal_sf(median_max))


def information_gain(long_scores: DataFrame) -> DataFrame:
    """(stratum, is_case, score) -> one row: mean of log2 of the case's softmax share times the stratum's size."""
    g = long_scores.groupBy("stratum").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    s = long_scores.join(g, "stratum").groupBy("stratum", "n", "top").agg(F.sum(F.exp(F.col("score") - F.col("top"))).alias("z"), F.max(F.when(F.col("is_case"), F.col("score"))).alias("case_score"))
    lp = F.col("case_score") - F.col("top") - F.log("z") + F.log(F.col("n").cast("double"))
    return s.agg(F.count("*").alias("n_strata"), (F.avg(lp) / F.log(F.lit(2.0))).alias("bits_per_event"))
