"""Declustering, thinning, matched designs, splits and score tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import labels
from tremorlake.functions.random import M, mix_sql
from tremorlake.operators import decluster, design, matrix, scores
from tremorlake.operators.tables import materialize
from tremorlake.plans.catalogue import annual_counts, cell_sql, dispersion, select_events
from tremorlake.plans.fixtures import CMT_SQL, QUAKE_SQL, SPAN, cmt, quake
from tremorlake.plans.registry import query

ROUNDS = 9  # rounds of the fixpoint that the SQL twins unroll; the fixtures settle in fewer

_KM = "2 * 6371.0 * asin(least(sqrt(pow(sin(radians(b.lat_deg - a.lat_deg) / 2), 2) + cos(radians(a.lat_deg)) * cos(radians(b.lat_deg)) * pow(sin(radians(b.lon_deg - a.lon_deg) / 2), 2)), 1.0))"
_FLAT = "pow((b.lat_deg - a.lat_deg) * 111.19, 2) + pow((b.lon_deg - a.lon_deg) * 111.19 * cos(radians(b.lat_deg)), 2)"


def fixpoint_sql(edges: str, nodes: str) -> str:
    """CTEs up to `main(event_idx)`: the unrolled rounds over an edge query (src, dst) and a node query (event_idx)."""
    out = [f"edges AS MATERIALIZED ({edges})", f"open0 AS MATERIALIZED ({nodes})"]
    for i in range(ROUNDS):
        out.append(f"main{i} AS MATERIALIZED (SELECT event_idx FROM open{i} o WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN open{i} s ON e.src = s.event_idx WHERE e.dst = o.event_idx))")
        out.append(f"open{i + 1} AS MATERIALIZED (SELECT event_idx FROM open{i} o WHERE o.event_idx NOT IN (SELECT event_idx FROM main{i}) AND o.event_idx NOT IN (SELECT dst FROM edges WHERE src IN (SELECT event_idx FROM main{i})))")
    return ", ".join(out) + ", main AS (" + " UNION ALL ".join(f"SELECT event_idx FROM main{i}" for i in range(ROUNDS)) + ")"


def claims_sql(source: str = "quake") -> str:
    return f"""SELECT a.event_idx AS src, b.event_idx AS dst FROM (SELECT *, CASE WHEN magnitude >= 6.5 THEN pow(10, 0.032 * magnitude + 2.7389) ELSE pow(10, 0.5409 * magnitude - 0.547) END AS days, pow(10, 0.1238 * magnitude + 0.983) AS km FROM {source}) a
JOIN {source} b ON b.day BETWEEN a.day - a.days AND a.day + a.days AND a.event_idx <> b.event_idx
WHERE (a.magnitude > b.magnitude OR (a.magnitude = b.magnitude AND (a.day < b.day OR (a.day = b.day AND a.event_idx < b.event_idx)))) AND {_KM} <= a.km"""


def near_sql(source: str, km: float, days: float, flat: bool) -> str:
    space = f"{_FLAT} < {km * km}" if flat else f"{_KM} <= {km}"
    return f"SELECT a.event_idx AS src, b.event_idx AS dst FROM {source} a JOIN {source} b ON b.day BETWEEN a.day AND a.day + {days} AND a.event_idx <> b.event_idx WHERE (a.day < b.day OR a.event_idx < b.event_idx) AND {space}"


_MAIN_SQL = f"{QUAKE_SQL}, {fixpoint_sql(claims_sql(), 'SELECT event_idx FROM quake')}"


def mainshocks(spark: SparkSession, sf_dir: str, least: float = 4.0) -> DataFrame:
    return decluster.gardner_knopoff(select_events(quake(spark, sf_dir), least))


@query("j4_claim_edges", f"WITH {QUAKE_SQL} {claims_sql()}")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decluster.gardner_knopoff_edges(quake(spark, sf_dir))


@query("d1_decluster", f"WITH {_MAIN_SQL} SELECT event_idx, event_idx IN (SELECT event_idx FROM main) AS is_main FROM quake")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainshocks(spark, sf_dir).select("event_idx", "is_main")


@query("j5_thinning_edges", f"WITH {QUAKE_SQL}, q AS (SELECT * FROM quake WHERE magnitude >= 5.5) {near_sql('q', 500, 365, False)}")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decluster.claim_edges(select_events(quake(spark, sf_dir), 5.5), F.lit(365.0), F.lit(500.0), F.col("day"), F.lit(0.0), two_sided=False)


def _thin_sql(km: float, days: float, flat: bool) -> str:
    return f"WITH {QUAKE_SQL}, q AS (SELECT * FROM quake WHERE magnitude >= 5.5), {fixpoint_sql(near_sql('q', km, days, flat), 'SELECT event_idx FROM q')} SELECT event_idx FROM main"


@query("d17_thin", _thin_sql(500, 365, False))
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decluster.thin(select_events(quake(spark, sf_dir), 5.5), 500, 365).where("is_main").select("event_idx")


@query("d18_thin_flat", _thin_sql(500, 365, True))
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decluster.thin(select_events(quake(spark, sf_dir), 5.5), 500, 365, flat=True).where("is_main").select("event_idx")


@query("j3_mainshock_tensors", f"WITH {CMT_SQL}, {fixpoint_sql(claims_sql(), 'SELECT event_idx FROM quake')} SELECT event_idx, rake1, rake2 FROM cmt WHERE event_idx IN (SELECT event_idx FROM main)")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = mainshocks(spark, sf_dir).where("is_main").select("event_idx")
    return cmt(spark, sf_dir).join(main, "event_idx", "left_semi").select("event_idx", F.col("planes")[0]["rake"].alias("rake1"), F.col("planes")[1]["rake"].alias("rake2"))


@query("o5_partition", f"WITH {_MAIN_SQL} SELECT count(*) AS n, count(*) FILTER (event_idx IN (SELECT event_idx FROM main)) AS main, count(*) FILTER (event_idx NOT IN (SELECT event_idx FROM main)) AS dependent FROM quake")
def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mainshocks(spark, sf_dir)
    return x.agg(F.count("*").alias("n"), F.sum(F.col("is_main").cast("long")).alias("main"), F.sum((~F.col("is_main")).cast("long")).alias("dependent"))


@query("annual_counts", f"WITH {_MAIN_SQL} SELECT year(DATE '2000-01-01' + floor(day)::INTEGER)::INTEGER AS year, count(*) AS n FROM quake WHERE event_idx IN (SELECT event_idx FROM main) GROUP BY 1")
def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_counts(mainshocks(spark, sf_dir).where("is_main"))


@query("annual_rate_check")
def annual_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersion of declustered annual counts at four thresholds; its parts have SQL twins (a27_dispersion, annual_counts)."""
    out = None
    for least in (4.0, 5.0, 5.5, 6.0):
        part = dispersion(annual_counts(mainshocks(spark, sf_dir, least).where("is_main"))).withColumn("min_magnitude", F.lit(least))
        out = part if out is None else out.unionByName(part)
    return out


_CASES = f"{QUAKE_SQL}, sel AS (SELECT * FROM quake WHERE magnitude >= 5.5 AND day BETWEEN {SPAN[0]} AND {SPAN[1]}), {cell_sql(100.0, 'sel')}, cases AS (SELECT event_idx AS stratum, day, cell, cell_lat AS lat_deg, cell_lon AS lon_deg, TRUE AS is_case, magnitude FROM celled)"
_CONTROL = "cell, lat_deg, lon_deg, FALSE AS is_case, NULL::DOUBLE AS magnitude"
_TIME = f"""{_CASES}, dated AS (SELECT *, DATE '2000-01-01' + floor(day)::INTEGER AS d FROM cases),
kept AS (SELECT *, date_diff('day', DATE '2000-01-01', date_trunc('month', d)::DATE) AS m0, date_diff('day', DATE '2000-01-01', last_day(d)) AS m1 FROM dated),
design AS (SELECT stratum, day, cell, lat_deg, lon_deg, is_case, magnitude FROM kept WHERE m0 >= {SPAN[0]} AND m1 <= {SPAN[1]}
  UNION ALL SELECT stratum, floor(day) + k * 7 + (day - floor(day)), {_CONTROL} FROM kept, range(-5, 6) r(k) WHERE m0 >= {SPAN[0]} AND m1 <= {SPAN[1]} AND k <> 0 AND floor(day) + k * 7 BETWEEN m0 AND m1)"""
_YEARS = f"""{_CASES}, dated AS (SELECT *, DATE '2000-01-01' + floor(day)::INTEGER AS d FROM cases),
blocked AS (SELECT *, (1900 + floor((year(d) - 1900) / 6.0) * 6)::INTEGER AS b0 FROM dated),
kept AS (SELECT * FROM blocked WHERE date_diff('day', DATE '2000-01-01', make_date(b0, 1, 1)) >= {SPAN[0]} AND date_diff('day', DATE '2000-01-01', make_date(b0 + 6, 1, 1)) - 1 <= {SPAN[1]}),
design AS (SELECT stratum, day, cell, lat_deg, lon_deg, is_case, magnitude FROM kept
  UNION ALL SELECT stratum, date_diff('day', DATE '2000-01-01', make_date(b0 + k::INTEGER, month(d)::INTEGER, day(d)::INTEGER)) + (k0.day - floor(k0.day)), {_CONTROL} FROM kept k0, range(0, 6) r(k)
    WHERE b0 + k <> year(d) AND NOT (month(d) = 2 AND day(d) = 29 AND (b0 + k) % 4 <> 0))"""
_ROWS = "stratum, round(day, 8) AS day, cell, round(lat_deg, 6) AS lat_deg, round(lon_deg, 6) AS lon_deg, is_case, round(magnitude, 6) AS magnitude"


def _cases(spark: SparkSession, sf_dir: str, least: float = 5.5) -> DataFrame:
    return design.cases(select_events(quake(spark, sf_dir), least), SPAN)


def time_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.time_stratified(_cases(spark, sf_dir), SPAN, 7)


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({"day": F.round("day", 8)} | {c: F.round(c, 6) for c in ("lat_deg", "lon_deg", "magnitude")}).select("stratum", "day", "cell", "lat_deg", "lon_deg", "is_case", "magnitude")


@query("d12_time_stratified", f"WITH {_TIME} SELECT {_ROWS} FROM design")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(time_design(spark, sf_dir))


@query("d13_year_stratified", f"WITH {_YEARS} SELECT {_ROWS} FROM design")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(design.year_stratified(_cases(spark, sf_dir), SPAN, 6))


def _check_drawn(d: DataFrame, k: int) -> DataFrame:
    """A stratum's controls, and whether all lie in the span and none repeats."""
    c = d.where("not is_case")
    return c.groupBy("stratum").agg(F.count("*").alias("n"), F.countDistinct("day").alias("n_distinct"), F.min(F.col("day").between(*SPAN).cast("int")).alias("inside"), F.round(F.sum("day"), 3).alias("total")).withColumn("full", F.col("n") == k)


def _cases_sql() -> str:
    return _CASES


@query("d9_day_offset")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check_drawn(design.drawn(_cases(spark, sf_dir), SPAN, "offset", 10, 60), 10)


@query("d10_window")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check_drawn(design.drawn(_cases(spark, sf_dir), SPAN, "window", 10, 30.0), 10)


@query("d11_uniform")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check_drawn(design.drawn(_cases(spark, sf_dir), SPAN, "uniform", 10), 10)


_USABLE = f"""{_TIME}, ok AS (SELECT stratum FROM design GROUP BY stratum HAVING count(*) FILTER (is_case) = 1 AND count(*) > 1 AND max(day) FILTER (is_case) < 300)"""


@query("f9_usable_strata", f"WITH {_USABLE} SELECT stratum, count(*) AS n FROM design WHERE stratum IN (SELECT stratum FROM ok) GROUP BY stratum")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.usable(time_design(spark, sf_dir), 300.0).groupBy("stratum").agg(F.count("*").alias("n"))


@query("f10_split", f"WITH {_TIME}, c AS (SELECT stratum, max(day) FILTER (is_case) + 5000 AS d FROM design GROUP BY stratum) SELECT CASE WHEN d < 3652 THEN 'train' WHEN d < 5400 THEN 'validate' ELSE 'test' END AS split, count(*) AS n FROM design JOIN c USING (stratum) GROUP BY 1")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's days are moved by 5,000 so that all three periods hold some; the sealed one is shortened to match."""
    moved = time_design(spark, sf_dir).withColumn("day", F.col("day") + 5000)
    return design.with_split(moved, test_start=5400.0).groupBy("split").agg(F.count("*").alias("n"))


def indexed(d: DataFrame) -> DataFrame:
    """row_idx: the case 0, controls from 1 in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("stratum").orderBy(F.desc("is_case"), "day")
    return d.withColumn("row_idx", (F.row_number().over(w) - 1).cast("long"))


_INDEXED = f"{_TIME}, indexed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY is_case DESC, day) - 1 AS row_idx FROM design)"


@query("f11_first_controls", f"WITH {_INDEXED} SELECT stratum, row_idx FROM indexed WHERE row_idx <= 2")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.first_controls(indexed(time_design(spark, sf_dir)), 2).select("stratum", "row_idx")


@query("f12_limit_strata", f"WITH {_TIME}, k AS (SELECT DISTINCT stratum FROM design ORDER BY stratum LIMIT 50) SELECT stratum, count(*) AS n FROM design WHERE stratum IN (SELECT stratum FROM k) GROUP BY stratum")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the first fifty strata, whole."""
    return design.limit_strata(time_design(spark, sf_dir), 50).groupBy("stratum").agg(F.count("*").alias("n"))


_MIX = mix_sql(f"stratum % {M}", 20260823)


@query("o4_sample_strata", f"WITH {_TIME}, k AS (SELECT stratum FROM (SELECT DISTINCT stratum FROM design) ORDER BY {_MIX}, stratum LIMIT 40) SELECT stratum, count(*) AS n FROM design WHERE stratum IN (SELECT stratum FROM k) GROUP BY stratum")
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: forty strata without replacement."""
    return design.sample_strata(time_design(spark, sf_dir), 40).groupBy("stratum").agg(F.count("*").alias("n"))


_LABEL = "CASE WHEN abs(rake1 - 90) < 45 THEN 'thrust' WHEN abs(rake1 + 90) < 45 THEN 'normal' ELSE 'strike-slip' END"
_LABELLED = f"""{_TIME}, lab AS (SELECT o_orderkey AS event_idx, {_LABEL} AS mech FROM (SELECT o_orderkey, (o_orderkey * 101 % 360 - 180)::DOUBLE AS rake1 FROM orders))"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmt(spark, sf_dir).select("event_idx", labels.mechanism(F.col("planes")[0]["rake"]).alias("mech"))


@query("j1_event_labels", f"WITH {CMT_SQL} SELECT event_idx, {_LABEL} AS mech FROM quake LEFT JOIN (SELECT event_idx, rake1 FROM cmt WHERE event_idx % 3 <> 0) USING (event_idx) WHERE rake1 IS NOT NULL UNION ALL SELECT event_idx, NULL FROM quake WHERE event_idx % 3 = 0")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quake(spark, sf_dir).join(_labels(spark, sf_dir).where("event_idx % 3 != 0"), "event_idx", "left").select("event_idx", "mech")


@query("j2_stratum_labels", f"WITH {_LABELLED} SELECT mech, is_case, count(*) AS n FROM design d LEFT JOIN lab ON d.stratum = lab.event_idx GROUP BY ALL")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.inherit_label(time_design(spark, sf_dir), _labels(spark, sf_dir), "mech").groupBy("mech", "is_case").agg(F.count("*").alias("n"))


@query("f8_strata_of_label", f"WITH {_LABELLED} SELECT d.stratum, count(*) AS n FROM design d JOIN lab ON d.stratum = lab.event_idx WHERE mech = 'thrust' GROUP BY 1")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = design.inherit_label(time_design(spark, sf_dir), _labels(spark, sf_dir), "mech")
    return design.of_label(x, "mech", "thrust").groupBy("stratum").agg(F.count("*").alias("n"))


@query("a7_small_strata", f"WITH {_TIME} SELECT count(*) AS n FROM (SELECT stratum FROM design GROUP BY stratum HAVING count(*) < 5)")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_design(spark, sf_dir).groupBy("stratum").count().where("count < 5").agg(F.count("*").alias("n"))


@query("w6_case_rank", f"WITH {_TIME}, c AS (SELECT stratum, day AS cd FROM design WHERE is_case) SELECT rank::INTEGER AS rank, count(*) AS n FROM (SELECT stratum, count(*) FILTER (day < cd) AS rank FROM design JOIN c USING (stratum) GROUP BY stratum) GROUP BY 1")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    case_day = F.max(F.when(F.col("is_case"), F.col("day"))).over(Window.partitionBy("stratum"))
    x = time_design(spark, sf_dir).withColumn("cd", case_day).groupBy("stratum").agg(F.sum((F.col("day") < F.col("cd")).cast("int")).cast("int").alias("rank"))
    return x.groupBy("rank").agg(F.count("*").alias("n"))


@query("k1_design_csv", f"WITH {_INDEXED} SELECT printf('%.9f', day) AS day, cell::VARCHAR AS cell, printf('%.4f', lat_deg) AS lat, printf('%.4f', lon_deg) AS lon, is_case::INTEGER::VARCHAR AS \"case\", stratum::VARCHAR AS stratum, CASE WHEN magnitude IS NULL THEN '' ELSE printf('%.2f', magnitude) END AS magnitude, '' AS mech, '' AS depthclass FROM indexed WHERE row_idx > 0")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text rows of controls, whose magnitude is blank."""
    from tremorlake.sources.sinks import design_csv

    d = time_design(spark, sf_dir).where("not is_case")
    return design_csv(d.withColumns({"mech": F.lit(None).cast("string"), "depthclass": F.lit(None).cast("string")}))


# Conditional scores. Features are exact functions of the day, so both engines agree to rounding.
_LONG = f"""{_INDEXED}, long AS (SELECT stratum, row_idx, is_case, f AS feature, CASE f WHEN 'date' THEN day WHEN 'date2' THEN day * day / 1e6 WHEN 'day_of_month' THEN day - floor(day / 30.44::DOUBLE) * 30.44::DOUBLE ELSE (stratum * 7 + row_idx * 13) % 11 END::DOUBLE AS x FROM indexed, (VALUES ('date'), ('date2'), ('day_of_month'), ('hash')) v(f)),
moments AS (SELECT feature, stratum, count(*) AS n, avg(x) AS m, var_pop(x) AS v, sum(x) AS t1, sum(x * x) AS t2, sum(x) FILTER (is_case) - avg(x) AS u FROM long GROUP BY feature, stratum),
scored AS (SELECT feature, sum(u) AS u, sum(v) AS v, sum(u) / sqrt(sum(v)) AS z, count(*) AS n_strata, greatest(sum(t2) / sum(n) - pow(sum(t1) / sum(n), 2), 0) AS total_var FROM moments GROUP BY feature)"""


def score_features() -> dict[str, F.Column]:
    d = F.col("day")
    return {"date": d, "date2": d * d / 1e6, "day_of_month": d - F.floor(d / 30.44) * 30.44, "hash": (F.col("stratum") * 7 + F.col("row_idx") * 13) % 11}


def score_matrix(spark: SparkSession, sf_dir: str) -> matrix.Matrix:
    return matrix.of(indexed(time_design(spark, sf_dir)), score_features())


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.melt(indexed(time_design(spark, sf_dir)), score_features())


@query("w1_centred", f"WITH {_LONG} SELECT l.stratum, row_idx, round(x - m, 6) + 0.0 AS d FROM long l JOIN moments USING (feature, stratum) WHERE feature = 'hash'")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = score_table(spark, sf_dir).where("feature = 'hash'")
    return long.join(scores.strata_moments(long).select("stratum", "mean"), "stratum").select("stratum", "row_idx", (F.round(F.col("x") - F.col("mean"), 6) + 0.0).alias("d"))


@query("a23_conditional_score", f"WITH {_LONG} SELECT feature, round(u, 4) AS u, round(v, 4) AS v, round(z, 5) AS z, n_strata, round(total_var, 3) AS total_var FROM scored")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.conditional_score(score_table(spark, sf_dir)).select("feature", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round("z", 5).alias("z"), "n_strata", F.round("total_var", 3).alias("total_var"))


@query("f13_testable", f"WITH {_LONG} SELECT feature, v > 1e-12 AND v / n_strata / total_var > 1e-8 AS testable FROM scored")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.conditional_score(score_table(spark, sf_dir)).select("feature", "testable")


@query("f14_active_columns", f"WITH {_LONG} SELECT feature, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS sd, stddev_pop(x) > 1e-9 AS active FROM long GROUP BY feature")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_table(spark, sf_dir).groupBy("feature").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("sd"), (F.stddev_pop("x") > 1e-9).alias("active"))


def perm_sql(n: int) -> str:
    """CTEs up to `null_z` and `maxes` over a CTE `long`, whose rows are numbered from 0 in each stratum."""
    return f"""moments AS (SELECT feature, stratum, avg(x) AS m, var_pop(x) AS v, sum(x) FILTER (is_case) - avg(x) AS u FROM long GROUP BY feature, stratum),
scored AS (SELECT feature, sum(v) AS v, sum(u) / sqrt(sum(v)) AS z FROM moments GROUP BY feature),
keys AS (SELECT stratum, count(DISTINCT row_idx) AS k, {mix_sql(f'stratum % {M}', 20260822)} AS h FROM long GROUP BY stratum),
drawn AS (SELECT stratum, k, p AS perm, (h + p) % {M} AS key FROM keys, range(1, {n + 1}) r(p)),
picks AS (SELECT stratum, perm, {mix_sql('key', 20260823)} % k AS row_idx FROM drawn),
null_z AS (SELECT perm, feature, sum(x - m) / sqrt(any_value(s.v)) AS z FROM picks JOIN long USING (stratum, row_idx) JOIN moments USING (feature, stratum) JOIN scored s USING (feature) GROUP BY perm, feature),
maxes AS (SELECT perm, max(abs(z)) AS m FROM null_z GROUP BY perm)"""


_PERM = f"""{_LONG}, keys AS (SELECT stratum, count(DISTINCT row_idx) AS k, {mix_sql(f'stratum % {M}', 20260822)} AS h FROM long GROUP BY stratum),
drawn AS (SELECT stratum, k, p AS perm, (h + p) % {M} AS key FROM keys, range(1, 41) r(p)),
picks AS (SELECT stratum, perm, {mix_sql('key', 20260823)} % k AS row_idx FROM drawn),
null_z AS (SELECT perm, feature, sum(x - m) / sqrt(any_value(s.v)) AS z FROM picks JOIN long USING (stratum, row_idx) JOIN moments USING (feature, stratum) JOIN scored s USING (feature) GROUP BY perm, feature),
maxes AS (SELECT perm, max(abs(z)) AS m FROM null_z GROUP BY perm)"""


@query("n8_permutations", f"WITH {_PERM} SELECT perm::INTEGER AS perm, feature, round(z, 5) AS z FROM null_z")
def n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = score_matrix(spark, sf_dir)
    return matrix.null(m, matrix.scan_sums(m, 40)).select("perm", "feature", F.round("z", 5).alias("z"))


@query("a25_family_wise", f"WITH {_PERM}, o AS (SELECT max(abs(z)) AS obs FROM scored) SELECT round(obs, 5) AS max_abs_z, (count(*) FILTER (m >= obs - 1e-12) + 1)::DOUBLE / (count(*) + 1) AS family_wise_p, round(quantile_cont(m, 0.95), 5) AS perm_threshold_95, round(median(m), 5) AS perm_median, count(*) AS perms FROM maxes, o GROUP BY obs")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = score_matrix(spark, sf_dir)
    sums = matrix.scan_sums(m, 40)
    out = scores.family_wise(matrix.observed(m, sums), matrix.null(m, sums))
    return out.withColumns({c: F.round(c, 5) for c in ("max_abs_z", "perm_threshold_95", "perm_median")})


@query("a26_z_spread", f"WITH {_LONG} SELECT count(*) AS n, round(avg(z), 5) AS z_mean, round(stddev_pop(z), 5) AS z_sd, count(*) FILTER (abs(z) > 2) AS over_2, count(*) FILTER (abs(z) > 3) AS over_3, count(*) FILTER (abs(z) > 4) AS over_4 FROM scored")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.z_spread(scores.conditional_score(score_table(spark, sf_dir))).select("n", F.round("z_mean", 5).alias("z_mean"), F.round("z_sd", 5).alias("z_sd"), "over_2", "over_3", "over_4")


@query("a24_effective_tests")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent tests that the permutations of the design's features amount to; the SQL integrates the normal tail."""
    m = score_matrix(spark, sf_dir)
    null = matrix.null(m, matrix.scan_sums(m, 40)).groupBy("perm").agg(F.max(F.abs("z")).alias("m")).agg(F.median("m").alias("median_max"))
    return null.select(F.round("median_max", 5).alias("median_max"), F.round(scores.effective_tests(F.col("median_max")), 2).alias("tests"))


@query("d20_calendar_diagnostics", f"""WITH {_INDEXED}, long AS (SELECT stratum, row_idx, is_case, f AS feature, CASE f WHEN 'date' THEN day WHEN 'date2' THEN pow(day / 1000, 2) WHEN 'slow_cos' THEN cos(2 * 3.141592653589793::DOUBLE * day / 181000) WHEN 'slow_sin' THEN sin(2 * 3.141592653589793::DOUBLE * day / 181000) ELSE day - floor(day / 30.44::DOUBLE) * 30.44::DOUBLE END AS x FROM indexed, (VALUES ('date'), ('date2'), ('slow_cos'), ('slow_sin'), ('day_of_month')) v(f)),
m AS (SELECT feature, stratum, var_pop(x) AS v, sum(x) FILTER (is_case) - avg(x) AS u FROM long GROUP BY ALL) SELECT feature, round(sum(u) / sqrt(sum(v)), 4) AS z FROM m GROUP BY feature""")
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.conditional_score(scores.melt(indexed(time_design(spark, sf_dir)), scores.calendar_features())).select("feature", F.round("z", 4).alias("z"))


#: Kilometres and days of each setting.
SWEEP = ((0, 0), (50, 30), (100, 30), (100, 90), (250, 180), (500, 365), (1000, 365))


@query("calendar_check")
def calendar_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five functions of the date alone, which an unbiased design must not respond to: z, and p among 99 permutations."""
    long = materialize(scores.melt(indexed(time_design(spark, sf_dir)), scores.calendar_features()), "long")
    seen = scores.conditional_score(long).select("feature", F.col("z").alias("seen"))
    ge = F.sum((F.abs("z") >= F.abs("seen") * (1 - 1e-9)).cast("int"))
    out = scores.permutations(long, 99).join(F.broadcast(seen), "feature").groupBy("feature", "seen").agg(F.round((ge + 1) / F.lit(100.0), 6).alias("p"))
    return out.select("feature", F.round("seen", 4).alias("z"), "p", (F.abs("seen") > 2).alias("suspect"))


@query("d19_thinning_sweep")
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z of the date after thinning cases at seven settings at once; thinning and score have SQL twins of their own."""
    base = materialize(indexed(time_design(spark, sf_dir)), "design")
    cases = base.where("is_case").select(F.col("stratum").alias("event_idx"), "day", "lat_deg", "lon_deg")
    kept = materialize(decluster.thin_sweep(cases, SWEEP, flat=True).withColumnRenamed("event_idx", "stratum"), "kept")
    out = None
    for i, (km, days) in enumerate(SWEEP):
        keep = kept.where(F.col("setting") == i).select("stratum")
        part = scores.conditional_score(scores.melt(base.join(keep, "stratum", "left_semi"), {"date": F.col("day")})).select(F.lit(km).alias("km"), F.lit(days).alias("days"), "n_strata", F.round("z", 4).alias("z"))
        out = part if out is None else out.unionByName(part)
    return out


# Name, mechanism and depth class of each stratum; an empty text means any.
CENSUS = (
    ("all", "", ""),
    ("thrust", "thrust", ""),
    ("normal", "normal", ""),
    ("strike-slip", "strike-slip", ""),
    ("shallow", "", "shallow"),
    ("deep", "", "deep"),
    ("shallow thrust", "thrust", "shallow"),
    ("shallow normal", "normal", "shallow"),
    ("shallow strike-slip", "strike-slip", "shallow"),
)


@query("strata_census")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent and thinned events of nine strata, the effect that each can detect, and the verdict."""
    main = mainshocks(spark, sf_dir).where("is_main").select("event_idx")
    events = cmt(spark, sf_dir).where(F.col("day").between(-8766, 9132) & (F.col("magnitude") >= 5.5)).join(main, "event_idx", "left_semi")
    events = materialize(events.select("event_idx", "day", "lat_deg", "lon_deg", labels.mechanism(F.col("planes")[0]["rake"]).alias("mech"), labels.depth_class(F.col("depth_km")).alias("depthclass")), "census")
    out = None
    for name, mech, depth in CENSUS:
        part = events.where(F.col("mech") == mech) if mech else events
        part = part.where(F.col("depthclass") == depth) if depth else part
        row = decluster.thin(part, 500, 365).agg(F.count("*").alias("declustered"), F.sum(F.col("is_main").cast("long")).alias("thinned")).withColumn("stratum", F.lit(name))
        out = row if out is None else out.unionByName(row)
    beta = 0.04 * F.sqrt(10813.0 / F.nullif(F.coalesce("thinned", F.lit(0)).cast("double"), F.lit(0.0)))
    verdict = F.when(beta <= 0.05, "fit for small effects").when(beta <= 0.12, "weak for small effects").otherwise("unfit for tests")
    return out.select("stratum", "declustered", "thinned", F.round(beta, 6).alias("beta_min"), verdict.alias("verdict"))


@query("a30_verdict", f"WITH {CMT_SQL}, g AS (SELECT (strike1::INTEGER // 5) AS sector, count(*) * 25 AS n FROM cmt GROUP BY 1) SELECT sector, n, round(0.04 * sqrt(10813.0::DOUBLE / n), 6) AS beta_min, CASE WHEN 0.04 * sqrt(10813.0::DOUBLE / n) <= 0.05 THEN 'fit for small effects' WHEN 0.04 * sqrt(10813.0::DOUBLE / n) <= 0.12 THEN 'weak for small effects' ELSE 'unfit for tests' END AS verdict FROM g")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census verdict on 25 times the events of each sector of strike."""
    beta = 0.04 * F.sqrt(10813.0 / F.col("n"))
    x = cmt(spark, sf_dir).groupBy(F.floor(F.col("planes")[0]["strike"] / 5).cast("int").alias("sector")).agg((F.count("*") * 25).alias("n"))
    return x.withColumns({"beta_min": F.round(beta, 6), "verdict": F.when(beta <= 0.05, "fit for small effects").when(beta <= 0.12, "weak for small effects").otherwise("unfit for tests")})


@query("inspect")
def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory at five thresholds: events, independent ones, occupied cells, size of a design with ten controls."""
    from tremorlake.functions.geo import Grid

    out = None
    for least in (4.0, 4.5, 5.0, 5.5, 6.0):
        x = Grid(100.0).cell_of(mainshocks(spark, sf_dir, least))
        row = x.agg(F.lit(least).alias("min_magnitude"), F.count("*").alias("events"), F.sum(F.col("is_main").cast("long")).alias("independent"), F.countDistinct(F.when(F.col("is_main"), F.col("cell"))).alias("cells"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("design_bytes", F.col("independent") * (11 * 9816 * 4))


@query("score_scan_stream")
def score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinned strata, conditional scores, permutation null, and the report of one row with its top features."""
    from tremorlake.sources.sinks import scan_report

    base = materialize(design.usable(indexed(time_design(spark, sf_dir))), "design")
    cases = base.where("is_case").select(F.col("stratum").alias("event_idx"), "day", "lat_deg", "lon_deg")
    keep = decluster.thin(cases, 100, 90, flat=True).where("is_main").select(F.col("event_idx").alias("stratum"))
    m = matrix.of(base.join(keep, "stratum", "left_semi"), score_features())
    sums = matrix.scan_sums(m, 200)
    seen = matrix.observed(m, sums)
    summary = scores.family_wise(seen, matrix.null(m, sums)).crossJoin(scores.z_spread(seen))
    return scan_report(summary, seen.where("testable").orderBy(F.desc(F.abs("z"))).limit(200))


@query("d21_planted")
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after a planted effect of one feature, at several strengths, and after a shuffle of the labels."""
    base = materialize(indexed(time_design(spark, sf_dir)).withColumn("hash", ((F.col("stratum") * 7 + F.col("row_idx") * 13) % 11).cast("double")), "design")
    out = None
    for beta in (0.0, 0.25, 0.5, 1.0):
        d = design.plant(base, "hash", beta) if beta else design.shuffle_labels(base)
        part = scores.conditional_score(scores.melt(d, {"hash": F.col("hash")})).select(F.lit(beta).alias("beta"), "n_strata", F.round("z", 4).alias("z"))
        out = part if out is None else out.unionByName(part)
    return out
