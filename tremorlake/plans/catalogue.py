"""Filters, counts and labels over catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import labels
from tremorlake.functions.geo import Grid
from tremorlake.functions.time import checked_day, civil_day, date_of, year_of
from tremorlake.operators.circular import ensemble_sigma
from tremorlake.operators.tables import equal_count_bins
from tremorlake.plans.fixtures import CMT_SQL, QUAKE_SQL, TREMOR_SQL, cmt, quake, tremor
from tremorlake.plans.registry import query


def select_events(quakes: DataFrame, min_magnitude: float, max_depth: float | None = None) -> DataFrame:
    """Magnitude at least the minimum (null is dropped), depth at most the maximum, if one is given."""
    out = quakes.where(F.col("magnitude") >= min_magnitude)
    return out if max_depth is None else out.where(F.col("depth_km") <= max_depth)


def common_event(df: DataFrame, name: str) -> DataFrame:
    """Any catalogue in the shape all share: name, day and nullable place, depth and magnitude."""
    get = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.select(F.lit(name).alias("name"), "day", *[get(c).alias(c) for c in ("lat_deg", "lon_deg", "depth_km", "magnitude")])


def decadal_counts(quakes: DataFrame, min_magnitude: float, start_year: int, decades: int) -> DataFrame:
    """Counts in bins of 3652.5 days from a year's beginning; empty ones are 0."""
    d0 = F.datediff(F.make_date(F.lit(start_year), F.lit(1), F.lit(1)), F.lit("2000-01-01").cast("date")).cast("double")
    counts = quakes.where(F.col("magnitude") >= min_magnitude).groupBy(F.floor((F.col("day") - d0) / 3652.5).cast("int").alias("decade")).agg(F.count("*").alias("c"))
    return quakes.sparkSession.range(decades).select(F.col("id").cast("int").alias("decade")).join(F.broadcast(counts), "decade", "left").select("decade", F.coalesce("c", F.lit(0)).alias("n"))


def annual_counts(quakes: DataFrame) -> DataFrame:
    return quakes.groupBy(year_of(F.col("day")).alias("year")).agg(F.count("*").alias("n"))


def with_empty_years(counts: DataFrame, first: int, last: int) -> DataFrame:
    years = counts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(F.broadcast(counts), "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def family_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family")


def mean_location(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.avg("lat_deg").alias("lat"), F.avg("lon_deg").alias("lon"), F.count("*").alias("n"))


def grid_bands_sql(km: float) -> str:
    g = Grid(km)
    first, rows = 0, []
    for b, n in enumerate(g.n_lon):
        rows.append(f"({b}, {n}, {first})")
        first += n
    return f"bands(band, n_lon, first_cell) AS (VALUES {', '.join(rows)})"


def cell_sql(km: float, source: str = "quake") -> str:
    """CTEs `bands` and `celled`: rows with their cell and its centre."""
    h = Grid(km).height
    return f"""{grid_bands_sql(km)}, turned AS (
  SELECT *, least(greatest(floor((radians(lat_deg) + pi() / 2) / {h!r}::DOUBLE), 0), {Grid(km).bands - 1})::INTEGER AS band, lon_deg / 360 - trunc(lon_deg / 360) AS t0 FROM {source}),
celled AS (
  SELECT q.* EXCLUDE (t0, band), b.first_cell + c AS cell, degrees(-pi() / 2 + (q.band + 0.5::DOUBLE) * {h!r}::DOUBLE) AS cell_lat,
    CASE WHEN (c + 0.5::DOUBLE) / n_lon * 360 > 180 THEN (c + 0.5::DOUBLE) / n_lon * 360 - 360 ELSE (c + 0.5::DOUBLE) / n_lon * 360 END AS cell_lon
  FROM turned q JOIN bands b USING (band), LATERAL (SELECT least(floor((CASE WHEN t0 < 0 THEN t0 + 1 ELSE t0 END) * n_lon), n_lon - 1)::BIGINT AS c) z)"""


@query("f1_select", f"WITH {QUAKE_SQL} SELECT event_idx, day, magnitude, depth_km FROM quake WHERE magnitude >= 5.5 AND depth_km <= 70")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_events(quake(spark, sf_dir), 5.5, 70.0).select("event_idx", "day", "magnitude", "depth_km").orderBy("day")


@query("f2_class_nest", "SELECT user_id AS nest, count(*) AS n FROM events WHERE event_type = 'error' AND user_id % 7 = 3 GROUP BY user_id")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one class and of some nests, counted by nest."""
    from tremorlake.plans.fixtures import load

    e = load(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("user_id") % 7 == 3))
    return e.groupBy(F.col("user_id").alias("nest")).agg(F.count("*").alias("n"))


@query("f3_latitude_band", f"WITH {TREMOR_SQL} SELECT event_idx, lat_deg FROM tremor WHERE lat_deg >= 41 AND lat_deg < 44")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tremor(spark, sf_dir).where((F.col("lat_deg") >= 41) & (F.col("lat_deg") < 44)).select("event_idx", "lat_deg")


@query("f4_family", f"WITH {TREMOR_SQL} SELECT event_idx, day FROM tremor WHERE family = 'F03'")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tremor(spark, sf_dir).where(F.col("family") == "F03").select("event_idx", "day")


@query("f5_common_event", f"WITH {QUAKE_SQL}, {TREMOR_SQL} SELECT 'quake' AS name, day, lat_deg, lon_deg, depth_km, magnitude FROM quake UNION ALL SELECT 'tremor', day, lat_deg, lon_deg, NULL, magnitude FROM tremor")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_event(quake(spark, sf_dir), "quake").unionByName(common_event(tremor(spark, sf_dir), "tremor"))


@query("f6_day_range", f"WITH {QUAKE_SQL} SELECT event_idx, day FROM quake WHERE day BETWEEN -8766 AND 9132 AND magnitude >= 5.5")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quake(spark, sf_dir).where(F.col("day").between(-8766, 9132) & (F.col("magnitude") >= 5.5)).select("event_idx", "day")


@query("f7_finite", f"WITH {TREMOR_SQL} SELECT count(*) AS n, count(magnitude) AS finite FROM tremor")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tremor(spark, sf_dir)
    return t.agg(F.count("*").alias("n"), F.sum((F.col("magnitude").isNotNull() & ~F.isnan("magnitude")).cast("long")).alias("finite"))


@query("f15_near_resonant", f"WITH {QUAKE_SQL}, o AS (SELECT event_idx, floor(day)::INTEGER + 2221 AS k FROM quake) SELECT event_idx, k AS offset_days, (abs(round(k / 27.555::DOUBLE) * 27.555::DOUBLE - k) < 2 OR abs(round(k / 29.531::DOUBLE) * 29.531::DOUBLE - k) < 2) AS resonant FROM o")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days between each event and a month before the span: near a multiple of a lunar month?"""
    days = (F.floor("day") + 2221).cast("int")
    return quake(spark, sf_dir).select("event_idx", days.alias("offset_days"), labels.near_resonant(days.cast("double")).alias("resonant"))


@query("a1_span", f"WITH {QUAKE_SQL} SELECT min(day) AS first_day, max(day) AS last_day FROM quake")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quake(spark, sf_dir).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("a2_family_counts", f"WITH {TREMOR_SQL} SELECT family, count(*) AS n FROM tremor GROUP BY family")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_counts(tremor(spark, sf_dir))


@query("a3_mean_location", f"WITH {TREMOR_SQL} SELECT family, round(avg(lat_deg), 6) AS lat, round(avg(lon_deg), 6) AS lon, count(*) AS n FROM tremor GROUP BY family")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_location(tremor(spark, sf_dir), ["family"]).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query("a4_decadal_counts", f"WITH {QUAKE_SQL} SELECT d::INTEGER AS decade, count(event_idx) AS n FROM range(0, 5) t(d) LEFT JOIN quake ON magnitude >= 5 AND day >= date_diff('day', DATE '2000-01-01', DATE '1970-01-01') + d * 3652.5::DOUBLE AND day < date_diff('day', DATE '2000-01-01', DATE '1970-01-01') + (d + 1) * 3652.5::DOUBLE GROUP BY d")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decadal_counts(quake(spark, sf_dir), 5.0, 1970, 5)


_YEAR = "year(DATE '2000-01-01' + floor(day)::INTEGER)"


@query("a5_annual_counts", f"WITH {QUAKE_SQL} SELECT {_YEAR}::INTEGER AS year, count(*) AS n FROM quake GROUP BY 1")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_counts(quake(spark, sf_dir))


@query("a5_annual_counts_all_years", f"WITH {QUAKE_SQL}, c AS (SELECT {_YEAR} AS year, count(*) AS n FROM quake GROUP BY 1) SELECT y::INTEGER AS year, coalesce(n, 0) AS n FROM range(1990, 2006) t(y) LEFT JOIN c ON c.year = y")
def a5_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_empty_years(annual_counts(quake(spark, sf_dir)), 1990, 2005)


@query("a6_occupied_cells", f"WITH {QUAKE_SQL}, {cell_sql(100.0)} SELECT count(DISTINCT cell) AS occupied, count(*) AS events, round(count(*)::DOUBLE / count(DISTINCT cell), 6) AS per_cell FROM celled")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Grid(100.0).cell_of(quake(spark, sf_dir)).agg(F.countDistinct("cell").alias("occupied"), F.count("*").alias("events"), F.round(F.count("*") / F.countDistinct("cell"), 6).alias("per_cell"))


@query("d4_grid_bands")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's bands, their cells' area, and the events in each."""
    g = Grid(100.0)
    cells = g.cell_of(quake(spark, sf_dir)).groupBy("cell").agg(F.count("*").alias("c"))
    bands = g.table(spark).withColumn("area_km2", F.round(g.area_km2(F.col("band"), F.col("n_lon")), 3))
    held = cells.join(F.broadcast(bands), (F.col("cell") >= F.col("first")) & (F.col("cell") < F.col("first") + F.col("n_lon"))).groupBy("band").agg(F.sum("c").alias("events"))
    return bands.join(held, "band", "left").withColumn("events", F.coalesce("events", F.lit(0)).cast("long"))


@query("d5_cells", f"WITH {QUAKE_SQL}, {cell_sql(100.0)} SELECT event_idx, cell, round(cell_lat, 6) AS cell_lat, round(cell_lon, 6) AS cell_lon FROM celled")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Grid(100.0).cell_of(quake(spark, sf_dir)).select("event_idx", "cell", F.round("cell_lat", 6).alias("cell_lat"), F.round("cell_lon", 6).alias("cell_lon"))


@query("d2_windows", f"WITH {QUAKE_SQL} SELECT event_idx, round(pow(10, 0.1238 * magnitude + 0.983), 6) AS km, round(CASE WHEN magnitude >= 6.5 THEN pow(10, 0.032 * magnitude + 2.7389) ELSE pow(10, 0.5409 * magnitude - 0.547) END, 6) AS days FROM quake")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremorlake.functions.geo import window_days, window_km

    return quake(spark, sf_dir).select("event_idx", F.round(window_km(F.col("magnitude")), 6).alias("km"), F.round(window_days(F.col("magnitude")), 6).alias("days"))


@query("d3_distance", f"WITH {QUAKE_SQL} SELECT event_idx, round(2 * 6371.0 * asin(least(sqrt(pow(sin(radians(10 - lat_deg) / 2), 2) + cos(radians(lat_deg)) * cos(radians(10.0::DOUBLE)) * pow(sin(radians(20 - lon_deg) / 2), 2)), 1.0)), 5) AS km FROM quake")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremorlake.functions.geo import distance_km

    return quake(spark, sf_dir).select("event_idx", F.round(distance_km(F.col("lat_deg"), F.col("lon_deg"), F.lit(10.0), F.lit(20.0)), 5).alias("km"))


@query("d8_dates", f"WITH {QUAKE_SQL} SELECT event_idx, year(d)::INTEGER AS y, month(d)::INTEGER AS m, day(d)::INTEGER AS dd, date_diff('day', DATE '2000-01-01', date_trunc('month', d)::DATE)::DOUBLE + 30 AS day31, CASE WHEN month(d) IN (1, 3, 5, 7, 8, 10, 12) THEN date_diff('day', DATE '2000-01-01', date_trunc('month', d)::DATE)::DOUBLE + 30 END AS real31 FROM (SELECT event_idx, DATE '2000-01-01' + floor(day)::INTEGER AS d FROM quake)")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quake(spark, sf_dir).withColumn("d", date_of(F.col("day")))
    y, m = F.year("d"), F.month("d")
    return x.select("event_idx", y.alias("y"), m.alias("m"), F.day("d").alias("dd"), civil_day(y, m, F.lit(31)).alias("day31"), checked_day(y, m, F.lit(31)).alias("real31"))


@query("d15_mechanism", f"WITH {CMT_SQL} SELECT CASE WHEN abs(rake1 - 90) < 45 THEN 'thrust' WHEN abs(rake1 + 90) < 45 THEN 'normal' ELSE 'strike-slip' END AS mech, CASE WHEN depth_km < 70 THEN 'shallow' ELSE 'deep' END AS depthclass, count(*) AS n FROM cmt GROUP BY ALL")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmt(spark, sf_dir).groupBy(labels.mechanism(F.col("planes")[0]["rake"]).alias("mech"), labels.depth_class(F.col("depth_km")).alias("depthclass")).agg(F.count("*").alias("n"))


@query("d16_depth_edges", f"WITH {QUAKE_SQL} SELECT count(*) FILTER (depth_km < 70) AS under, count(*) FILTER (depth_km <= 70) AS at_most FROM quake")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("depth_km")
    return quake(spark, sf_dir).agg(F.sum((labels.depth_class(d) == "shallow").cast("long")).alias("under"), F.sum((labels.depth_class(d, inclusive=True) == "shallow").cast("long")).alias("at_most"))


@query("d24_wrap", f"WITH {CMT_SQL}, a AS (SELECT event_idx, (2 * (rake1 - strike1))::INTEGER AS k FROM cmt), w AS (SELECT *, ((k % 360) + 360) % 360 AS w FROM a) SELECT event_idx, k AS angle, (CASE WHEN w > 180 THEN w - 360 ELSE w END)::DOUBLE AS wrapped, (CASE WHEN k % 360 > 180 THEN k % 360 - 360 WHEN k % 360 < -180 THEN k % 360 + 360 ELSE k % 360 END)::DOUBLE AS norm FROM w")
def d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both edge rules, on twice the difference of a plane's rake and strike."""
    from tremorlake.operators.circular import norm180

    p = F.col("planes")[0]
    x = 2 * (p["rake"] - p["strike"])
    return cmt(spark, sf_dir).select("event_idx", x.cast("int").alias("angle"), labels.wrap180(x).alias("wrapped"), norm180(x).alias("norm"))


@query("d25_beats", f"WITH {QUAKE_SQL} SELECT event_idx, round(1 / abs(1.0::DOUBLE / (10 + event_idx % 20) - 1.0::DOUBLE / (30 + event_idx % 7)), 6) AS beat FROM quake")
def d25(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_idx")
    return quake(spark, sf_dir).select("event_idx", F.round(labels.beat_period((10 + k % 20).cast("double"), (30 + k % 7).cast("double")), 6).alias("beat"))


@query("w3_equal_count_bins", f"""WITH {TREMOR_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY magnitude, event_idx) AS rn, count(*) OVER () AS n FROM tremor WHERE magnitude IS NOT NULL)
SELECT least((rn - 1) // (n // 5), 4)::INTEGER AS bin, count(*) AS n, min(magnitude) AS low, max(magnitude) AS high FROM r GROUP BY 1""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_count_bins(tremor(spark, sf_dir).where("magnitude is not null"), F.col("magnitude"), 5, F.col("event_idx")).groupBy("bin").agg(F.count("*").alias("n"), F.min("magnitude").alias("low"), F.max("magnitude").alias("high"))


@query("w4_fixed_edges", f"WITH {TREMOR_SQL} SELECT ((magnitude >= 2)::INTEGER + (magnitude >= 5)::INTEGER + (magnitude >= 10)::INTEGER) AS bin, count(*) AS n FROM tremor WHERE magnitude IS NOT NULL GROUP BY 1")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array(*map(F.lit, (2.0, 5.0, 10.0)))
    return tremor(spark, sf_dir).where("magnitude is not null").groupBy(F.size(F.filter(edges, lambda e: e <= F.col("magnitude"))).alias("bin")).agg(F.count("*").alias("n"))


@query("a27_dispersion", f"WITH {QUAKE_SQL}, c AS (SELECT {_YEAR} AS year, count(*)::DOUBLE AS n FROM quake WHERE magnitude >= 5 GROUP BY 1) SELECT round(var_samp(n) / avg(n), 6) AS ratio, round(sum((n - m) * (n - m)) / any_value(m), 6) AS chi2, count(*) - 1 AS df, round(corr(year, n), 6) AS trend_r FROM c, (SELECT avg(n) AS m FROM c)")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispersion(annual_counts(select_events(quake(spark, sf_dir), 5.0))).select("ratio", "chi2", "df", "trend_r")


def dispersion(counts: DataFrame) -> DataFrame:
    """Annual counts -> variance over mean (sample variance), chi2 against a constant rate, df, its tail, trend."""
    from tremorlake.functions.distributions import chi2_sf

    n = F.col("n").cast("double")
    out = counts.agg(F.round(F.var_samp(n) / F.avg(n), 6).alias("ratio"), F.round((F.count("*") - 1) * F.var_samp(n) / F.avg(n), 6).alias("chi2"), (F.count("*") - 1).alias("df"), F.round(F.corr(F.col("year").cast("double"), n), 6).alias("trend_r"))
    return out.withColumn("p", F.round(chi2_sf(F.col("chi2"), F.col("df")), 4))


@query("a19_loglog_slope", f"WITH {TREMOR_SQL}, b AS (SELECT family, count(*)::DOUBLE AS n, avg(magnitude) AS a FROM tremor GROUP BY family) SELECT round(regr_slope(ln(n), ln(a)), 5) AS slope FROM b")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremorlake.operators.circular import loglog_slope

    b = tremor(spark, sf_dir).groupBy("family").agg(F.count("*").cast("double").alias("n"), F.avg("magnitude").alias("a"))
    return loglog_slope(b, "a", "n").select(F.round("slope", 5).alias("slope"))


@query("a20_correlation", f"WITH {TREMOR_SQL} SELECT round(corr(magnitude, lat_deg), 6) AS r FROM tremor")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tremor(spark, sf_dir).agg(F.round(F.corr("magnitude", "lat_deg"), 6).alias("r"))


@query("a16_ensemble_sigma", f"WITH {TREMOR_SQL} SELECT family, count(*) FILTER (magnitude > 100) AS hits, count(*) AS n, round((count(*) FILTER (magnitude > 100) - 0.05::DOUBLE * count(*)) / sqrt(count(*) * 0.05::DOUBLE * 0.95::DOUBLE), 6) AS sigma FROM tremor GROUP BY family")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong events of each family against a share of 5 %."""
    x = tremor(spark, sf_dir).groupBy("family").agg(F.count_if(F.col("magnitude") > 100).alias("hits"), F.count("*").alias("n"))
    return x.withColumn("sigma", F.round(ensemble_sigma(F.col("hits"), F.col("n").cast("double")), 6))


@query("a21_sign_test", f"WITH {TREMOR_SQL}, g AS (SELECT event_idx // 6 AS six, count(*) FILTER (magnitude > 30) AS hits FROM tremor GROUP BY 1 HAVING count(*) = 6) SELECT six, hits, round((SELECT sum(c) FROM (VALUES (0, 1), (1, 6), (2, 15), (3, 20), (4, 15), (5, 6), (6, 1)) b(i, c) WHERE i >= hits) / 64.0, 6)::DOUBLE AS tail FROM g")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixes of events in a row: how many exceed a strength, and the chance of as many."""
    x = tremor(spark, sf_dir).groupBy(F.floor(F.col("event_idx") / 6).alias("six")).agg(F.count_if(F.col("magnitude") > 30).alias("hits"), F.count("*").alias("n")).where("n = 6")
    return x.select("six", "hits", F.round(binomial_tail(F.col("hits"), 6), 6).alias("tail"))


def binomial_tail(k: F.Column, n: int) -> F.Column:
    """P(X >= k) of n fair draws."""
    from math import comb

    return sum((F.when(k <= i, comb(n, i) / 2**n).otherwise(0.0) for i in range(n + 1)), F.lit(0.0))


@query("a31_design_size", f"WITH {QUAKE_SQL} SELECT m AS min_magnitude, count(event_idx) AS n, count(event_idx) * 11 * 9816 * 4 AS bytes FROM (VALUES (4.0::DOUBLE), (4.5), (5.0), (5.5), (6.0)) t(m) LEFT JOIN quake ON magnitude >= m GROUP BY m")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a design with ten controls, of 9,816 features of four bytes, at each threshold."""
    m = spark.createDataFrame([(x,) for x in (4.0, 4.5, 5.0, 5.5, 6.0)], "min_magnitude double")
    x = F.broadcast(m).join(quake(spark, sf_dir), F.col("magnitude") >= F.col("min_magnitude"), "left")
    return x.groupBy("min_magnitude").agg(F.count("event_idx").alias("n")).withColumn("bytes", F.col("n") * (11 * 9816 * 4))


@query("o2_precedence", f"WITH {QUAKE_SQL} SELECT event_idx, row_number() OVER (ORDER BY magnitude DESC, day, event_idx) AS rank FROM quake")
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremorlake.operators.tables import numbered

    return numbered(quake(spark, sf_dir), F.desc("magnitude"), F.asc("day"), F.asc("event_idx"), name="rank").select("event_idx", F.col("rank").cast("long").alias("rank"))


@query("o3_top_families", f"WITH {TREMOR_SQL} SELECT family, count(*) AS n FROM tremor GROUP BY family ORDER BY n DESC, family LIMIT 5")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return family_counts(tremor(spark, sf_dir)).limit(5)


@query("k5_year_lines", f"WITH {QUAKE_SQL} SELECT {_YEAR}::VARCHAR || ' ' || count(*)::VARCHAR AS value FROM quake GROUP BY {_YEAR}")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremorlake.sources.sinks import year_counts_text

    return year_counts_text(annual_counts(quake(spark, sf_dir)))
