"""Readers over raw text rows that are made from the tables, with malformed rows among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.plans.fixtures import load
from tremorlake.plans.registry import query
from tremorlake.sources import catalogues

_RAW = """
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderkey * 7919 % 86400 AS s FROM orders"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") * 7919 % 86400).alias("s"))


def _two(x: F.Column) -> F.Column:
    return F.lpad(x.cast("long").cast("string"), 2, "0")


def _clock() -> tuple[F.Column, F.Column, F.Column]:
    return _two(F.floor(F.col("s") / 3600)), _two(F.floor(F.col("s") / 60) % 60), _two(F.col("s") % 60)


@query(
    "s1_comcat_scan",
    f"""WITH r AS ({_RAW})
SELECT CAST(date_diff('day', DATE '2000-01-01', d) AS DOUBLE) + (CAST(s // 3600 AS DOUBLE) * 3600 + CAST(s // 60 % 60 AS DOUBLE) * 60 + CASE WHEN k % 11 = 0 THEN 60.0::DOUBLE ELSE CAST(s % 60 AS DOUBLE) + 0.5::DOUBLE END) / 86400 AS day,
  CAST(c % 180 - 90 AS DOUBLE) AS lat_deg, CAST(c % 360 - 180 AS DOUBLE) AS lon_deg,
  CASE WHEN k % 5 <> 0 THEN CAST(k % 700 AS DOUBLE) END AS depth_km, CASE WHEN k % 7 <> 0 THEN CAST(k % 8 AS DOUBLE) END AS magnitude
FROM r WHERE k % 17 <> 0 AND k % 23 <> 0 AND k % 29 <> 0""",
)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with a bad month, no time at all, leap seconds, blank depths and magnitudes (one way to write NaN)."""
    h, m, s = _clock()
    date = F.when(F.col("k") % 17 == 0, "2010-13-01").otherwise(F.col("d").cast("string"))
    time = F.when(F.col("k") % 23 == 0, "n/a").otherwise(F.concat(date, F.lit("T"), h, F.lit(":"), m, F.lit(":"), F.when(F.col("k") % 11 == 0, "60").otherwise(F.concat(s, F.lit(".500"))), F.lit("Z")))
    text = lambda x: x.cast("string")
    raw = _raw(spark, sf_dir).select(time.alias("time"), F.when(F.col("k") % 29 == 0, "bad").otherwise(text(F.col("c") % 180 - 90)).alias("latitude"), text(F.col("c") % 360 - 180).alias("longitude"), F.when(F.col("k") % 5 == 0, "").otherwise(text(F.col("k") % 700)).alias("depth"), F.when(F.col("k") % 7 == 0, F.when(F.col("k") % 2 == 0, "NaN").otherwise(" ")).otherwise(text(F.col("k") % 8)).alias("mag"))
    return catalogues.comcat(raw)


@query(
    "s2_iso_times",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) + (hour(ts) * 3600.0::DOUBLE + minute(ts) * 60 + CASE WHEN event_id % 5 = 0 THEN 0 ELSE second(ts) END) / 86400 END AS day FROM events""",
)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as text, some without seconds, some with a thirteenth month, some no time at all."""
    from tremorlake.functions.time import iso_day

    k = F.col("event_id")
    text = F.when(k % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    text = F.when(k % 11 == 0, "nonsense").when(k % 7 == 0, F.concat(F.date_format("ts", "yyyy"), F.lit("-13-01T00:00:00Z"))).otherwise(text)
    return load(spark, sf_dir, "events").select("event_id", iso_day(text).alias("day"))


@query(
    "s3_ndk_scan",
    f"""WITH r AS ({_RAW})
SELECT CAST(date_diff('day', DATE '2000-01-01', d) AS DOUBLE) + (CAST(s // 3600 AS DOUBLE) * 3600 + CAST(s // 60 % 60 AS DOUBLE) * 60 + CAST(s % 60 AS DOUBLE) + 29.5::DOUBLE) / 86400 AS day,
  CAST(c % 180 - 90 AS DOUBLE) AS lat_deg, CAST(c % 360 - 180 AS DOUBLE) AS lon_deg, CAST(k % 700 AS DOUBLE) AS depth_km,
  round((log10(CAST(1 + k % 9 AS DOUBLE) * pow(10.0::DOUBLE, CAST(22 + k % 5 AS DOUBLE))) - 16.1::DOUBLE) * (2.0::DOUBLE / 3.0::DOUBLE), 6) AS mw,
  CAST(k % 360 AS DOUBLE) AS strike1, CAST(k % 90 AS DOUBLE) AS dip1, CAST(k % 360 - 180 AS DOUBLE) AS rake1, CAST(c % 360 AS DOUBLE) AS strike2
FROM r WHERE k % 31 <> 0 AND k % 37 <> 0""",
)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines an event in 64 sources, blank lines among them; wrong centroid lines and zero moments are skipped."""
    h, m, s = _clock()
    text = lambda x: x.cast("string")
    k, c = F.col("k"), F.col("c")
    lines = F.array(
        F.concat_ws(" ", F.lit("PDEW"), F.date_format("d", "yyyy/MM/dd"), F.concat_ws(":", h, m, s), F.lit("37.4 137.2 10.0 0.0 7.5 SOMEWHERE")),
        F.lit("C2024 B:169 463 50"),
        F.concat_ws(" ", F.when(k % 31 == 0, "LOST:").otherwise("CENTROID:"), F.lit("29.5 0.1"), text(c % 180 - 90), F.lit("0.00"), text(c % 360 - 180), F.lit("0.00"), text(k % 700), F.lit("0.0 FIX")),
        F.concat_ws(" ", text(22 + k % 5), F.lit("2.260 0.004 -0.755 0.004 -1.500 0.004 -0.436 0.044 -0.441 0.041 -1.300 0.003")),
        F.concat_ws(" ", F.lit("V10 2.342 82 144 0.222 2 38 -2.558 7 307"), F.when(k % 37 == 0, "0.0").otherwise(text(1 + k % 9)), text(k % 360), text(k % 90), text(k % 360 - 180), text(c % 360), F.lit("52 93")),
        F.lit("  "),
    )
    raw = _raw(spark, sf_dir).select((k % 64).alias("source"), k, F.posexplode(lines).alias("i", "value"))
    out = catalogues.ndk(raw.select("source", (F.col("k") * 6 + F.col("i")).alias("line_no"), "value"))
    p, q = F.col("planes")[0], F.col("planes")[1]
    return out.select("day", "lat_deg", "lon_deg", "depth_km", F.round("mw", 6).alias("mw"), p["strike"].alias("strike1"), p["dip"].alias("dip1"), p["rake"].alias("rake1"), q["strike"].alias("strike2"))


@query(
    "s5_parkfield_scan",
    f"""WITH r AS ({_RAW})
SELECT CAST(date_diff('day', DATE '2000-01-01', CAST(date_trunc('month', d) AS DATE)) + k % 31 AS DOUBLE) + CAST(s AS DOUBLE) / 86400 AS day, 'f' || (c % 10)::VARCHAR AS family,
  35.5::DOUBLE AS lat_deg, CAST(c % 360 - 180 AS DOUBLE) AS lon_deg, CAST(k % 30 AS DOUBLE) AS depth_km, CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(k % 3 AS DOUBLE) END AS ccsum
FROM r WHERE k % 13 <> 0""",
)
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day 31 of short months rolls over; a missing sum counts as 0."""
    text = lambda x: x.cast("string")
    k, c = F.col("k"), F.col("c")
    raw = _raw(spark, sf_dir).select(text(F.year("d")).alias("year"), text(F.month("d")).alias("month"), text(k % 31 + 1).alias("day"), F.when(k % 13 == 0, "x").otherwise(text(F.col("s"))).alias("s_of_day"), F.when(k % 4 == 0, "").otherwise(text(k % 3)).alias("ccsum"), F.concat(F.lit("f"), text(c % 10)).alias("ID"), F.lit("35.5").alias("latitude"), text(c % 360 - 180).alias("longitude"), text(k % 30).alias("depth"))
    return catalogues.parkfield(raw)


@query(
    "s6_cascadia_scan",
    f"""WITH r AS ({_RAW})
SELECT CAST(date_diff('day', DATE '2000-01-01', d) AS DOUBLE) + (CAST(s // 3600 AS DOUBLE) * 3600 + CAST(s // 60 % 60 AS DOUBLE) * 60 + CAST(s % 60 AS DOUBLE)) / 86400 AS day,
  48.25::DOUBLE AS lat_deg, CAST(c % 360 - 180 AS DOUBLE) AS lon_deg, 35.0::DOUBLE AS depth_km, CASE WHEN k % 6 <> 0 THEN CAST(k % 3 AS DOUBLE) END AS magnitude, NULL::DOUBLE AS num_stas
FROM r WHERE k % 19 <> 0""",
)
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail dates with a comma; blank magnitudes are null, not 0."""
    h, m, s = _clock()
    k = F.col("k")
    stamp = F.concat(F.date_format("d", "EEE, dd MMM yyyy "), F.concat_ws(":", h, m, s))
    raw = _raw(spark, sf_dir).select(F.when(k % 19 == 0, "Mon, 01 Foo 2018 00:00:00").otherwise(stamp).alias("time_iso"), F.lit("48.25").alias("lat"), (F.col("c") % 360 - 180).cast("string").alias("lon"), F.lit("35").alias("depth_km"), F.when(k % 6 == 0, "").otherwise((k % 3).cast("string")).alias("magnitude"), F.lit("").alias("num_stas"))
    return catalogues.cascadia(raw)


@query(
    "s8_apollo_scan",
    f"""WITH r AS ({_RAW})
SELECT CAST(date_diff('day', DATE '1969-01-01', make_date(1969 + k % 9, 1, 1)) + c % 300 AS DOUBLE) + CAST(k % 24 + (k % 60)::DOUBLE / 60 AS DOUBLE) / 24 AS day,
  CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'H' END AS class, CASE WHEN k % 3 = 0 THEN (c % 100)::INTEGER END AS nest
FROM r WHERE k % 41 <> 0""",
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years 69 to 77; other years are dropped, a blank nest is null."""
    k, c = F.col("k"), F.col("c")
    text = lambda x: x.cast("string")
    raw = _raw(spark, sf_dir).select(F.when(k % 41 == 0, "78").otherwise(text(69 + k % 9)).alias("Y"), text(c % 300 + 1).alias("JD"), text(k % 24 * 100 + k % 60).alias("S"), F.element_at(F.array(F.lit("A"), F.lit("C"), F.lit("H")), (k % 3 + 1).cast("int")).alias("T2"), F.when(k % 3 == 0, text(c % 100)).otherwise("").alias("N2"))
    return catalogues.apollo(raw)


@query("s9_nests", f"WITH r AS ({_RAW}) SELECT (c % 300)::INTEGER AS nest, ((c % 180) - 90)::DOUBLE + 0.25::DOUBLE AS lat_deg, ((c % 360) - 180)::DOUBLE AS lon_deg, (k % 1000)::DOUBLE AS depth_km, k % 3 <> 0 AS assumed FROM r WHERE k % 13 <> 0")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nest rows as text; an id that is no number drops the row, Y and y mean assumed."""
    k, c = F.col("k"), F.col("c")
    text = lambda x: x.cast("string")
    assumed = F.when(k % 3 == 0, "N").when(k % 3 == 1, "y").otherwise(" Y")
    raw = _raw(spark, sf_dir).select(F.when(k % 13 == 0, "x").otherwise(text(c % 300)).alias("A"), text((c % 180 - 90).cast("double") + 0.25).alias("Lat"), text(c % 360 - 180).alias("Long"), text(k % 1000).alias("Depth"), assumed.alias("Assumed"))
    return catalogues.nests(raw)


@query(
    "s13_feature_json",
    "SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS time_iso, CAST(user_id % 90 AS DOUBLE) AS lat, CAST(user_id AS DOUBLE) AS lon, 35.0::DOUBLE AS depth_km, CASE WHEN event_id % 3 <> 0 THEN value END AS magnitude FROM events WHERE event_id % 5 <> 0",
)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as JSON text and flattened again; those without a place are dropped."""
    e = load(spark, sf_dir, "events")
    props = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("time"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("magnitude"), F.lit(35.0).alias("depth"))
    place = F.struct(F.when(F.col("event_id") % 5 != 0, F.array(F.col("user_id").cast("double"), (F.col("user_id") % 90).cast("double"))).alias("coordinates"))
    return catalogues.feature_json(e.select(F.to_json(F.struct(props.alias("properties"), place.alias("geometry"))).alias("json")))


@query("s12_near_cap", "SELECT event_type AS chunk, count(*) AS n, count(*) >= 1500 AS near_cap FROM events GROUP BY event_type")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues.near_cap(load(spark, sf_dir, "events").withColumnRenamed("event_type", "chunk"), 2500, 1000)
