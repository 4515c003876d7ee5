"""Readers of the five catalogue formats, and of feature JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.functions.time import civil_day, iso_day, mail_day

QUAKE = "day double, lat_deg double, lon_deg double, depth_km double, magnitude double"
# The lunar catalogue's years and the days from 1969-01-01 to their beginning.
LUNAR_YEARS = {69: 0, 70: 365, 71: 730, 72: 1095, 73: 1461, 74: 1826, 75: 2191, 76: 2556, 77: 2922}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under their header names; quoted fields may hold commas."""
    return spark.read.csv(path, header=True, quote='"', escape='"')


def number(column: Column, kind: str = "double") -> Column:
    """Text -> number, null where it is none, is blank or is NaN."""
    x = F.trim(column).try_cast(kind)
    return F.when(~F.isnan(x), x) if kind == "double" else x


def _need(raw: DataFrame, names: tuple[str, ...], schema: str) -> DataFrame | None:
    return None if set(names) <= set(raw.columns) else raw.sparkSession.createDataFrame([], schema)


def comcat(raw: DataFrame) -> DataFrame:
    """time, latitude, longitude, depth, mag -> quakes; rows without time or place are dropped."""
    if (empty := _need(raw, ("time", "latitude", "longitude", "depth", "mag"), QUAKE)) is not None:
        return empty
    out = raw.select(iso_day(F.col("time")).alias("day"), number(F.col("latitude")).alias("lat_deg"), number(F.col("longitude")).alias("lon_deg"), number(F.col("depth")).alias("depth_km"), number(F.col("mag")).alias("magnitude"))
    return out.where("day is not null and lat_deg is not null and lon_deg is not null")


def ndk(lines: DataFrame) -> DataFrame:
    """Moment tensors of five text lines each: lines (source, line_no, value) -> (day, lat_deg, lon_deg, depth_km, mw, planes).

    Blank lines do not count; groups of five follow each other from a source's beginning, malformed groups and a
    short tail are skipped without search for a new beginning. A source is a file: its lines are numbered in one task."""
    w = Window.partitionBy("source").orderBy("line_no")
    numbered = lines.where(F.trim("value") != "").withColumn("rn", F.row_number().over(w) - 1)
    line = lambda i: F.max(F.when(F.col("rn") % 5 == i, F.col("value")))
    groups = numbered.groupBy("source", F.floor(F.col("rn") / 5).alias("g")).agg(*[line(i).alias(f"l{i}") for i in range(5)], F.count("*").alias("n")).where("n = 5")
    parts = [F.split(F.trim(F.col(f"l{i}")), r"\s+") for i in range(5)]
    word = lambda i, k: F.get(parts[i], F.lit(k))
    date, clock = F.split(word(0, 1), "/"), F.split(word(0, 2), ":")
    whole = lambda a, i: F.get(a, F.lit(i)).try_cast("int")
    real = lambda x: x.try_cast("double")
    day = civil_day(whole(date, 0), whole(date, 1), F.when(whole(date, 2).between(1, 31), whole(date, 2)))
    day = day + (real(F.get(clock, F.lit(0))) * 3600 + real(F.get(clock, F.lit(1))) * 60 + real(F.get(clock, F.lit(2))) + real(word(2, 1))) / 86400
    m0 = real(word(4, 10)) * F.pow(F.lit(10.0), real(word(3, 0)))
    plane = lambda k: F.struct(real(word(4, k)).alias("strike"), real(word(4, k + 1)).alias("dip"), real(word(4, k + 2)).alias("rake"))
    out = groups.where(word(2, 0).startswith("CENTROID")).select(day.alias("day"), real(word(2, 3)).alias("lat_deg"), real(word(2, 5)).alias("lon_deg"), real(word(2, 7)).alias("depth_km"), F.when(m0 > 0, (F.log10(m0) - 16.1) * (2 / 3)).alias("mw"), F.array(plane(11), plane(14)).alias("planes"))
    return out.where("day is not null and lat_deg is not null and lon_deg is not null and depth_km is not null and mw is not null and planes[0].rake is not null and planes[1].rake is not null")


def parkfield(raw: DataFrame) -> DataFrame:
    """year, month, day, s_of_day, ccsum, ID, latitude, longitude, depth -> low-frequency events; ccsum is 0 if missing."""
    schema = "day double, family string, lat_deg double, lon_deg double, depth_km double, ccsum double"
    if (empty := _need(raw, ("year", "month", "day", "s_of_day", "ID", "latitude", "longitude", "depth"), schema)) is not None:
        return empty
    day = civil_day(number(F.col("year"), "int"), number(F.col("month"), "int"), number(F.col("day"), "int")) + number(F.col("s_of_day")) / 86400
    ccsum = F.coalesce(number(F.col("ccsum")), F.lit(0.0)) if "ccsum" in raw.columns else F.lit(0.0)
    out = raw.select(day.alias("day"), F.trim("ID").alias("family"), number(F.col("latitude")).alias("lat_deg"), number(F.col("longitude")).alias("lon_deg"), number(F.col("depth")).alias("depth_km"), ccsum.alias("ccsum"))
    return out.where("day is not null and family is not null and lat_deg is not null and lon_deg is not null and depth_km is not null")


def cascadia(raw: DataFrame) -> DataFrame:
    """time_iso (a quoted mail date), lat, lon, depth_km, magnitude, num_stas -> tremor; blanks are null."""
    schema = "day double, lat_deg double, lon_deg double, depth_km double, magnitude double, num_stas double"
    if (empty := _need(raw, ("time_iso", "lat", "lon"), schema)) is not None:
        return empty
    get = lambda c: number(F.col(c)) if c in raw.columns else F.lit(None).cast("double")
    out = raw.select(mail_day(F.col("time_iso")).alias("day"), get("lat").alias("lat_deg"), get("lon").alias("lon_deg"), get("depth_km").alias("depth_km"), get("magnitude").alias("magnitude"), get("num_stas").alias("num_stas"))
    return out.where("day is not null and lat_deg is not null and lon_deg is not null")


def apollo(raw: DataFrame) -> DataFrame:
    """Y (two digits), JD, S (HHMM), T2, N2 -> moonquakes (day since 1969-01-01, class, nest)."""
    if (empty := _need(raw, ("Y", "JD", "S", "T2", "N2"), "day double, class string, nest int")) is not None:
        return empty
    offsets = F.create_map(*[F.lit(x) for pair in LUNAR_YEARS.items() for x in pair])
    at = number(F.col("S"), "int")
    hour, minute = F.floor(at / 100), at % 100
    day = F.try_element_at(offsets, number(F.col("Y"), "int")) + number(F.col("JD"), "int") - 1 + F.when((hour < 24) & (minute < 60) & (at >= 0), (hour + minute / 60) / 24)
    out = raw.select(day.cast("double").alias("day"), F.trim("T2").alias("class"), number(F.col("N2"), "int").alias("nest"))
    return out.where("day is not null and class is not null and class != ''")


def nests(raw: DataFrame) -> DataFrame:
    """A, Lat, Long, Depth, Assumed -> nest locations; rows without numbers are dropped."""
    schema = "nest int, lat_deg double, lon_deg double, depth_km double, assumed boolean"
    if (empty := _need(raw, ("A", "Lat", "Long", "Depth", "Assumed"), schema)) is not None:
        return empty
    out = raw.select(number(F.col("A"), "int").alias("nest"), number(F.col("Lat")).alias("lat_deg"), number(F.col("Long")).alias("lon_deg"), number(F.col("Depth")).alias("depth_km"), (F.upper(F.trim("Assumed")) == "Y").alias("assumed"))
    return out.where("nest is not null and lat_deg is not null and lon_deg is not null and depth_km is not null")


def feature_json(raw: DataFrame) -> DataFrame:
    """json (a feature with properties and geometry.coordinates) -> time_iso, lat, lon, depth_km, magnitude; no time or place: dropped."""
    schema = "properties struct<time:string,magnitude:double,depth:double>, geometry struct<coordinates:array<double>>"
    x = raw.select(F.from_json("json", schema).alias("f"))
    out = x.select(F.col("f.properties.time").alias("time_iso"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.col("f.properties.depth").alias("depth_km"), F.col("f.properties.magnitude").alias("magnitude"))
    return out.where("time_iso is not null and lon is not null and lat is not null")


def near_cap(chunks: DataFrame, cap: int = 20_000, margin: int = 1000) -> DataFrame:
    """chunk -> rows and whether their number comes near a server's cap, so that rows may be missing."""
    return chunks.groupBy("chunk").agg(F.count("*").alias("n")).withColumn("near_cap", F.col("n") >= cap - margin)
