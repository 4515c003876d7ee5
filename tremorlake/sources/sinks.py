"""Writers of designs, features and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_design(rows: DataFrame, path: str, *by: str) -> None:
    """Design and features as Parquet, ordered by stratum within files, in place of what stood there; by: columns of partitions."""
    rows.sortWithinPartitions(*by, "stratum").write.mode("overwrite").partitionBy(*by).parquet(path)


def design_csv(rows: DataFrame) -> DataFrame:
    """The text form of design rows: day to 9 places, place to 4, magnitude to 2 or blank."""
    text = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    return rows.select(text("day", 9).alias("day"), F.col("cell").cast("string").alias("cell"), text("lat_deg", 4).alias("lat"), text("lon_deg", 4).alias("lon"), F.col("is_case").cast("int").cast("string").alias("case"), F.col("stratum").cast("string").alias("stratum"), F.when(F.col("magnitude").isNull(), "").otherwise(text("magnitude", 2)).alias("magnitude"), F.coalesce("mech", F.lit("")).alias("mech"), F.coalesce("depthclass", F.lit("")).alias("depthclass"))


def scan_report(summary: DataFrame, top: DataFrame) -> DataFrame:
    """One row: the summary's columns and the top features as an array, ready for a JSON file."""
    listed = top.agg(F.sort_array(F.collect_list(F.struct(F.abs("z").alias("by"), "feature", "z")), asc=False).alias("t")).select(F.transform("t", lambda x: F.struct(x["feature"].alias("name"), x["z"].alias("z"))).alias("top"))
    return summary.crossJoin(listed)


def write_json(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file, in place of what stood there."""
    report.coalesce(1).write.mode("overwrite").json(path)


def year_counts_text(counts: DataFrame) -> DataFrame:
    """`year count` lines."""
    return counts.select(F.concat_ws(" ", "year", "n").alias("value"))
