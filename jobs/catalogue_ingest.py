"""Keeps an event catalogue and its counts by month, cell and family up to date with files that arrive in a folder.

    PYTHONPATH=. spark-submit jobs/catalogue_ingest.py --input DIR --output DIR --checkpoint DIR --config jobs/catalogue_ingest.json

A file stream takes what its checkpoint has not seen, runs until no file is left (availableNow) and ends. Each micro-batch
- brings the rows into the common event shape by the expressions in the config; rows without an id, a time or a place go to `rejected`,
- drops events that the catalogue already has in the month of the event (only those months' ids are read), and repeats within the batch,
- places the others on the equal-area grid and writes them to `catalogue` (by month and batch) and their counts to `counts`.

Output and checkpoint belong together. A batch that failed midway is run again by the next start, with the same files and number,
and replaces its own partitions; a start without new files writes nothing.

Defined results: an event is its id within a month; of repeated rows in a batch the smallest (by day, family, magnitude,
place) stays, afterwards the first that came. Null, NaN and infinite times and places are rejected, so are latitudes beyond the poles;
a null family is the empty one; a null or non-finite magnitude is unknown. An input without files or rows gives empty tables. Further
input columns are not read. An id in two months is two events.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, read_or_none, session
from tremorlake.functions.geo import Grid
from tremorlake.functions.time import date_of

log = logging.getLogger("jobs.catalogue_ingest")

SHAPE = {"event_idx": "bigint", "day": "double", "family": "string", "magnitude": "double", "lat_deg": "double", "lon_deg": "double"}
CATALOGUE = "event_idx bigint, day double, family string, magnitude double, lat_deg double, lon_deg double, cell bigint, month int, batch bigint"
COUNTS = "cell bigint, family string, n bigint, n_sized bigint, max_magnitude double, month int, batch bigint"
REJECTED = "event_idx bigint, day double, family string, magnitude double, lat_deg double, lon_deg double, reason string, batch bigint"


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def shaped(raw: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The common event shape with month and the reason for which a row is rejected (null: it is good)."""
    rows = raw.select(*[F.expr(columns[name]).try_cast(kind).alias(name) for name, kind in SHAPE.items()])
    placed = finite(F.col("lat_deg")) & finite(F.col("lon_deg")) & (F.abs("lat_deg") <= 90)
    reason = F.when(F.col("event_idx").isNull(), "no id").when(~finite(F.col("day")) | (F.abs("day") > 3.6e6), "no time").when(~placed, "no place")
    rows = rows.withColumns({"reason": reason, "family": F.coalesce("family", F.lit("")), "magnitude": F.when(finite(F.col("magnitude")), F.col("magnitude"))})
    date = date_of(F.when(F.col("reason").isNull(), F.col("day")))
    return rows.withColumn("month", F.year(date) * 100 + F.month(date))


def counted(rows: DataFrame) -> DataFrame:
    """Events by month, cell and family: sums that add up over batches."""
    return rows.groupBy("month", "cell", "family").agg(F.count("*").alias("n"), F.count("magnitude").alias("n_sized"), F.max("magnitude").alias("max_magnitude"))


def write(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that rows has, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(raw: DataFrame, batch: int, output: str, config: Mapping[str, Any]) -> dict[str, int]:
    """One micro-batch; -> how many rows were read, added and rejected."""
    spark = raw.sparkSession
    rows = shaped(raw, config["columns"]).persist()
    try:
        good = rows.where("reason is null").drop("reason")
        write(rows.where("reason is not null").drop("month").withColumn("batch", F.lit(batch)), f"{output}/rejected", "batch")
        rest = [c for c in SHAPE if c != "event_idx"]
        new = good.groupBy("event_idx", "month").agg(F.min(F.struct(*rest)).alias("first")).select("event_idx", "month", "first.*")
        months = [r.month for r in good.select("month").distinct().collect()]  # a batch's months, not its rows
        if months and (known := read_or_none(spark, CATALOGUE, f"{output}/catalogue")) is not None:
            held = known.where(F.col("month").isin(months) & (F.col("batch") < batch)).select("event_idx", "month")
            new = new.join(held, ["event_idx", "month"], "left_anti")
        new = Grid(config["grid_km"]).cell_of(new).drop("cell_lat", "cell_lon").withColumn("batch", F.lit(batch)).persist()
        try:
            write(new, f"{output}/catalogue", "month", "batch")
            write(counted(new).withColumn("batch", F.lit(batch)), f"{output}/counts", "month", "batch")
            done = {"read": rows.count(), "added": new.count(), "rejected": rows.where("reason is not null").count()}
        finally:
            new.unpersist()
    finally:
        rows.unpersist()
    log.info("batch %d: %s rows read, %s events added in months %s, %s rejected", batch, done["read"], done["added"], sorted(months), done["rejected"])
    return done


def pattern(path: str) -> str:
    """The path as a pattern that only it meets: a stream takes a single file by a pattern only, and a folder either way."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def ingest(spark: SparkSession, source: str, output: str, checkpoint: str, config: Mapping[str, Any]) -> dict[str, int]:
    """Takes all files of `source` (a folder, a file or a pattern) that the checkpoint has not seen; -> batches, and rows read, added and rejected in this run."""
    total = {"batches": 0, "read": 0, "added": 0, "rejected": 0}

    def each(raw: DataFrame, batch: int) -> None:
        for name, n in take(raw, batch, output, config).items():
            total[name] += n
        total["batches"] += 1

    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(pattern(source))
    run = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    log.info("%s -> %s: %s", source, output, total)
    return total


def catalogue(spark: SparkSession, output: str) -> DataFrame:
    """All events taken so far."""
    return _written(spark, CATALOGUE, f"{output}/catalogue")


def counts(spark: SparkSession, output: str) -> DataFrame:
    """Counts over all batches: (month, cell, family, n, n_sized, max_magnitude)."""
    parts = _written(spark, COUNTS, f"{output}/counts")
    return parts.groupBy("month", "cell", "family").agg(F.sum("n").alias("n"), F.sum("n_sized").alias("n_sized"), F.max("max_magnitude").alias("max_magnitude"))


def rejected(spark: SparkSession, output: str) -> DataFrame:
    return _written(spark, REJECTED, f"{output}/rejected")


def _written(spark: SparkSession, schema: str, path: str) -> DataFrame:
    found = read_or_none(spark, schema, path)
    return spark.createDataFrame([], schema) if found is None else found


def main(argv: list[str] | None = None) -> None:
    args, config = arguments("Takes new event files into the catalogue", "input", "output", "checkpoint", argv=argv)
    spark = session("catalogue_ingest")
    try:
        ingest(spark, args.input, args.output, args.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
