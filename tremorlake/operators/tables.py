"""Tables written once and read again, and global row numbers without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder spark.checkpoint.dir names, which the driver and all executors see.

    Without that setting a temporary folder serves in local mode; on a cluster executors would not share it, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tremorlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """Adds the row's number, from 1, in a total order: range partitions are ranked on their own and offset by the rows before.

    Only the partitions' counts meet in one place."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(before), "__p").withColumn(name, F.col(name) + F.col("__before")).drop("__p", "__before")


def equal_count_bins(df: DataFrame, value: Column, k: int, *ties: Column, name: str = "bin") -> DataFrame:
    """Adds a bin of 0..k-1 by rank of value; each has count // k rows and the last one the remainder."""
    n = df.count()
    per = max(1, n // k)
    return numbered(df, value, *ties, name="__rn").withColumn(name, F.least(F.floor((F.col("__rn") - 1) / per), F.lit(k - 1)).cast("int")).drop("__rn")
