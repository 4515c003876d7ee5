"""As-of, grid and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_both(events: DataFrame, marks: DataFrame, by: list[str], bucket_days: float = 365.0, event_key: str = "event_idx") -> DataFrame:
    """events (by..., day) with the last mark at or before and the first one after: prev, next (null where none).

    Marks and events are merged in one order per key and time bucket, so a key's whole history never meets in one task;
    what lies beyond a bucket comes from a table of each bucket's first and last mark."""
    bucket = F.floor(F.col("day") / bucket_days).cast("long")
    m = marks.select(*by, F.col("day").alias("mark")).withColumn("__b", F.floor(F.col("mark") / bucket_days).cast("long"))
    e = events.withColumn("__b", bucket)
    edges = m.groupBy(*by, "__b").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    all_buckets = edges.select(*by, "__b", "lo", "hi").unionByName(e.select(*by, "__b").distinct(), allowMissingColumns=True).groupBy(*by, "__b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wb, back_b = Window.partitionBy(*by).orderBy("__b"), Window.partitionBy(*by).orderBy(F.desc("__b"))
    around = all_buckets.select(*by, "__b", F.last("hi", True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.last("lo", True).over(back_b.rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
    both = e.withColumns({"mark": F.lit(None).cast("double"), "__t": F.col("day"), "__k": F.lit(1)}).unionByName(m.withColumns({"__t": F.col("mark"), "__k": F.lit(0)}), allowMissingColumns=True)
    # A frame that grows from its start costs one step a row; what follows is therefore read in reverse order.
    w, back = Window.partitionBy(*by, "__b").orderBy("__t", "__k"), Window.partitionBy(*by, "__b").orderBy(F.desc("__t"), F.desc("__k"))
    both = both.withColumns({"prev": F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.last("mark", True).over(back.rowsBetween(Window.unboundedPreceding, 0))}).where("__k = 1")
    out = both.join(around, [*by, "__b"], "left")
    return out.withColumns({"prev": F.coalesce("prev", "__before"), "next": F.coalesce("next", "__after")}).drop("mark", "__t", "__k", "__b", "__before", "__after")


def mark_timing(events: DataFrame, span: tuple[float, float]) -> DataFrame:
    """prev and next -> since, until, nearest and the fraction of the interval gone; without a mark the span's end stands in."""
    since = F.col("day") - F.coalesce("prev", F.lit(span[0]))
    until = F.coalesce("next", F.lit(span[1])) - F.col("day")
    return events.withColumns({"since": since, "until": until}).withColumns({"nearest": F.least("since", "until"), "fraction": F.when(F.col("since") + F.col("until") > 0, F.col("since") / (F.col("since") + F.col("until"))).otherwise(0.0)})


SMALL_GRID = 200_000  # rows of a dozen numbers: 20 MB


def interpolated(events: DataFrame, grid: DataFrame, start: float, step: float, n: int, at: Column, values: list[str]) -> DataFrame:
    """events with the linear interpolation of grid (k, values...) at a time; beyond the grid the last interval goes on.

    The grid is sent to the executors if it has SMALL_GRID rows at most, else it is joined by a shuffle."""
    k = F.greatest(F.lit(0), F.least(F.floor((at - start) / step), F.lit(n - 2))).cast("long")
    pairs = grid.withColumns({f"__{v}": F.lead(v).over(Window.partitionBy(F.floor(F.col("k") / 4096)).orderBy("k")) for v in values})
    ends = grid.where(F.col("k") % 4096 == 0).select((F.col("k") - 1).alias("k"), *[F.col(v).alias(f"__e_{v}") for v in values])
    pairs = pairs.join(ends, "k", "left").select("k", *values, *[F.coalesce(f"__{v}", f"__e_{v}").alias(f"__{v}") for v in values])
    pairs = F.broadcast(pairs) if n <= SMALL_GRID else pairs
    x = events.withColumns({"k": k, "__f": (at - start) / step - k}).join(pairs, "k")
    return x.withColumns({v: F.col(v) * (1 - F.col("__f")) + F.col(f"__{v}") * F.col("__f") for v in values}).drop("k", "__f", *[f"__{v}" for v in values])


def nearest_sample(events: DataFrame, grid: DataFrame, start: float, step: float, n: int, at: Column) -> DataFrame:
    """events with the grid's row (k, ...) nearest in time."""
    k = F.greatest(F.lit(0), F.least(F.round((at - start) / step), F.lit(n - 1))).cast("long")
    return events.withColumn("k", k).join(grid, "k")


def block_offsets(events: DataFrame, block_days: float, reach: float, trials: int, start: float, seed: int = 4) -> DataFrame:
    """Each event in each trial with the offset of its block: the direct form of a block-shift null."""
    from tremorlake.functions.random import M, mix2, uniform

    x = events.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("block", F.floor((F.col("day") - start) / block_days))
    return x.withColumn("offset", uniform(mix2(F.col("trial"), F.col("block") % M, seed)) * reach)
