"""Joins and windows in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def registry(maps: DataFrame, start: str) -> DataFrame:
    """Half-open intervals ``start_ts, end_ts`` from the starts of a series; the last one is open-ended.

    The registry has a row per map, not per cell, which is why one window may order it whole.
    """
    w = Window.orderBy("start_ts")
    return maps.select(F.col(start).alias("start_ts")).where("start_ts IS NOT NULL").distinct().select("start_ts", F.lead("start_ts").over(w).alias("end_ts"), F.row_number().over(w).alias("map"))


def instant_join(points: DataFrame, intervals: DataFrame, ts: str, bucket: str = "day") -> DataFrame:
    """The interval (``start_ts <= ts < end_ts``) in which each point lies; points outside of all get none.

    Both sides are cut into buckets of time and joined on them, so the range condition only filters within a bucket.
    An open end reaches to the latest point.
    """
    last = points.agg(F.date_trunc(bucket, F.max(ts)).alias("_last"))
    unit = F.expr(f"INTERVAL 1 {bucket.upper()}")
    spread = intervals.crossJoin(F.broadcast(last)).where("_last >= date_trunc('%s', start_ts)" % bucket)  # one row
    first, end = F.date_trunc(bucket, "start_ts"), F.least(F.coalesce(F.date_trunc(bucket, "end_ts"), F.col("_last")), F.col("_last"))
    cut = spread.withColumn("_bucket", F.explode(F.sequence(first, end, unit))).drop("_last")
    placed = points.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    inside = (F.col(ts) >= F.col("start_ts")) & (F.col("end_ts").isNull() | (F.col(ts) < F.col("end_ts")))
    return placed.join(cut, "_bucket").where(inside).drop("_bucket")


def aggregate_methods(v: str) -> dict:
    """Aggregates of one value column by method name."""
    return {
        "count": F.count(v), "average": F.avg(v), "median": F.percentile(v, F.lit(0.5)), "minimum": F.min(v), "maximum": F.max(v), "sum": F.sum(v), "stddev": F.stddev_pop(v), "variance": F.var_pop(v),
        "quart1": F.percentile(v, F.lit(0.25)), "quart3": F.percentile(v, F.lit(0.75)), "perc90": F.percentile(v, F.lit(0.9)),
    }


def window_aggregate(series: DataFrame, marks: DataFrame, keys: Sequence[str], t: str, at: str, v: str, width: int, methods: Sequence[str], ahead: bool = False) -> DataFrame:
    """Statistics of a series in the window ``[at - width, at)`` before (or ``[at, at + width)`` after) each mark.

    Integer times are cut into buckets as wide as the window; a window touches two of them, so each mark goes to two buckets and
    the join is an equality on them.
    """
    low = F.col(at) if ahead else F.col(at) - width
    cut = F.explode(F.array(F.floor(low / width), F.floor(low / width) + 1))
    spread = marks.withColumn("_bucket", cut)
    placed = series.withColumn("_bucket", F.floor(F.col(t) / width))
    joined = spread.join(placed, [*keys, "_bucket"]).where((F.col(t) >= low) & (F.col(t) < low + width))
    every = aggregate_methods(v)
    return joined.groupBy(*keys, at).agg(*[every[m].alias(f"{v}_{m}") for m in methods])


def tumbling(records: DataFrame, keys: Sequence[str], ts: str, v: str, width: str) -> DataFrame:
    """Mean and count in windows of a fixed width; for a stream with a watermark the same expression is append-only."""
    return records.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.avg(v).alias("mean"), F.count(v).alias("n")).select(*keys, F.col("w.start").alias("start_ts"), "mean", "n")


def dense(windows: DataFrame, keys: Sequence[str], start: str, unit: str) -> DataFrame:
    """The windows and, between each key's first and last, empty ones where none was."""
    spans = windows.groupBy(*keys).agg(F.min(start).alias("_a"), F.max(start).alias("_b"))
    every = spans.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL 1 {unit.upper()}"))).alias(start))
    return every.join(windows, [*keys, start], "left")


def baseline_quantile(records: DataFrame, key: str, v: str, tie: str, tiles: int) -> DataFrame:
    """The largest value in the lowest of ``tiles`` equal parts of each key's values."""
    w = Window.partitionBy(key).orderBy(v, tie)
    return records.where(F.col(v).isNotNull()).withColumn("_tile", F.ntile(tiles).over(w)).where("_tile = 1").groupBy(key).agg(F.max(v).alias("baseline"))


def equal_join(a: DataFrame, b: DataFrame, on: Sequence[str] = ("start_ts", "end_ts")) -> DataFrame:
    """Maps of two series with the same interval; open ends are equal."""
    left, right = a.alias("a"), b.alias("b")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return left.join(right, same).select("a.*", *[F.col(f"b.{c}").alias(f"{c}_b") for c in b.columns if c not in on])
