"""Sensor windows over streams: the batch operators' expressions behind a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(records: DataFrame, keys: Sequence[str], ts: str, v: str, width: str, late: str = "1 hour") -> DataFrame:
    """Mean and count by key and window; rows later than ``late`` are dropped, state ends with the watermark."""
    return sliding(records, keys, ts, v, width, width, late)


def sliding(records: DataFrame, keys: Sequence[str], ts: str, v: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    """The same for windows that begin every ``slide``."""
    window = F.window(ts, width) if width == slide else F.window(ts, width, slide)
    out = records.withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start_ts"), "mean", "n")


def sessions(records: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after a pause of ``gap``."""
    out = records.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
