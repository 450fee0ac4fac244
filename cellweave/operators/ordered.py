"""Running sums and percentiles of sorted values, spread over tasks whatever the size of a group."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.shared import materialize


def running(values: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """``values``, one row for each of the keys' values, with each sum over the smaller ones (``_b_``) and over all of the keys' (``_t_``).

    Rows are dealt to ranges of keys and value, so one group may fill many tasks, and written, so that a range keeps its rows
    if some are computed again. Sums run within a range; the totals of the ranges before it, a row each, are added.
    """
    dealt = materialize(values.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "_p").agg(*[F.sum(c).alias(c) for c in sums])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    heads = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_p").alias("_q"),
        *[F.sum(c).over(earlier).alias(f"_o_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"_t_{c}") for c in sums],
    )
    smaller = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({f"_i_{c}": F.sum(c).over(smaller) for c in sums})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_p") == F.col("_q"))
    before = [(F.coalesce(f"_i_{c}", F.lit(0)) + F.coalesce(f"_o_{c}", F.lit(0))).alias(f"_b_{c}") for c in sums]
    return inside.join(heads, same).select(*values.columns, *before, *[f"_t_{c}" for c in sums])


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order``, from 1: dealt to ranges, written, numbered within a range and raised by the sizes of the ranges before it."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as ranges
    heads = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_i", inside).join(heads, "_p").select(*rows.columns, (F.col("_before") + F.col("_i")).alias(name))


def percentile_columns(value: str, n: str, shares: Mapping[str, float]) -> list:
    """Aggregates over rows of ``running`` that give the interpolated percentile at each share of the ``n`` values."""
    v, start, end = F.col(value), F.col(f"_b_{n}"), F.col(f"_b_{n}") + F.col(n)
    out = []
    for name, share in shares.items():
        place = (F.col(f"_t_{n}") - 1) * F.lit(float(share))
        low, high = (F.max(F.when((start <= k) & (k < end), v)).cast("double") for k in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return out
