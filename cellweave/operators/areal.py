"""Surfaces from values of whole areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.focal import neighbours
from cellweave.sources.shared import discard, materialize


def mass_preserving(cells: DataFrame, area: str, totals: DataFrame, total: str, rounds: int, change: float = 0.0, negative: bool = False) -> DataFrame:
    """``x, y, area, value``: a smooth surface whose cells add up to the total of each area.

    Cells begin with equal shares. A round replaces each cell by the mean of its four neighbours (those that are there), then brings
    every area back to its total: negative cells become 0 unless ``negative``, and what is left is scaled to the total, or spread evenly where nothing is left or the total has the other sign.
    It stops after ``rounds`` or once no cell changes by more than ``change``. Sums by area are partial before they travel; the
    cells of a large area stay dealt by place. Cells of areas without a total, or with a null one, take no part.
    """
    given = totals.select(area, F.col(total).cast("double").alias("t")).where(F.col("t").isNotNull()).groupBy(area).agg(F.sum("t").alias("t"))
    start = cells.select("x", "y", area).where(F.col(area).isNotNull())
    size = start.groupBy(area).agg(F.count(F.lit(1)).alias("n")).join(given, area)
    size = materialize(size, "areas")
    now = materialize(start.join(size, area).select("x", "y", area, (F.col("t") / F.col("n")).alias("value")), "surface")
    for _ in range(rounds):
        near = neighbours(now.select("x", "y", "value"), [(1, 0), (-1, 0), (0, 1), (0, -1)], ["value"]).groupBy("x", "y").agg(F.avg("n_value").alias("m"))
        m = F.coalesce("m", "value")
        smooth = materialize(now.join(near, ["x", "y"], "left").select("x", "y", area, F.col("value").alias("before"), (m if negative else F.greatest(m, F.lit(0.0))).alias("m")), "smooth")
        sums = smooth.groupBy(area).agg(F.sum("m").alias("s")).join(size, area)
        scale = F.try_divide("t", "s")
        factor = sums.select(area, F.when((F.col("s") != 0) & (scale >= 0), scale).alias("f"), ((F.col("t") - F.col("s")) / F.col("n")).alias("d"), (F.col("t") / F.col("n")).alias("e"))
        even = F.col("e") if not negative else F.col("m") + F.col("d")
        new = smooth.join(factor, area).select("x", "y", area, F.when(F.col("f").isNotNull(), F.col("m") * F.col("f")).otherwise(even).alias("value"), "before")
        last, now = now, materialize(new, "surface")
        discard(last)
        discard(smooth)
        if change > 0 and not now.where(F.abs(F.col("value") - F.col("before")) > change).take(1):
            break
        now = now.drop("before")
    return now.select("x", "y", area, "value")
