"""Terrain from an elevation grid: one exchange brings the 3 x 3 or larger window of each cell together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.focal import focal, neighbours, offsets


def _window(cells: DataFrame, value: str) -> DataFrame:
    """Each cell with its 3 x 3 window as ``z<dx><dy>`` (m, 0, p); cells whose window has a hole are left out."""
    near = neighbours(cells, offsets(1), [value])
    name = {-1: "m", 0: "0", 1: "p"}
    wide = near.groupBy("x", "y").agg(*[F.max(F.when((F.col("dx") == i) & (F.col("dy") == j), F.col(f"n_{value}"))).alias(f"z{name[i]}{name[j]}") for i, j in offsets(1)])
    return wide.dropna()


def slope_aspect(cells: DataFrame, value: str, size: float = 1.0) -> DataFrame:
    """Slope and aspect in degrees from weighted differences over 3 x 3 cells; rows run southwards, aspect is clockwise from north.

    A flat cell has no aspect.
    """
    w = _window(cells, value)
    z = {c: F.col(c) for c in w.columns}
    east = ((z["zpm"] + 2 * z["zp0"] + z["zpp"]) - (z["zmm"] + 2 * z["zm0"] + z["zmp"])) / (8 * size)
    north = ((z["zmm"] + 2 * z["z0m"] + z["zpm"]) - (z["zmp"] + 2 * z["z0p"] + z["zpp"])) / (8 * size)
    down = F.degrees(F.atan2(-east, -north))
    aspect = F.when((east == 0) & (north == 0), None).when(down < 0, down + 360).otherwise(down)
    return w.select("x", "y", east.alias("east"), north.alias("north"), F.degrees(F.atan(F.sqrt(east * east + north * north))).alias("slope"), aspect.alias("aspect"))


def northness(slopes: DataFrame) -> DataFrame:
    """Northness, eastness and northness weighted by slope; 0 where there is no aspect."""
    a, s = F.radians("aspect"), F.radians("slope")
    return slopes.select("x", "y", F.coalesce(F.cos(a), F.lit(0.0)).alias("northness"), F.coalesce(F.sin(a), F.lit(0.0)).alias("eastness"), F.coalesce(F.cos(a) * F.sin(s), F.lit(0.0)).alias("northness_slope"))


def vector_ruggedness(slopes: DataFrame, radius: int) -> DataFrame:
    """1 minus the length of the mean of the unit vectors that stand on the surface, in a square window."""
    s, a = F.radians("slope"), F.radians(F.coalesce("aspect", F.lit(0.0)))
    unit = slopes.select("x", "y", (F.sin(s) * F.sin(a)).alias("u"), (F.sin(s) * F.cos(a)).alias("v"), F.cos(s).alias("w"))
    near = neighbours(unit, offsets(radius), ["u", "v", "w"])
    sums = near.groupBy("x", "y").agg(F.sum("n_u").alias("u"), F.sum("n_v").alias("v"), F.sum("n_w").alias("w"), F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w"))
    return sums.select("x", "y", (1 - length / F.col("n")).alias("vrm"))


def local_relief(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """Height above the mean of the window, and the mean."""
    mean = focal(cells, value, radius).select("x", "y", F.col("mean").alias("trend"))
    return cells.join(mean, ["x", "y"]).select("x", "y", "trend", (F.col(value) - F.col("trend")).alias("relief"))


def prominence(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """Share in percent of the window's cells that lie lower."""
    near = neighbours(cells, offsets(radius, True, False), [value])
    return near.groupBy("x", "y").agg((100 * F.avg((F.col(f"n_{value}") < F.col(value)).cast("int"))).alias("prominence"))


def moving_correlation(cells: DataFrame, a: str, b: str, radius: int) -> DataFrame:
    """Correlation of two values within a square window; null if one doesn't vary there."""
    near = neighbours(cells, offsets(radius), [a, b])
    return near.groupBy("x", "y").agg(F.corr(f"n_{a}", f"n_{b}").alias("corr"))


def resolution_variance(cells: DataFrame, value: str, factors: list[int]) -> DataFrame:
    """Variance of the means of blocks that get coarser."""
    out = None
    for f in factors:
        means = cells.groupBy(F.floor(F.col("x") / f), F.floor(F.col("y") / f)).agg(F.avg(value).alias("m"))
        row = means.agg(F.count(F.lit(1)).alias("blocks"), F.var_pop("m").alias("variance")).select(F.lit(f).alias("factor"), "blocks", "variance")
        out = row if out is None else out.unionByName(row)
    return out


def hypsometry(cells: DataFrame, value: str, step: float) -> DataFrame:
    """Share of the area at or above each step of elevation; the running sum covers the steps, not the cells."""
    from pyspark.sql import Window

    bins = cells.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / step) * step).cast("double").alias("elevation")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("elevation")))
    return bins.select("elevation", "n", (above / F.sum("n").over(Window.partitionBy())).alias("share_above"))
