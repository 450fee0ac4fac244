"""Neighbourhoods of cells ``x, y``: moving windows, adjacency, autocorrelation and terrain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(radius: int, circle: bool = False, centre: bool = True) -> list[tuple[int, int]]:
    """Offsets of a square or circular window."""
    r = range(-radius, radius + 1)
    return [(i, j) for i in r for j in r if (centre or i or j) and (not circle or i * i + j * j <= radius * radius)]


def neighbours(cells: DataFrame, moves: Sequence[tuple[int, int]], columns: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """Each cell's own columns beside its neighbours' as ``n_<column>``: cells are dealt out along the moves and met by position."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(float(w)).alias("w")) for (i, j), w in zip(moves, weights or [1.0] * len(moves), strict=True)]))
    dealt = cells.select("x", "y", *columns, near.alias("_m")).select(
        (F.col("x") - F.col("_m.dx")).alias("x"), (F.col("y") - F.col("_m.dy")).alias("y"), "_m.dx", "_m.dy", "_m.w", *[F.col(c).alias(f"n_{c}") for c in columns]
    )
    return cells.select("x", "y", *columns).join(dealt, ["x", "y"])


def focal(cells: DataFrame, value: str, radius: int, circle: bool = False) -> DataFrame:
    """Statistics of the window round each cell, over the cells that exist; grids may have holes.

    A circle meets its cells by offset, (2r+1)^2 rows for each. A square deals each cell along its row and sums there, then deals
    the sums along their columns, 2(2r+1) rows for each; both sums are partial before they travel.
    """
    if circle:
        near = neighbours(cells, offsets(radius, True), [value])
        return near.groupBy("x", "y").agg(F.sum(f"n_{value}").alias("sum"), F.count(f"n_{value}").alias("n"), F.avg(f"n_{value}").alias("mean"), F.min(f"n_{value}").alias("min"), F.max(f"n_{value}").alias("max"))
    reach = lambda c: F.explode(F.sequence(F.col(c) - radius, F.col(c) + radius)).alias(c)
    row = cells.select(reach("x"), "y", F.col(value).alias("v")).groupBy("x", "y").agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    both = row.select("x", reach("y"), "s", "n", "lo", "hi").groupBy("x", "y").agg(F.sum("s").alias("sum"), F.sum("n").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    return cells.select("x", "y").join(both, ["x", "y"]).withColumn("mean", F.try_divide("sum", "n"))


def adjacency(cells: DataFrame, zone: str, diagonal: bool = False) -> DataFrame:
    """Pairs of unlike neighbouring zones, both ways, with the number of shared borders."""
    moves = [(1, 0), (0, 1)] + [(1, 1), (1, -1)] * diagonal
    near = neighbours(cells, moves, [zone]).where(F.col(zone) != F.col(f"n_{zone}"))
    both = F.explode(F.array(F.struct(F.col(zone).alias("a"), F.col(f"n_{zone}").alias("b")), F.struct(F.col(f"n_{zone}").alias("a"), F.col(zone).alias("b"))))
    return near.select(both.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("borders"))


def zone_neighbours(means: DataFrame, pairs: DataFrame, zone: str, value: str) -> DataFrame:
    """Mean, spread and number of the neighbouring zones' values."""
    other = means.select(F.col(zone).alias("b"), F.col(value).alias("_v"))
    return pairs.join(other, "b").groupBy(F.col("a").alias(zone)).agg(F.avg("_v").alias("neighbour_mean"), F.coalesce(F.stddev_pop("_v"), F.lit(0.0)).alias("neighbour_stddev"), F.count(F.lit(1)).alias("neighbours"))


def autocorrelation(cells: DataFrame, zone: str, value: str, pairs: DataFrame) -> DataFrame:
    """Moran's I and Geary's C of the zones' means over adjacent pairs, with the mean of all cells as centre."""
    means = cells.groupBy(zone).agg(F.avg(value).alias("m"))
    centre = cells.agg(F.avg(value).alias("g"))
    spread = means.crossJoin(F.broadcast(centre)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("m") - F.col("g"), 2)).alias("s"))  # one row
    a = means.select(F.col(zone).alias("a"), F.col("m").alias("ma"))
    b = means.select(F.col(zone).alias("b"), F.col("m").alias("mb"))
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").crossJoin(F.broadcast(centre))
    sums = joined.agg(F.count(F.lit(1)).alias("w"), F.sum((F.col("ma") - F.col("g")) * (F.col("mb") - F.col("g"))).alias("p"), F.sum(F.pow(F.col("ma") - F.col("mb"), 2)).alias("q"))
    return sums.crossJoin(spread).select(F.try_divide(F.col("n") * F.col("p"), F.col("w") * F.col("s")).alias("moran"), F.try_divide((F.col("n") - 1) * F.col("q"), 2 * F.col("w") * F.col("s")).alias("geary"))  # one row each


def ruggedness(cells: DataFrame, value: str, radius: int = 1, exponent: float = 0.0) -> DataFrame:
    """Mean absolute difference to the neighbours, weighted by distance to the power of minus ``exponent``."""
    moves = offsets(radius, centre=False)
    near = neighbours(cells, moves, [value], [(i * i + j * j) ** (-exponent / 2) for i, j in moves])
    return near.groupBy("x", "y").agg(F.try_divide(F.sum(F.col("w") * F.abs(F.col(f"n_{value}") - F.col(value))), F.sum(F.when(F.col(f"n_{value}").isNotNull(), F.col("w")))).alias("tri"))


def terrain_position(cells: DataFrame, value: str, radii: Sequence[int]) -> DataFrame:
    """Height above the mean of the window in standard deviations of all such heights; of several windows the larger in magnitude."""
    out = None
    for r in sorted(set(radii), reverse=True):
        mean = focal(cells, value, r).select("x", "y", "mean")
        t = cells.join(mean, ["x", "y"]).select("x", "y", (F.col(value) - F.col("mean")).alias("_t"))
        s = t.agg(F.avg("_t").alias("_m"), F.stddev_pop("_t").alias("_d"))
        z = t.crossJoin(F.broadcast(s)).select("x", "y", F.try_divide(F.col("_t") - F.col("_m"), F.col("_d")).alias("tpi"))  # one row
        if out is None:
            out = z
        else:
            both = out.join(z.withColumnRenamed("tpi", "_z"), ["x", "y"])
            out = both.select("x", "y", F.when(F.abs("_z") > F.abs("tpi"), F.col("_z")).otherwise(F.col("tpi")).alias("tpi"))
    return out


def forest_fragmentation(cells: DataFrame, forest: str, size: int = 3) -> DataFrame:
    """Fragmentation class of each forest cell from forest density and connectivity in its window; 0 elsewhere."""
    r = size // 2
    f = cells.select("x", "y", F.col(forest).cast("int").alias("f"))
    # a pair belongs to the windows that hold both of its cells
    pairs = neighbours(f, [(1, 0), (0, 1)], ["f"])
    any_, both = ((F.coalesce("f", F.lit(0)) + F.coalesce("n_f", F.lit(0))) >= k for k in (1, 2))
    marks = pairs.groupBy("x", "y", "dx", "dy").agg(F.max(any_.cast("int")).alias("any"), F.max(both.cast("int")).alias("both"))
    spread = []
    for dx, dy in ((1, 0), (0, 1)):
        moves = [(i, j) for i in range(-r, r + 1 - dx) for j in range(-r, r + 1 - dy)]
        deal = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in moves]))
        spread.append(marks.where((F.col("dx") == dx) & (F.col("dy") == dy)).select(F.col("x"), F.col("y"), "any", "both", deal.alias("m")).select((F.col("x") - F.col("m.i")).alias("x"), (F.col("y") - F.col("m.j")).alias("y"), "any", "both"))
    edges = spread[0].unionByName(spread[1]).groupBy("x", "y").agg(F.sum("any").alias("any"), F.sum("both").alias("both"))
    density = neighbours(f, offsets(r), ["f"]).groupBy("x", "y").agg(F.avg("n_f").alias("pf"))
    out = f.join(density, ["x", "y"]).join(edges, ["x", "y"], "left").withColumn("pff", F.coalesce(F.try_divide("both", "any"), F.lit(0.0)))
    gap = F.round(F.col("pf") - F.col("pff"), 9)
    cls = (
        F.when(F.col("f").isNull(), None).when(F.col("f") == 0, 0).when(F.col("pf") < 0.4, 1).when(F.col("pf") < 0.6, 2).when(F.col("pf") == 1, 5).when(gap < 0, 3).when((F.col("pf") > 0.6) & (gap > 0), 4).when((F.col("pf") > 0.6) & (gap == 0), 6).otherwise(0)
    )
    return out.select("x", "y", "pf", "pff", cls.alias("class"))


def flip(cells: DataFrame, width: int, height: int, horizontal: bool = True, vertical: bool = False) -> DataFrame:
    """The mirrored grid."""
    x: Column = F.lit(width - 1) - F.col("x") if horizontal else F.col("x")
    y: Column = F.lit(height - 1) - F.col("y") if vertical else F.col("y")
    return cells.withColumns({"x": x, "y": y})
