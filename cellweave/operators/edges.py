"""Edges in images, and straight lines through them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.flood import HALF
from cellweave.operators.focal import neighbours, offsets
from cellweave.operators.graph import connected_components
from cellweave.sources.shared import materialize

#: Values are compared after rounding, so that sums in another order don't decide.
DIGITS = 9


def smoothed(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """Gaussian means over the cells that are there, out to three ``sigma``: along rows, then along columns, with partial sums."""
    radius = max(1, math.ceil(3 * sigma))
    weight = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(math.exp(-i * i / (2 * sigma * sigma))).alias("w")) for i in range(-radius, radius + 1)])).alias("m")
    v = F.col(value).cast("double")
    row = cells.where(v.isNotNull() & ~F.isnan(v)).select("x", "y", v.alias("v"), weight).select((F.col("x") + F.col("m.i")).alias("x"), "y", (F.col("v") * F.col("m.w")).alias("s"), F.col("m.w").alias("w"))
    row = row.groupBy("x", "y").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    both = row.select("x", "y", "s", "w", weight).select("x", (F.col("y") + F.col("m.i")).alias("y"), (F.col("s") * F.col("m.w")).alias("s"), (F.col("w") * F.col("m.w")).alias("w"))
    both = both.groupBy("x", "y").agg((F.sum("s") / F.sum("w")).alias("smooth"))
    return cells.where(v.isNotNull() & ~F.isnan(v)).select("x", "y").join(both, ["x", "y"])


def _sides(cells: DataFrame, columns: list[str], moves: list[tuple[int, int]]) -> DataFrame:
    """Each cell with its neighbours' columns as ``<column>_<dx>_<dy>``, null where there is none."""
    near = neighbours(cells, moves, columns)
    at = lambda c, i, j: F.max(F.when((F.col("dx") == i) & (F.col("dy") == j), F.col(f"n_{c}"))).alias(f"{c}_{i}_{j}")
    return near.groupBy("x", "y").agg(*[at(c, i, j) for c in columns for i, j in moves])


def gradients(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """``x, y, magnitude, angle`` of the smoothed image's central differences; angles in degrees, counter-clockwise from the positive x axis. Cells without all four neighbours have none."""
    s = materialize(smoothed(cells, value, sigma), "smooth")
    at = _sides(s, ["smooth"], [(1, 0), (-1, 0), (0, 1), (0, -1)])
    gx, gy = (F.col("smooth_1_0") - F.col("smooth_-1_0")) / 2, (F.col("smooth_0_1") - F.col("smooth_0_-1")) / 2
    both = at.select("x", "y", gx.alias("gx"), gy.alias("gy")).where("gx IS NOT NULL AND gy IS NOT NULL")
    return both.select("x", "y", F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), DIGITS).alias("magnitude"), F.degrees(F.atan2("gy", "gx")).alias("angle"))


def canny(cells: DataFrame, value: str, width: int, sigma: float, low: float, high: float) -> DataFrame:
    """Thin edges ``x, y, magnitude, angle, edge`` of an image; ``edge`` is the number (smallest cell) of the connected edge.

    A cell is on a ridge if its gradient is at least that of both neighbours along the gradient's direction, in steps of 45 degrees, and more than that of the one ahead; a
    missing neighbour counts as 0. Ridges of at least ``low`` stay where they are connected, over 8 neighbours, with one of at least ``high``.
    """
    g = materialize(gradients(cells, value, sigma), "gradients")
    way = F.pmod(F.floor((F.pmod(F.round("angle", DIGITS), F.lit(180.0)) + 22.5) / 45), F.lit(4)).cast("int")
    ahead = [(1, 0), (1, 1), (0, 1), (-1, 1)]
    moves = ahead + [(-i, -j) for i, j in ahead]
    at = g.where("magnitude > 0").withColumn("way", way).join(_sides(g, ["magnitude"], moves), ["x", "y"], "left")
    side: Column = F.lit(None).cast("double")
    back: Column = F.lit(None).cast("double")
    for k, (i, j) in enumerate(ahead):
        side, back = F.when(F.col("way") == k, F.col(f"magnitude_{i}_{j}")).otherwise(side), F.when(F.col("way") == k, F.col(f"magnitude_{-i}_{-j}")).otherwise(back)
    m = F.col("magnitude")
    ridge = at.where((m > F.coalesce(side, F.lit(0.0))) & (m >= F.coalesce(back, F.lit(0.0))) & (m >= low)).select("x", "y", "magnitude", "angle", (F.col("y") * width + F.col("x")).cast("long").alias("id"))
    ridge = materialize(ridge, "ridges")
    root = connected_components(neighbours(ridge, HALF, ["id"]).select(F.col("id").alias("a"), F.col("n_id").alias("b")))
    named = materialize(ridge.join(root, F.col("id") == F.col("node"), "left").select("x", "y", "magnitude", "angle", F.coalesce("root", "id").alias("edge")), "edges")
    strong = named.where(m >= high).select("edge").distinct()
    return named.join(strong, "edge", "left_semi").select("x", "y", "magnitude", "angle", "edge")


def hough_votes(cells: DataFrame, angles: int) -> DataFrame:
    """``angle, rho, votes``: how many cells lie on each of the lines ``x cos + y sin = rho``, at so many angles from 0 to below 180 degrees and whole distances. Votes are partial sums before they travel."""
    turn = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(math.pi * k / angles)).alias("c"), F.lit(math.sin(math.pi * k / angles)).alias("s")) for k in range(angles)])).alias("t")
    rho = F.floor(F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s") + F.lit(0.5 + 1e-9)).cast("long")
    return cells.select("x", "y", turn).groupBy(F.col("t.k").alias("angle"), rho.alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def hough_lines(cells: DataFrame, angles: int, lines: int, reach: int = 1) -> DataFrame:
    """The ``lines`` strongest lines ``angle, rho, votes``: local peaks of the votes within ``reach`` angles and distances, ties to the smaller angle, then distance. An angle of 180 is 0 with the distance turned round."""
    votes = materialize(hough_votes(cells, angles), "votes")
    deal = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets(reach, centre=False)])).alias("m")
    far = votes.select("angle", "rho", "votes", deal)
    at = F.col("angle") + F.col("m.i")
    over = (at < 0) | (at >= angles)
    seen = far.select(F.pmod(at, F.lit(angles)).alias("angle"), (F.when(over, -F.col("rho")).otherwise(F.col("rho")) + F.col("m.j")).alias("rho"), F.struct("votes", (-F.col("angle")).alias("a"), (-F.col("rho")).alias("r")).alias("other"))
    best = seen.groupBy("angle", "rho").agg(F.max("other").alias("other"))
    peak = F.col("other").isNull() | (F.struct("votes", (-F.col("angle")).alias("a"), (-F.col("rho")).alias("r")) > F.col("other"))
    return votes.join(best, ["angle", "rho"], "left").where(peak).select("angle", "rho", "votes").orderBy(F.desc("votes"), "angle", "rho").limit(lines)
