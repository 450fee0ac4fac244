"""Small conversions between grids, points and lines, and selections of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sources.shared import materialize


def rows_to_lines(cells: DataFrame, value: str, row: str = "y", along: str = "x") -> DataFrame:
    """A line per grid row through its cells that have a value, in order; rows with fewer than two are left out.

    A line is as long as a grid row, which is what bounds it.
    """
    lines = cells.where(F.col(value).isNotNull()).groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(along).cast("double").alias("x"), F.col(value).cast("double").alias("z")))).alias("vertices"))
    return lines.where(F.size("vertices") > 1)


def affine(x: Column, y: Column, matrix: Sequence[float]) -> tuple[Column, Column]:
    """Coordinates after ``x' = a x + b y + c, y' = d x + e y + f``."""
    a, b, c, d, e, f = matrix
    return a * x + b * y + c, d * x + e * y + f


def rotate(cells: DataFrame, value: str, degrees: float, cx: float, cy: float) -> DataFrame:
    """The grid turned about a centre; cells that fall together are averaged."""
    from math import cos, radians, sin

    c, s = cos(radians(degrees)), sin(radians(degrees))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    turned = cells.select(F.floor(c * dx - s * dy + cx + 0.5).alias("x"), F.floor(s * dx + c * dy + cy + 0.5).alias("y"), value)
    return turned.groupBy("x", "y").agg(F.avg(value).alias(value))


def transects(segments: DataFrame, key: str, half: float) -> DataFrame:
    """Across the middle of each segment a line of twice the length ``half``; none across a segment without length."""
    s = segments.where("length > 0")
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    nx, ny = -(F.col("y2") - F.col("y1")) / F.col("length"), (F.col("x2") - F.col("x1")) / F.col("length")
    return s.select(key, "part", (mx - half * nx).alias("x1"), (my - half * ny).alias("y1"), (mx + half * nx).alias("x2"), (my + half * ny).alias("y2"))


def null_values(df: DataFrame, columns: Sequence[str], to_null: Sequence[float] = (), from_null: float | None = None) -> DataFrame:
    """Listed values become null, or nulls become a value, in each of the columns."""
    def one(c: str) -> Column:
        e = F.when(~F.col(c).isin(list(to_null)), F.col(c)) if to_null else F.col(c)
        return F.coalesce(e, F.lit(from_null)) if from_null is not None else e

    return df.withColumns({c: one(c) for c in columns})


def weighted_selection(cells: DataFrame, weight: str, seed: int = 0) -> DataFrame:
    """Cells chosen with a probability of their weight's share of the largest, by a hash of the position that reruns agree on."""
    top = cells.agg(F.max(weight).alias("_top"))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("x").cast("string"), F.col("y").cast("string"))), 1, 12), 16, 10).cast("double") / 16.0**12
    return cells.crossJoin(F.broadcast(top)).where(unit < F.try_divide(F.col(weight), F.col("_top"))).drop("_top")  # one row


def snap(points: DataFrame, cells: DataFrame, key: str, value: str, least: float, radius: int) -> DataFrame:
    """Each point moved to the nearest cell within ``radius`` whose value is at least ``least``; it stays where there is none."""
    square = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    c = cells.where(F.col(value) >= least).select(F.col("x").alias("cx"), F.col("y").alias("cy"), square("x").alias("sx"), square("y").alias("sy"))
    p = points.select(key, "x", "y", around.alias("m")).select(key, "x", "y", (square("x") + F.col("m.i")).alias("sx"), (square("y") + F.col("m.j")).alias("sy"))
    d2 = F.pow((F.col("x") - F.col("cx")).cast("double"), 2) + F.pow((F.col("y") - F.col("cy")).cast("double"), 2)
    best = p.join(c, ["sx", "sy"]).withColumn("_d", d2).where(F.col("_d") <= radius * radius).groupBy(key).agg(F.min(F.struct("_d", "cx", "cy")).alias("_b"))
    return points.join(best, key, "left").select(key, F.coalesce("_b.cx", "x").alias("x"), F.coalesce("_b.cy", "y").alias("y"), F.sqrt("_b._d").alias("moved"))


def voxels(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """The value of the voxel that each point lies in, null outside."""
    at = points.withColumns({f"_{c}": F.floor(c).cast("long") for c in "xyz"})
    g = grid.select(*[F.col(c).cast("long").alias(f"_{c}") for c in "xyz"], value)
    return at.join(g, ["_x", "_y", "_z"], "left").drop("_x", "_y", "_z")


def colour(edges: DataFrame) -> DataFrame:
    """Numbers from 1 for the nodes of ``a, b`` so that neighbours differ, by independent sets.

    In each round the nodes whose hash is the least among their uncoloured neighbours take the smallest number that no
    coloured neighbour has; two of them are never neighbours, so a round colours them all at once.
    """
    both = materialize(edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct(), "colour")
    done = None
    left = materialize(both.select("u").distinct(), "colour")
    while left.take(1):
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        open_ = both.join(left, "u", "left_semi").join(left.select(F.col("u").alias("v")), "v", "left_semi")
        beaten = open_.where(place("v") < place("u")).select("u").distinct()
        first = left.join(beaten, "u", "left_anti")
        if done is None:
            new = first.withColumn("colour", F.lit(1))
        else:
            taken = both.join(first, "u", "left_semi").join(done.select(F.col("u").alias("v"), "colour"), "v").groupBy("u").agg(F.collect_set("colour").alias("_t"))
            free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_t") + 1), F.col("_t")))
            new = first.join(taken, "u", "left").select("u", F.when(F.col("_t").isNull(), 1).otherwise(free).alias("colour"))
        new = materialize(new, "colour")
        done = new if done is None else done.unionByName(new)
        left = materialize(left.join(new.select("u"), "u", "left_anti"), "colour")
    return left.select(F.col("u").alias("node"), F.lit(1).alias("colour")) if done is None else done.select(F.col("u").alias("node"), "colour")


def first_valid(df: DataFrame, columns: Sequence[str]) -> Column:
    """The first column that isn't null: maps laid over each other."""
    return F.coalesce(*columns)


def nested_means(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """Classes from splitting at the mean, then each half at its own mean, and so on."""
    now = cells.withColumn("class", F.lit(0))
    for _ in range(levels):
        means = now.groupBy("class").agg(F.avg(value).alias("_m"))  # a row per class
        now = now.join(F.broadcast(means), "class").withColumn("class", 2 * F.col("class") + (F.col(value) > F.col("_m")).cast("int")).drop("_m")
    return now
