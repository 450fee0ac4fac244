"""Points, lines and areas as tables with key and coordinates; a line or a ring is an array of ``x, y``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.temporal import aggregate_methods


def segments(lines: DataFrame, key: str, vertices: str) -> DataFrame:
    """The straight pieces of each line, in order, with length and azimuth (degrees clockwise from north)."""
    pair = F.transform(F.slice(vertices, 1, F.greatest(F.size(vertices) - 1, F.lit(0))), lambda p, i: F.struct(i.alias("part"), p["x"].alias("x1"), p["y"].alias("y1"), F.element_at(vertices, i + 2)["x"].alias("x2"), F.element_at(vertices, i + 2)["y"].alias("y2")))
    s = lines.select(key, F.explode(pair).alias("s")).select(key, "s.*")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.degrees(F.atan2(dx, dy))
    return s.withColumns({"length": F.sqrt(dx * dx + dy * dy), "azimuth": F.when(turn < 0, turn + 360).otherwise(turn)})


def points_along(lines: DataFrame, key: str, vertices: str, step: float) -> DataFrame:
    """Points at equal distances from the start of each line."""
    step = float(step)
    run = Window.partitionBy(key).orderBy("part")
    s = segments(lines, key, vertices).withColumn("_to", F.sum("length").over(run)).withColumn("_from", F.col("_to") - F.col("length"))
    last = F.max("part").over(Window.partitionBy(key))
    s = s.withColumn("_last", F.col("part") == last)
    first, end = F.ceil(F.col("_from") / step), F.when(F.col("_last"), F.floor(F.col("_to") / step)).otherwise(F.ceil(F.col("_to") / step) - 1)
    cut = s.where(first <= end).withColumn("k", F.explode(F.sequence(first, end)))
    t = F.try_divide(F.col("k") * step - F.col("_from"), F.col("length"))
    return cut.select(key, "k", (F.col("k") * step).alias("distance"), (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def ring_measures(areas: DataFrame, key: str, ring: str) -> DataFrame:
    """Area, perimeter, compactness and fractal dimension of closed rings (the last vertex repeats the first or not)."""
    near = lambda i: F.element_at(ring, F.when(i + 2 > F.size(ring), 1).otherwise(i + 2).cast("int"))
    cross = F.aggregate(F.transform(ring, lambda p, i: p["x"] * near(i)["y"] - near(i)["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)
    edge = F.aggregate(F.transform(ring, lambda p, i: F.sqrt(F.pow(near(i)["x"] - p["x"], 2) + F.pow(near(i)["y"] - p["y"], 2))), F.lit(0.0), lambda a, v: a + v)
    m = areas.select(key, (F.abs(cross) / 2).alias("area"), edge.alias("perimeter"))
    return m.select(key, "area", "perimeter", F.try_divide(F.col("perimeter"), 2 * F.sqrt(F.pi() * F.col("area"))).alias("compactness"), F.when(F.col("area") > 1, 2 * F.ln("perimeter") / F.ln("area")).alias("fractal"))


def median_centre(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The median and the mean of the coordinates."""
    return points.groupBy(*keys).agg(F.percentile("x", F.lit(0.5)).alias("x_median"), F.percentile("y", F.lit(0.5)).alias("y_median"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))


def bin_points(points: DataFrame, value: str, size: float, methods: Sequence[str]) -> DataFrame:
    """Statistics of the points in each square cell."""
    every = aggregate_methods(value)
    return points.groupBy(F.floor(F.col("x") / size).alias("col"), F.floor(F.col("y") / size).alias("row")).agg(*[every[m].alias(m) for m in methods])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal bins over the range; the maximum is in the last one."""
    lim = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - F.col("_lo"), width))).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(lim)).groupBy(at.alias("bin"), (F.col("_lo") + at * width).alias("start")).agg(F.count(F.lit(1)).alias("n"))  # one row of limits


def buffer_statistics(points: DataFrame, cells: DataFrame, key: str, value: str, radii: Sequence[float], methods: Sequence[str]) -> DataFrame:
    """Statistics of the cells whose centre lies within each radius of each point, by squares as wide as the largest radius."""
    r = max(radii)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = points.select(key, F.col("x").alias("px"), F.col("y").alias("py"), around.alias("m")).select(key, "px", "py", (F.floor(F.col("px") / r) + F.col("m.i")).alias("sx"), (F.floor(F.col("py") / r) + F.col("m.j")).alias("sy"))
    c = cells.select("x", "y", value, F.floor(F.col("x") / r).alias("sx"), F.floor(F.col("y") / r).alias("sy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    met = p.join(c, ["sx", "sy"]).withColumn("_d", d).withColumn("buffer", F.explode(F.array(*[F.lit(float(x)) for x in sorted(radii)]))).where(F.col("_d") <= F.col("buffer"))
    every = aggregate_methods(value)
    return met.groupBy(key, "buffer").agg(*[every[m].alias(m) for m in methods])


def long_statistics(df: DataFrame, keys: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """One row per key and statistic."""
    return df.unpivot(list(keys), list(methods), "statistic", "value")


def profile(points: DataFrame, value: str, start: tuple[float, float], end: tuple[float, float], width: float) -> DataFrame:
    """Points within ``width`` of a line, with their distance along it."""
    (x1, y1), (x2, y2) = start, end
    dx, dy = x2 - x1, y2 - y1
    length = (dx * dx + dy * dy) ** 0.5
    along = ((F.col("x") - x1) * dx + (F.col("y") - y1) * dy) / length
    across = F.abs((F.col("x") - x1) * dy - (F.col("y") - y1) * dx) / length
    return points.where((across <= width) & along.between(0, length)).select("x", "y", value, along.alias("along"), across.alias("across"))


def bearing(x: Column, y: Column, px: float, py: float) -> tuple[Column, Column]:
    """Bearing (degrees clockwise from north, rows run southwards) and distance from a cell to a place."""
    dx, dy = F.lit(px) - x, y - F.lit(py)
    turn = F.degrees(F.atan2(dx, dy))
    return F.when((dx == 0) & (dy == 0), None).when(turn < 0, turn + 360).otherwise(turn), F.sqrt(dx * dx + dy * dy)


def stream_links(lines: DataFrame, key: str, vertices: str) -> DataFrame:
    """Each line with the line that starts where it ends; none at an outlet, the smallest key of several."""
    ends = lines.select(key, F.element_at(vertices, 1).alias("head"), F.element_at(vertices, -1).alias("tail"))
    heads = ends.groupBy(F.col("head").alias("tail")).agg(F.min(key).alias("tostream"))
    return ends.join(heads, "tail", "left").select(key, "tostream")


def sample_grids(points: DataFrame, grids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values of several grids at each point, one lookup for all of them."""
    placed = points.withColumns({"_x": F.floor("x").cast("long"), "_y": F.floor("y").cast("long")})
    g = grids.select(F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), *columns)
    return placed.join(g, ["_x", "_y"], "left").drop("_x", "_y")


def disagreement(pairs: DataFrame, keys: Sequence[str], simulated: str, reference: str) -> DataFrame:
    """Quantity and allocation disagreement of two class maps per key."""
    counts = pairs.groupBy(*keys, simulated, reference).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(
        *keys,
        F.explode(F.array(F.struct(F.col(simulated).alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("h")), F.struct(F.col(reference).alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("r"), F.when(F.col(simulated) == F.col(reference), F.col("n")).otherwise(0).alias("h")))).alias("p"),
    ).select(*keys, "p.*")
    by_class = sides.groupBy(*keys, "c").agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("h").alias("h"))
    total = F.sum("r")
    quantity = F.sum(F.abs(F.col("s") - F.col("r"))) / (2 * total)
    allocation = F.sum(2 * (F.least("s", "r") - F.col("h"))) / (2 * total)
    return by_class.groupBy(*keys).agg(quantity.alias("quantity"), allocation.alias("allocation"), (F.sum("h") / total).alias("agreement"))


def match_histograms(pixels: DataFrame, image: str, value: str) -> DataFrame:
    """For each image the grey value of the mean cumulative histogram that is nearest (the smaller on a tie) to each of its own.

    It works on histograms, whose size is bounded by the number of grey values, not by that of pixels.
    """
    counts = pixels.groupBy(image, value).agg(F.count(F.lit(1)).alias("n"))
    w, whole = Window.partitionBy(image).orderBy(value), Window.partitionBy(image)
    cdf = counts.select(image, value, F.round(F.sum("n").over(w) / F.sum("n").over(whole), 6).alias("cdf"))
    images = pixels.select(image).distinct().count()
    mean = counts.groupBy(value).agg(F.floor(F.sum("n") / images).alias("n"))
    target = mean.select(F.col(value).alias("to"), F.round(F.sum("n").over(Window.orderBy(value)) / F.sum("n").over(Window.partitionBy()), 6).alias("target"))
    # the nearest of a sorted list: put both in one order and look to either side
    both = cdf.select(image, value, "cdf", F.lit(None).cast("struct<target:double,to:bigint>").alias("t")).unionByName(
        pixels.select(image).distinct().crossJoin(target).select(image, F.lit(None).cast(pixels.schema[value].dataType).alias(value), F.col("target").alias("cdf"), F.struct("target", F.col("to").cast("long").alias("to")).alias("t"))
    )  # a row per grey value
    before = Window.partitionBy(image).orderBy("cdf", F.col("t").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(image).orderBy("cdf", F.col("t").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    seen = both.withColumns({"_a": F.last("t", True).over(before), "_b": F.first("t", True).over(after)}).where(F.col("t").isNull())
    first = target.groupBy(F.col("target").alias("_k")).agg(F.min("to").alias("_first"))
    pick = F.when(F.col("_b").isNull() | (F.abs(F.col("_a.target") - F.col("cdf")) <= F.abs(F.col("_b.target") - F.col("cdf"))), F.col("_a.target")).otherwise(F.col("_b.target"))
    return seen.withColumn("_k", pick).join(first, "_k").select(image, value, F.col("_first").cast("long").alias("matched"))


def to_columns(df: DataFrame, keys: Sequence[str], name: str, value: Column) -> DataFrame:
    """An aggregate of each key as a column per value of ``name``; the values are taken from the data, in order."""
    names = [r[0] for r in df.where(F.col(name).isNotNull()).select(name).distinct().orderBy(name).collect()]  # a column each
    return df.groupBy(*keys).pivot(name, names).agg(value) if names else df.select(*keys).distinct()
