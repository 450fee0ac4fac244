"""Closed formulas over cells, areas and points, profiles, streams and patch tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.graph import patch_distances
from cellweave.sources.shared import materialize

#: Column and row step of the eight flow directions, counted anticlockwise from north-east.
DIRECTIONS = ((1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0))

#: Areas of one box that are listed in a row, and pairs that one task writes, roughly.
PART, PAIRS_PER_TASK = 256, 2_000_000


def tasselled_wetness(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    """Wetness component of the tasselled cap of reflectance."""
    # fixed values, by band
    return 0.0315 * blue + 0.2021 * green + 0.3102 * red + 0.1594 * nir - 0.6806 * swir1 - 0.6109 * swir2


def water_index(green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    """The 2015 water index of surface reflectance."""
    # fixed values, by band
    return 1.7204 + 171 * green + 3 * red - 70 * nir - 45 * swir1 - 71 * swir2


def cell_area(latitude: Column, ns: float, ew: float) -> Column:
    """Square metres of a cell of ``ns`` by ``ew`` degrees on a sphere."""
    return 111195.0 * ns * ew * (math.pi / 180) * 6371000.0 * F.cos(F.radians(latitude))


def ramp(place: Column, count: Column | int, low: float, high: float) -> Column:
    """Linear from ``low`` at place 0 to ``high`` at the last of ``count`` places; swap the ends for the other direction."""
    return low + F.try_divide(place * (high - low), F.lit(count) - 1)


def bouguer_anomaly(observed: Column, height: Column, latitude: Column, azimuth: Column, speed: Column, density: Column, terrain: Column) -> Column:
    """Gravity anomaly in mGal of a full slab: metres, degrees, km/h and Mg/m3; the slab's attraction in mGal as well."""
    lat, s2 = F.radians(latitude), lambda v: F.pow(F.sin(v), F.lit(2))
    # fixed values of the 1967 gravity formula and of the free-air, slab and motion corrections
    normal = 978031.8 * (1 + 0.0053024 * s2(lat) - 0.0000059 * s2(2 * lat))
    slab = 2 * math.pi * 6.67398e-3 * density * height
    motion = 4.040 * speed * F.sin(F.radians(azimuth)) * F.cos(lat) + 0.001211 * speed * speed
    return observed + 0.3086 * height - slab + terrain - normal + motion


def critical_rain(slope: Column, area: Column, width: float, *, friction: float, cohesion: float, root: float, density: float, depth: float, conductivity: float) -> Column:
    """Rain in mm a day at which a slope slides: degrees, m2, kg/m3, m and m/h; 9999 m a day more where it always holds, less where it never does; null on level ground."""
    s, phi = F.radians(slope), math.radians(friction)
    c = (root + cohesion) / (depth * F.cos(s) * 9.81 * density)
    flow = conductivity * 24 * depth * F.cos(s) * F.sin(s) * F.try_divide(F.lit(width), area)
    rain = flow * (density / 1000 * (1 - (1 - c / F.sin(s)) * F.tan(s) / math.tan(phi)))
    always = F.when(F.lit((1 - 1000 / density) * math.tan(phi)) > F.tan(s), 9999).otherwise(0)
    never = F.when(c / F.cos(s) + math.tan(phi) < F.tan(s), -9999).otherwise(0)
    return F.when(slope > 0, 1000 * (rain + always + never))


def rain_class(rain: Column) -> Column:
    """1 unstable, 2 to 6 by critical rain up to 30, 100, 150, 200 and 1000 mm, 7 stable."""
    return F.when(rain < 0, 1).when(rain <= 30, 2).when(rain <= 100, 3).when(rain <= 150, 4).when(rain <= 200, 5).when(rain <= 1000, 6).when(rain > 1000, 7)


def maxent(features: Sequence[tuple], normaliser: float, density: float, entropy: float) -> tuple[Column, Column]:
    """Raw and logistic value of a maximum-entropy model.

    A feature is a kind, a column (two for ``product``), a weight and bounds: ``linear``, ``quadratic`` and ``product`` are scaled to the
    bounds, ``forward`` and ``reverse`` hinges rise from the lower and fall to the upper bound, ``threshold`` is 1 from the lower one on.
    """
    total = F.lit(-float(normaliser))
    for kind, columns, weight, low, high in features:
        cols = [F.col(c).cast("double") for c in ((columns,) if isinstance(columns, str) else columns)]
        x = cols[0] * cols[0] if kind == "quadratic" else cols[0] * cols[1] if kind == "product" else cols[0]
        scaled = {
            "threshold": lambda x, low, high: F.when(x >= low, 1.0).otherwise(0.0),
            "forward": lambda x, low, high: F.when(x > low, (x - low) / (high - low)).otherwise(0.0),
            "reverse": lambda x, low, high: F.when(x < high, (high - x) / (high - low)).otherwise(0.0),
        }.get(kind, lambda x, low, high: (x - low) / (high - low))
        total = total + weight * scaled(x, low, high)
    raw = F.exp(total) / density
    return raw, raw * math.exp(entropy) / (1 + raw * math.exp(entropy))


def stream_threshold(cells: DataFrame, acc: str) -> DataFrame:
    """The accumulation whose point (value, number of cells) lies nearest to the origin; ties to the smallest."""
    n = cells.where(F.col(acc).isNotNull()).groupBy(acc).agg(F.count(F.lit(1)).alias("n"))
    d = F.sqrt(F.pow(F.col(acc).cast("double"), F.lit(2)) + F.pow(F.col("n").cast("double"), F.lit(2)))
    return n.agg(F.min(F.struct(d.alias("d"), F.col(acc).alias("threshold"), "n")).alias("m")).select("m.threshold", "m.n")


def width_function(cells: DataFrame, distance: str, side: float, steps: int = 255) -> DataFrame:
    """Area of the cells by distance to the outlet in ``steps`` classes, and the share of all cells up to each."""
    ends = cells.agg(F.min(distance).alias("_lo"), F.max(distance).alias("_hi"))
    at = F.coalesce(F.floor(F.try_divide((F.col(distance) - F.col("_lo")) * F.lit(float(steps)), F.col("_hi") - F.col("_lo"))), F.lit(0))
    binned = cells.where(F.col(distance).isNotNull()).crossJoin(F.broadcast(ends)).select(F.least(at, F.lit(steps - 1)).cast("int").alias("step"), distance)  # one row
    rows = binned.groupBy("step").agg(F.max(distance).alias("distance"), F.count(F.lit(1)).alias("n"))
    upto, every = Window.orderBy("step"), Window.partitionBy()  # a row for each step
    return rows.select("step", "distance", "n", (F.col("n") * side * side).alias("area"), (F.sum("n").over(upto) / F.sum("n").over(every)).alias("share"))


def downstream_slope(cells: DataFrame, elevation: str, direction: str, side: float = 1.0) -> DataFrame:
    """Drop to the cell that each flows into and the gradient of that step; directions count from 1, others flow nowhere."""
    step = F.get(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in DIRECTIONS]), F.col(direction).cast("int") - 1)
    low = cells.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(elevation).alias("_e"))
    here = cells.select("x", "y", F.col(elevation).alias("_z"), step.alias("_s")).select("x", "y", "_z", (F.col("x") + F.col("_s.dx")).alias("_x"), (F.col("y") + F.col("_s.dy")).alias("_y"))
    length = side * F.sqrt(F.abs(F.col("x") - F.col("_x")).cast("double") + F.abs(F.col("y") - F.col("_y")).cast("double"))
    return here.join(low, ["_x", "_y"], "left").select("x", "y", (F.col("_z") - F.col("_e")).alias("difference"), ((F.col("_z") - F.col("_e")) / length).alias("gradient"))


def single_parts(areas: DataFrame, parts: str) -> DataFrame:
    """Each part of a multi-part feature as a row of its own, numbered from 1; the other columns repeat."""
    rest = [c for c in areas.columns if c != parts]
    return areas.select(*rest, F.posexplode(parts).alias("part", "geometry")).withColumn("part", F.col("part") + 1)


def _boxes(areas: DataFrame, ring: str) -> DataFrame:
    coordinate = lambda c: F.transform(ring, lambda p: p[c].cast("double"))
    return areas.withColumns({"_x1": F.array_min(coordinate("x")), "_x2": F.array_max(coordinate("x")), "_y1": F.array_min(coordinate("y")), "_y2": F.array_max(coordinate("y"))})


def levelled(boxes: DataFrame, side: float, corners: Sequence[str] = ("_x1", "_x2", "_y1", "_y2")) -> DataFrame:
    """Boxes with their level ``_l``: the number of times that ``side`` is doubled until a square is as wide as the box."""
    x1, x2, y1, y2 = (F.col(c).cast("double") for c in corners)
    extent = F.greatest(x2 - x1, y2 - y1)
    return boxes.withColumn("_l", F.when(extent > side, F.ceil(F.log2(extent / side))).otherwise(0).cast("int"))


def _square(c: Column, side: float, level: Column) -> Column:
    return F.floor(c.cast("double") / (side * F.pow(F.lit(2.0), level))).cast("long")


def squares(boxes: DataFrame, side: float, corners: Sequence[str] = ("_x1", "_x2", "_y1", "_y2")) -> DataFrame:
    """A row for each square ``_sx, _sy`` of its level ``_l`` that a box touches: four at most if the level is the box's own or a coarser one."""
    x1, x2, y1, y2 = (_square(F.col(c), side, F.col("_l")) for c in corners)
    return boxes.withColumn("_sx", F.explode(F.sequence(x1, x2))).withColumn("_sy", F.explode(F.sequence(y1, y2)))


def levels_of(boxes: DataFrame) -> list[int]:
    """The levels that boxes have, at most one for each doubling."""
    return sorted(r[0] for r in boxes.select("_l").distinct().collect())


def in_squares(points: DataFrame, side: float, levels: Sequence[int]) -> DataFrame:
    """Points once for each level, with their square of it."""
    at = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels))))
    return at.withColumns({"_sx": _square(F.col("x"), side, F.col("_l")), "_sy": _square(F.col("y"), side, F.col("_l"))})


def points_in_areas(points: DataFrame, areas: DataFrame, ring: str, side: float) -> DataFrame:
    """Each point beside every area that it lies in; areas may overlap, and their rings are closed arrays of ``x, y``.

    An area is dealt to the squares that its bounding box touches, of ``side`` or of as many times twice the side as it is wide, so there are four at most; points
    are dealt to their square of each size in use. Boxes decide next, then the parity of the ring's edges that a ray from the point crosses. A point
    on an edge may count either way.
    """
    rest = [c for c in areas.columns if c != ring]
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    boxed = levelled(_boxes(areas, ring).where(F.size(ring) > 3), side)
    levels = levels_of(boxed)
    if not levels:
        return points.join(areas.drop(ring).limit(0), F.lit(False))
    dealt = squares(boxed.select(*rest, "_x1", "_x2", "_y1", "_y2", "_l", edges.alias("_edges")), side)
    px, py = F.col("x").cast("double"), F.col("y").cast("double")
    crosses = lambda e: ((e["a"]["y"] > py) != (e["b"]["y"] > py)) & (px < (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    met = in_squares(points, side, levels).join(dealt, ["_l", "_sx", "_sy"]).where(px.between(F.col("_x1"), F.col("_x2")) & py.between(F.col("_y1"), F.col("_y2")))
    return met.where(F.size(F.filter("_edges", crosses)) % 2 == 1).select(*points.columns, *rest)


def sums_in_areas(points: DataFrame, areas: DataFrame, key: str, ring: str, value: str, side: float) -> DataFrame:
    """Each area that holds points, with their number ``n`` and the ``total`` of their values (rows of ``points`` whose value is null count, too).

    Points at one place and areas of one ring are gathered before they meet, so the work grows with distinct places and rings, not with how many lie in one another.
    """
    places = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    shapes = areas.select(ring).distinct().withColumn("_shape", F.col(ring))
    sums = points_in_areas(places, shapes, ring, side).groupBy("_shape").agg(F.sum("_n").alias("n"), F.sum("_s").alias("total"))
    return areas.select(key, F.col(ring).alias("_shape")).join(sums, "_shape").groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def overlapping_boxes(areas: DataFrame, key: str, ring: str, side: float) -> DataFrame:
    """Pairs ``a < b`` of areas whose bounding boxes overlap.

    Equal boxes are one until their pairs are known. A box lives in the squares of its own size, four at most, and visits those of every larger size in use, so two boxes meet in squares of the larger
    one's size; a pair counts in the square of its common corner only. The areas of a box are then listed in parts of about ``PART``, and pairs of parts are dealt evenly over
    tasks, which write a row for each pair of areas: the rows may grow with the square of the areas, a task's don't.
    """
    corners = ["_x1", "_x2", "_y1", "_y2"]
    each = materialize(_boxes(areas.select(F.col(key).alias("k"), ring), ring).where(F.col("k").isNotNull() & F.col("_x1").isNotNull() & F.col("_y1").isNotNull()).select("k", F.struct(*corners).alias("box")), "boxes")
    counts = materialize(each.groupBy("box").agg(F.count(F.lit(1)).alias("n")), "counts")
    boxed = levelled(counts.select("box", "n", "box.*"), side)
    levels = levels_of(boxed)
    if not levels:
        return areas.select(F.col(key).alias("a"), F.col(key).alias("b")).limit(0)
    visits = boxed.withColumn("_own", F.col("_l")).withColumn("_l", F.explode(F.array(*map(F.lit, levels)))).where("_l >= _own")
    end = lambda df, n: squares(df, side).select("_l", "_sx", "_sy", F.col("box").alias(n), F.col("n").alias(f"{n}n"), *[F.col(c).alias(f"{n}{c[1:]}") for c in corners], *(["_own"] if n == "v" else []))
    met = end(boxed, "r").join(end(visits, "v"), ["_l", "_sx", "_sy"]).where("r <> v AND rx1 <= vx2 AND vx1 <= rx2 AND ry1 <= vy2 AND vy1 <= ry2 AND (_own < _l OR r < v)")
    corner = (_square(F.greatest("rx1", "vx1"), side, F.col("_l")) == F.col("_sx")) & (_square(F.greatest("ry1", "vy1"), side, F.col("_l")) == F.col("_sy"))
    alone = counts.where("n > 1").select(F.col("box").alias("r"), F.col("box").alias("v"), F.col("n").alias("rn"), F.col("n").alias("vn"))
    pairs = materialize(met.where(corner).select("r", "v", "rn", "vn").unionByName(alone), "pairs")
    rows = pairs.agg(F.coalesce(F.sum(F.col("rn").cast("double") * F.col("vn")), F.lit(0.0))).first()[0]
    parts = lambda n: F.ceil(F.col(n) / PART)
    listed = each.join(counts, "box").groupBy("box", F.pmod(F.xxhash64("k"), parts("n")).alias("part")).agg(F.collect_list("k").alias("keys"))  # about PART each
    listed = materialize(listed, "listed")
    part = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(f"{n}n") - 1))
    dealt = pairs.withColumn("i", part("r")).withColumn("j", part("v")).where("r <> v OR i <= j")
    for n, at in (("r", "i"), ("v", "j")):
        dealt = dealt.join(listed.select(F.col("box").alias(n), F.col("part").alias(at), F.col("keys").alias(f"{n}k")), [n, at])
    once = (F.col("r") == F.col("v")) & (F.col("i") == F.col("j"))
    even = dealt.select(once.alias("once"), "rk", "vk").repartition(int(min(10_000, max(8, rows // PAIRS_PER_TASK))))
    each_pair = even.select("once", "vk", F.explode("rk").alias("p")).select("once", "p", F.explode("vk").alias("q")).where("p < q OR NOT once AND q < p")
    return each_pair.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def attributes_to_cells(zones: DataFrame, attributes: DataFrame, key: str, columns: Sequence[str], digits: int = 0) -> DataFrame:
    """A whole-number column for each numeric attribute, scaled by ten to the ``digits`` in decimals (4564.275 becomes 456428, not 456427.5 less a bit of binary), at the cells of each key."""
    scaled = attributes.select(key, *[F.round(F.col(c).cast("decimal(38,10)") * 10**digits).cast("long").alias(c) for c in columns])
    return zones.select("x", "y", key).join(scaled, key, "left").select("x", "y", key, *columns)


def patch_table(cells: DataFrame, patch: str, value: str) -> DataFrame:
    """Area and value statistics of each patch."""
    v = F.col(value)
    return cells.groupBy(patch).agg(F.count(F.lit(1)).alias("area"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"))


def patch_import(cells: DataFrame, patch: str, values: DataFrame, value: str) -> DataFrame:
    """The value listed for each patch at its cells; null where none is."""
    return cells.join(values.select(patch, value), patch, "left").select("x", "y", patch, value)


def patch_surroundings(clumped: DataFrame, values: DataFrame, value: str, least: float, most: int) -> DataFrame:
    """Number, mean and largest value of the patches whose borders lie from ``least`` to ``most`` cells away from each patch."""
    d = patch_distances(clumped, most).where(F.col("d") >= least)
    both = d.select(F.explode(F.array(F.struct(F.col("a").alias("clump"), F.col("b").alias("other")), F.struct(F.col("b").alias("clump"), F.col("a").alias("other")))).alias("p")).select("p.*")
    near = both.join(values.select(F.col("clump").alias("other"), F.col(value).alias("_v")), "other").groupBy("clump").agg(F.count("_v").alias("neighbours"), F.avg("_v").alias("mean"), F.max("_v").alias("largest"))
    return values.select("clump").join(near, "clump", "left").select("clump", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "mean", "largest")


def scatter_trend(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Number, least-squares line and R2 of ``b`` against ``a`` in each group; rows where either is null don't count."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def volume_profile(voxels: DataFrame, value: str, start: Sequence[float], end: Sequence[float], steps: int) -> DataFrame:
    """Values of a volume at ``steps`` + 1 points of a line, with the distance from its start; null outside."""
    line = voxels.sparkSession.range(steps + 1).withColumn("_t", F.col("id") / steps)
    at = {c: F.floor(F.lit(float(s)) + F.col("_t") * (e - s)).cast("long") for c, s, e in zip("xyz", start, end, strict=True)}
    places = line.withColumns(at).select(F.col("id").alias("step"), (F.col("_t") * math.dist(start, end)).alias("distance"), "x", "y", "z")
    return places.join(voxels.select(*[F.col(c).cast("long").alias(c) for c in "xyz"], value), ["x", "y", "z"], "left").select("step", "distance", value)


def lunar_content(name: str, first: Column, second: Column) -> Column:
    """Iron or titanium oxide, or optical maturity, of the Moon from two bands: reflectance at 750 nm and at 950 nm (415 nm for titanium)."""
    ratio = F.try_divide(second, first)
    step = F.try_divide(-(ratio - 1.22), first - 0.04)
    # fixed values of the published calibrations
    return {
        "feo_lucey_2000": lambda: 17.427 * -F.atan2(ratio - 1.19, first - 0.08) - 7.565,
        "feo_lawrence_2002": lambda: 5.7 * (-0.147 + 0.372 * step - 0.036 * step * step) + 2.15,
        "feo_wilcox_2005": lambda: -137.97 * (0.9834 * first + 0.1813 * ratio) + 57.46,
        "feo_zhang_2013": lambda: 17.83 * -F.atan2(ratio - 1.26, first - 0.01) - 6.82,
        "omat_lucey_2000": lambda: F.sqrt((first - 0.08) * (first - 0.08) + (ratio - 1.19) * (ratio - 1.19)),
        "omat_wilcox_2005": lambda: 0.1813 * first - 0.9834 * ratio,
        "tio2_lucey_2000": lambda: 3.708 * F.pow(F.atan2(ratio - 0.42, first), F.lit(5.979)),
    }[name]()


def green_vegetation(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    """Greenness component of the tasselled cap; -1 where red and near infrared add up to 0."""
    # fixed values, by band
    return F.when(red + nir == 0, F.lit(-1.0)).otherwise(-0.2848 * blue - 0.2435 * green - 0.5436 * red + 0.7243 * nir + 0.0840 * swir1 - 0.1800 * swir2)


def perpendicular_vegetation(red: Column, nir: Column) -> Column:
    """Near infrared over red, each by its side of a soil line at an angle of 1; -1 where both add up to 0, null without red."""
    return F.when(red + nir == 0, F.lit(-1.0)).otherwise(F.try_divide(math.sin(1.0) * nir, math.cos(1.0) * red))
