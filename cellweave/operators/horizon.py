"""What can be seen over a grid: horizons along lines, sky, and what observers see."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.focal import neighbours
from cellweave.sources.shared import materialize

#: A line of sight that only touches a cell's corner isn't held up by it.
TOUCH = 1e-9


def rays(reach: int = 1) -> list[tuple[int, int]]:
    """Half of the directions to cells of a square window that no nearer cell lies on: 4 for ``reach`` 1, 8 for 2, 16 for 3; the others are their opposites."""
    r = range(-reach, reach + 1)
    return [(i, j) for i in r for j in r if (i, j) > (0, 0) and math.gcd(i, j) == 1]


def _ahead(t: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Steepest rise from each point to any later one, per unit of ``t``; null at the last. Points that a later view can't touch leave the hull, so each is passed once."""
    out, hull = np.full(len(t), np.nan), []
    t, z = t.tolist(), z.tolist()
    for i in range(len(t) - 1, -1, -1):
        rise = lambda k: (z[k] - z[i]) / (t[k] - t[i])  # noqa: B023, E731
        while len(hull) > 1 and rise(hull[-2]) >= rise(hull[-1]):
            hull.pop()
        if hull:
            out[i] = rise(hull[-1])
        hull.append(i)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, one run after the other, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def horizons(cells: DataFrame, height: str, directions: Sequence[tuple[int, int]], side: float = 1.0) -> DataFrame:
    """``x, y, dx, dy, rise`` for each cell, direction and its opposite: the steepest rise to any cell that lies that way, however far; null without one.

    A direction parts the grid into lines of cells; a line is one group, as long as the grid at most, and is passed once each way with the
    upper hull of what has been passed. So cells travel once for each pair of directions, whatever the distance of the horizon.
    """
    way = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in directions])).alias("m")
    z = F.col(height).cast("double")
    dealt = cells.where(z.isNotNull() & ~F.isnan(z)).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), z.alias("z"), way).select("*", "m.dx", "m.dy").drop("m")
    line = F.col("x") * F.col("dy") - F.col("y") * F.col("dx")
    place = F.when(F.col("dx") == 0, F.col("y")).otherwise(F.floor(F.col("x") / F.col("dx")))
    keys = ["dx", "dy", "line"]
    dealt = dealt.withColumns({"line": line, "place": place}).repartition(*keys).sortWithinPartitions(*keys, "place")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, keys):
            t, z = run.column("place").to_numpy().astype(float), run.column("z").to_numpy()
            dx, dy = int(run.column("dx")[0].as_py()), int(run.column("dy")[0].as_py())
            length, n = math.hypot(dx, dy) * side, len(t)
            for sign, rise in ((1, _ahead(t, z)), (-1, _ahead(-t[::-1], z[::-1])[::-1])):
                rise = rise / length
                yield pa.RecordBatch.from_arrays(
                    [run.column("x").combine_chunks(), run.column("y").combine_chunks(), pa.array(np.full(n, sign * dx, np.int32)), pa.array(np.full(n, sign * dy, np.int32)), pa.array(rise, mask=np.isnan(rise))],
                    ["x", "y", "dx", "dy", "rise"],
                )

    return dealt.mapInArrow(scan, "x long, y long, dx int, dy int, rise double")


def sky_view(cells: DataFrame, height: str, directions: Sequence[tuple[int, int]], side: float = 1.0) -> DataFrame:
    """``x, y, sky, openness``: one less the mean sine of the horizon's angles, without and with those below the level; nothing in the way counts as level."""
    rise = F.coalesce("rise", F.lit(0.0))
    sine = rise / F.sqrt(1 + rise * rise)
    return horizons(cells, height, directions, side).groupBy("x", "y").agg((1 - F.avg(F.greatest(sine, F.lit(0.0)))).alias("sky"), (1 - F.avg(sine)).alias("openness"))


def viewsheds(observers: DataFrame, key: str, cells: DataFrame, height: str, eye: float, reach: int, target: float = 0.0, sectors: int = 64) -> DataFrame:
    """Cells ``key, x, y, distance, rise`` that each observer at ``x, y``, ``eye`` above the ground, sees within ``reach`` cells.

    A cell is seen if the line to its centre, ``target`` above the ground, rises more than the one to each nearer cell that it passes over (more than touches a corner of). The
    observer's own cell is seen. Cells are dealt to the sectors of azimuth that they reach into, near ones to several, and a sector's cells are
    passed by distance with the highest rise so far at each of its targets' azimuths, so the work grows with the cells, not with pairs of them.
    Observers without a cell of known height have no rows. There are four sectors at least, so that no cell reaches round the back of one.
    """
    sectors = max(4, sectors)
    square = lambda c: F.floor(F.col(c) / reach).cast("long")
    z = F.col(height).cast("double")
    ground = cells.where(z.isNotNull() & ~F.isnan(z)).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), z.alias("z"))
    stand = observers.select(F.col(key).cast("long").alias("o"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).join(ground, ["x", "y"])
    stand = materialize(stand.select("o", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("z") + eye).alias("oz")), "observers")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    looks = stand.withColumn("m", around).select("o", "ox", "oy", "oz", (square("ox") + F.col("m.i")).alias("sx"), (square("oy") + F.col("m.j")).alias("sy"))
    met = ground.withColumns({"sx": square("x"), "sy": square("y")}).join(looks, ["sx", "sy"]).withColumns({"dx": F.col("x") - F.col("ox"), "dy": F.col("y") - F.col("oy")})
    met = met.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).where(F.col("d2") <= reach * reach)
    own = met.where("d2 = 0").select("o", "x", "y", F.lit(0.0).alias("distance"), F.lit(None).cast("double").alias("rise"))

    dx, dy = F.col("dx").cast("double"), F.col("dy").cast("double")
    corners = [F.atan2(dx * (dy + j) - dy * (dx + i), dx * (dx + i) + dy * (dy + j)) for i in (-0.5, 0.5) for j in (-0.5, 0.5)]
    at = F.atan2(dy, dx)
    width = 2 * math.pi / sectors
    sector = lambda a: F.floor((a + math.pi) / width).cast("int")
    seen = met.where("d2 > 0").select("o", "x", "y", "d2", F.sqrt("d2").alias("d"), ((F.col("z") - F.col("oz")) / F.sqrt("d2")).alias("block"), ((F.col("z") + target - F.col("oz")) / F.sqrt("d2")).alias("rise"), at.alias("at"), (at + F.least(*corners)).alias("low"), (at + F.greatest(*corners)).alias("high"))
    dealt = seen.withColumns({"k": F.explode(F.sequence(sector(F.col("low")), sector(F.col("high")))), "home": F.least(sector(F.col("at")), F.lit(sectors - 1))})
    dealt = dealt.withColumns({"mine": F.col("k") == F.col("home"), "k": F.pmod("k", F.lit(sectors))})
    keys = ["o", "k"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "d2")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, keys):
            middle = (run.column("k")[0].as_py() + 0.5) * width - math.pi
            turn = lambda name: (run.column(name).to_numpy() - middle + math.pi) % (2 * math.pi) - math.pi  # noqa: B023, E731
            mine = run.column("mine").to_numpy()
            ats = turn("at")
            span = ats - run.column("at").to_numpy()
            places = np.unique(ats[mine])
            first = np.searchsorted(places, run.column("low").to_numpy() + span + TOUCH, "right")
            last = np.searchsorted(places, run.column("high").to_numpy() + span - TOUCH, "left")
            ok = _passed(run.column("d2").to_numpy(), run.column("block").to_numpy(), run.column("rise").to_numpy(), first, last, np.searchsorted(places, ats), mine, len(places))
            got = run.filter(pa.array(ok)).select(["o", "x", "y", "d", "rise"])
            yield from got.combine_chunks().to_batches()

    view = dealt.mapInArrow(look, "o long, x long, y long, d double, rise double").withColumnRenamed("d", "distance")
    return view.unionByName(own).withColumnRenamed("o", key)


def _passed(d2: np.ndarray, block: np.ndarray, rise: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, mine: np.ndarray, n: int) -> np.ndarray:
    """Which targets rise above all nearer cells; rows by distance. Cells of one distance don't hide each other."""
    high, ok = np.full(n + 1, -np.inf), np.zeros(len(d2), bool)
    step = np.flatnonzero(np.diff(d2)) + 1
    for a, b in zip([0, *step.tolist()], [*step.tolist(), len(d2)], strict=True):
        ok[a:b] = mine[a:b] & (rise[a:b] > high[np.minimum(place[a:b], n)])
        for i in range(a, b):
            if first[i] < last[i]:
                part = high[first[i] : last[i]]
                np.maximum(part, block[i], out=part)
    return ok


def visibility(views: DataFrame, key: str) -> DataFrame:
    """``x, y, observers, nearest`` of the cells that anyone sees: by how many, and how far the nearest of them is."""
    return views.groupBy("x", "y").agg(F.count(F.lit(1)).alias("observers"), F.min("distance").alias("nearest"))


def exposure(views: DataFrame, key: str, weights: DataFrame, weight: str, full: float, power: float = 2.0) -> DataFrame:
    """``x, y, exposure``: the weights of the observers that see each cell, whole up to ``full`` cells and falling with distance to ``power`` beyond."""
    fall = F.when(F.col("distance") <= full, 1.0).otherwise(F.pow(F.lit(full) / F.col("distance"), F.lit(power)))
    return views.join(weights.select(F.col(key), F.col(weight).alias("_w")), key).groupBy("x", "y").agg(F.sum(F.col("_w") * fall).alias("exposure"))


def skyline(views: DataFrame, key: str, sectors: int, observers: DataFrame) -> DataFrame:
    """For each observer (``x, y``) and sector of azimuth (counter-clockwise from the positive x axis): the seen cell that rises most, ties to the nearest, and the farthest one.

    ``key, sector, x, y, rise, distance, farthest``: the first five are the skyline, ``farthest`` where the seen ground ends.
    """
    at = observers.select(key, F.col("x").cast("long").alias("_ox"), F.col("y").cast("long").alias("_oy"))
    turn = F.atan2((F.col("y") - F.col("_oy")).cast("double"), (F.col("x") - F.col("_ox")).cast("double"))
    sector = F.least(F.floor(F.pmod(turn + TOUCH, F.lit(2 * math.pi)) / (2 * math.pi / sectors)), F.lit(sectors - 1)).cast("int")
    best: Column = F.max(F.struct("rise", (-F.col("distance")).alias("near"), "x", "y"))
    top = views.where("distance > 0").join(at, key).groupBy(key, sector.alias("sector")).agg(best.alias("b"), F.max("distance").alias("farthest"))
    return top.select(key, "sector", "b.x", "b.y", "b.rise", (-F.col("b.near")).alias("distance"), "farthest")


def survey(views: DataFrame, key: str, observers: DataFrame, cells: DataFrame, height: str, eye: float) -> DataFrame:
    """``x, y, observers, angle, distance``: how many see each cell, the best angle (degrees between its surface's normal and a line of sight, 0 is straight on) and the nearest in space.

    The normal comes from the differences of the four neighbours, one-sided where one is missing.
    """
    near = neighbours(cells.select("x", "y", F.col(height).cast("double").alias("z")), [(1, 0), (-1, 0), (0, 1), (0, -1)], ["z"])
    side = lambda i, j: F.max(F.when((F.col("dx") == i) & (F.col("dy") == j), F.col("n_z")))
    steep = near.groupBy("x", "y").agg(F.first("z").alias("z"), *[side(i, j).alias(n) for n, i, j in (("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1))])

    def slope(a: str, b: str) -> Column:
        return F.coalesce((F.col(a) - F.col(b)) / 2, F.col(a) - F.col("z"), F.col("z") - F.col(b), F.lit(0.0))

    steep = steep.select("x", "y", "z", slope("e", "w").alias("gx"), slope("n", "s").alias("gy"))
    at = observers.select(key, F.col("x").alias("ox"), F.col("y").alias("oy")).join(steep.select(F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("z") + eye).alias("oz")), ["ox", "oy"])
    both = views.where("distance > 0").join(steep, ["x", "y"]).join(at, key)
    vx, vy, vz = ((F.col(o) - F.col(c)).cast("double") for o, c in (("ox", "x"), ("oy", "y"), ("oz", "z")))
    length = F.sqrt(vx * vx + vy * vy + vz * vz)
    cosine = (vz - F.col("gx") * vx - F.col("gy") * vy) / (length * F.sqrt(1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("observers"), F.min(angle).alias("angle"), F.min(length).alias("distance"))
