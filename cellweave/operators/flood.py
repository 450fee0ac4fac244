"""Levels at which water passes over a grid: depressions, lakes and coarse channels; and what lies at the end of pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.focal import neighbours
from cellweave.operators.graph import clumps
from cellweave.sources.shared import discard, materialize

#: Stands for all outlets in the graph of basins.
OUTSIDE = -1
HALF = [(1, 0), (0, 1), (1, 1), (1, -1)]
AROUND = HALF + [(-i, -j) for i, j in HALF]


def ends(pointers: DataFrame, key: str, to: str, sums: Sequence[str] = ()) -> DataFrame:
    """The last node of the path from each node along ``to``, as ``root``, and each column's sum over the path's nodes but the root, as ``path_<column>``.

    A pointer that is null or leads to no node ends the path. Steps double each round, so a path of a million nodes takes 20 rounds. A loop is an error.
    """
    paths = [f"path_{c}" for c in sums]
    start = pointers.select(F.col(key).alias("id"), F.col(to).alias("to"), *[F.col(c).cast("double").alias(p) for c, p in zip(sums, paths, strict=True)])
    known = start.select(F.col("id").alias("to"), F.lit(True).alias("_in"))
    last = F.col("_in").isNull()
    start = start.join(known, "to", "left")
    now = materialize(start.select("id", F.when(last, F.col("id")).otherwise(F.col("to")).alias("to"), last.alias("end"), *[F.when(last, 0.0).otherwise(F.col(p)).alias(p) for p in paths]), "pointers")
    for _ in range(max(1, now.count()).bit_length() + 1):
        if not now.where(~F.col("end")).take(1):
            return now.select(F.col("id").alias(key), F.col("to").alias("root"), *paths)
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("end").alias("_end"), *[F.col(p).alias(f"_{p}") for p in paths])
        hop = now.join(ahead, "to").select("id", F.col("_to").alias("to"), F.col("_end").alias("end"), *[(F.col(p) + F.col(f"_{p}")).alias(p) for p in paths])
        before, now = now, materialize(hop, "pointers")
        discard(before)
    raise ValueError("the pointers form a loop")


def _numbered(cells: DataFrame, height: str, width: int) -> DataFrame:
    return cells.where(F.col(height).isNotNull() & ~F.isnan(F.col(height).cast("double"))).select("x", "y", (F.col("y") * width + F.col("x")).cast("long").alias("id"), F.col(height).cast("double").alias("z"))


def _lowest_of_8(ground: DataFrame) -> DataFrame:
    """``id, x, y, z, to, n``: the lowest of a cell's neighbours if it is lower (ties to the smaller number), and how many there are."""
    low = neighbours(ground, AROUND, ["id", "z"]).groupBy("id").agg(F.min(F.struct("n_z", "n_id")).alias("low"), F.count(F.lit(1)).alias("n"))
    to = F.when(F.struct(F.col("low.n_z"), F.col("low.n_id")) < F.struct("z", "id"), F.col("low.n_id"))
    return ground.join(low, "id", "left").select("id", "x", "y", "z", to.alias("to"), F.coalesce("n", F.lit(0)).alias("n"))


def flow_pointers(cells: DataFrame, height: str, width: int) -> DataFrame:
    """``id, z, to, length`` of each cell: the lowest neighbour that is lower, null in a pit, and how far it is in cells."""
    dx, dy = (F.abs(f(F.col("id")) - f(F.col("to"))) for f in (lambda c: F.pmod(c, F.lit(width)), lambda c: F.floor(c / width)))
    return _lowest_of_8(_numbered(cells, height, width)).select("id", "z", "to", F.sqrt((dx * dx + dy * dy).cast("double")).alias("length"))


def spill_levels(cells: DataFrame, height: str, width: int, outlets: DataFrame | None = None) -> DataFrame:
    """The lowest level at which water at each cell has a way over the 8 neighbours to an outlet: ``x, y, z, level``.

    Without ``outlets`` (``x, y``) the cells beside the grid's edge, a hole or a null height are outlets; a part that reaches none has a null level. Each cell points to
    the lowest of its neighbours, which parts the grid into basins. Basins are joined by their lowest pass in rounds: the level of all that a pass joins
    is at least the pass, as it is the lowest way out. Every round leaves at most half of the basins and the lowest pass between each two of them, so a few
    passes over a shrinking table of passes solve grids of any size. Ties go to the smaller cell number ``y * width + x``.
    """
    ground = materialize(_numbered(cells, height, width), "ground")
    at = _lowest_of_8(ground)
    if outlets is None:
        drains = F.col("n") < len(AROUND)
    else:
        at = at.join(outlets.select("x", "y", F.lit(True).alias("_drains")).distinct(), ["x", "y"], "left")
        drains = F.coalesce("_drains", F.lit(False))
    pointed = materialize(at.select("id", F.when(~drains, F.col("to")).alias("to"), drains.alias("drains")), "pointed")
    basin = ends(pointed, "id", "to")
    drained = pointed.where("drains").select(F.col("id").alias("root"), F.lit(True).alias("_out"))
    basin = materialize(basin.join(drained, "root", "left").select("id", F.when(F.col("_out"), OUTSIDE).otherwise(F.col("root")).alias("basin")), "basins")

    of = lambda end: basin.select(F.col("id").alias(f"{end}_id"), F.col("basin").alias(end))
    passes = neighbours(ground, HALF, ["id", "z"]).select(F.col("id").alias("a_id"), F.col("n_id").alias("b_id"), F.greatest("z", "n_z").alias("w")).join(of("a"), "a_id").join(of("b"), "b_id")
    level = _levels(basin.select("basin").where(F.col("basin") != OUTSIDE).distinct(), passes.select("a", "b", "w"))
    out = ground.join(basin, "id").join(level, "basin", "left")
    return out.select("x", "y", "z", F.when(F.col("basin") == OUTSIDE, F.col("z")).when(F.col("spill").isNotNull(), F.greatest("z", "spill")).alias("level"))


def _lowest(passes: DataFrame) -> DataFrame:
    """The lowest pass between each two basins."""
    return passes.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))


def _levels(basins: DataFrame, passes: DataFrame) -> DataFrame:
    """``basin, spill``: the highest pass on the best way from each basin to ``OUTSIDE``; no row without a way."""
    links = materialize(_lowest(passes), "passes")
    open_ = basins.select("basin", F.col("basin").alias("group"), F.lit(float("-inf")).alias("spill"))
    done = None
    while links.take(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(F.col("a") != OUTSIDE)
        first = both.groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("m"))
        first = materialize(first.select("a", (F.col("m.lo") + F.col("m.hi") - F.col("a")).alias("b"), F.col("m.w").alias("w")), "first")
        # Two that chose each other would be a loop; the smaller one stays. Longer loops can't be, as passes are in a strict order.
        back = first.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("_back"))
        root = first.join(back, ["a", "b"], "left").select("a", F.when(F.col("_back") & (F.col("a") < F.col("b")), None).otherwise(F.col("b")).alias("b"))
        reached = first.where(F.col("b") == OUTSIDE).limit(1).select(F.lit(OUTSIDE).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
        root = materialize(ends(root.unionByName(reached), "a", "b"), "joined")
        moved = open_.join(first.select(F.col("a").alias("group"), "w"), "group").join(root.withColumnRenamed("a", "group"), "group")
        moved = materialize(moved.select("basin", F.col("root").alias("group"), F.greatest("spill", "w").alias("spill")), "moved")
        settled = moved.where(F.col("group") == OUTSIDE).select("basin", "spill")
        done = settled if done is None else done.unionByName(settled)
        at = lambda end: root.select(F.col("a").alias(end), F.col("root").alias(f"{end}2"))  # noqa: B023, E731
        new = lambda end: F.coalesce(F.col(f"{end}2"), F.col(end)).alias(end)
        last = links
        links = materialize(_lowest(links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(new("a"), new("b"), "w")), "passes")
        open_ = moved.where(F.col("group") != OUTSIDE)
        for table in (last, first, root):
            discard(table)
    return done if done is not None else open_.select("basin", "spill").limit(0)


def fill_depressions(cells: DataFrame, height: str, width: int, most_cells: int | None = None, outlets: DataFrame | None = None) -> DataFrame:
    """``x, y, z, filled, depth, depression``: each depression filled up to where it spills, or only those of at most ``most_cells`` cells.

    A depression is a clump of neighbouring cells that are below their level; its number is its smallest cell number. What reaches no
    outlet stays as it is.
    """
    level = materialize(spill_levels(cells, height, width, outlets), "levels")
    sunk = clumps(level.where("level > z").select("x", "y", F.lit(1).alias("_c")), "_c", width, diagonal=True).select("x", "y", F.col("clump").cast("long").alias("depression"))
    sunk = materialize(sunk, "sunk")
    keep = sunk.groupBy("depression").agg(F.count(F.lit(1)).alias("_n"))
    small = keep if most_cells is None else keep.where(F.col("_n") <= most_cells)
    both = level.join(sunk, ["x", "y"], "left").join(small, "depression", "left")
    filled = F.when(F.col("_n").isNotNull(), F.col("level")).otherwise(F.col("z"))
    return both.select("x", "y", "z", filled.alias("filled"), (filled - F.col("z")).alias("depth"), "depression")


def lake_series(cells: DataFrame, height: str, width: int, seeds: DataFrame, levels: Sequence[float]) -> DataFrame:
    """``x, y, level, depth`` of the lake that the seeds fill at each water level: what they reach over cells below it. One flood serves all levels."""
    reach = materialize(spill_levels(cells, height, width, seeds).where("level IS NOT NULL"), "reach")
    water = F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("water")
    return reach.select("x", "y", "z", "level", water).where("level < water").select("x", "y", F.col("water").alias("level"), (F.col("water") - F.col("z")).alias("depth"))


def coarse_channels(cells: DataFrame, height: str, streams: DataFrame, factor: int) -> DataFrame:
    """Means of ``factor`` by ``factor`` cells; where streams (``x, y``) cross them, the mean of the stream's cells, so that channels stay deep."""
    on = streams.select("x", "y", F.lit(True).alias("_s")).distinct()
    part = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    channel: Column = F.avg(F.when(F.col("_s"), F.col(height)))
    return cells.join(on, ["x", "y"], "left").groupBy(part("x"), part("y")).agg(F.coalesce(channel, F.avg(height)).alias("z"), F.coalesce(F.max("_s"), F.lit(False)).alias("stream"))


def stream_basins(cells: DataFrame, key: str, to: str, outlets: DataFrame) -> DataFrame:
    """The outlet (``id, outlet``) that each cell drains to first, with the cells on the way: ``key, basin, steps``; cells that reach none have a null basin."""
    cut = outlets.select(F.col("id").alias(key), F.col("outlet").alias("_o"))
    stop = cells.select(key, to).join(cut, key, "left").select(key, F.when(F.col("_o").isNull(), F.col(to)).alias(to), F.lit(1.0).alias("steps"))
    found = ends(stop, key, to, ["steps"])
    return found.join(cut.withColumnRenamed(key, "root"), "root", "left").select(key, F.col("_o").alias("basin"), F.col("path_steps").cast("long").alias("steps"))


def stream_distances(cells: DataFrame, key: str, to: str, length: str, elevation: str, streams: DataFrame) -> DataFrame:
    """Way along the flow to the first stream cell (``id``) and height above it: ``key, stream, distance, difference``; nulls where none is reached."""
    on = streams.select(F.col("id").alias(key), F.lit(True).alias("_s")).distinct()
    stop = cells.select(key, to, length).join(on, key, "left").select(key, F.when(F.col("_s").isNull(), F.col(to)).alias(to), length)
    found = ends(stop, key, to, [length]).join(on.withColumnRenamed(key, "root"), "root", "left")
    z = lambda name: cells.select(F.col(key).alias(name), F.col(elevation).cast("double").alias(f"_z_{name}"))
    hit = found.withColumn("stream", F.when(F.col("_s"), F.col("root"))).join(z("stream"), "stream", "left").join(z(key), key)
    return hit.select(key, "stream", F.when(F.col("_s"), F.col(f"path_{length}")).alias("distance"), (F.col(f"_z_{key}") - F.col("_z_stream")).alias("difference"))
