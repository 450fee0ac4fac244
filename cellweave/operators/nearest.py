"""The k nearest points of any place, in any number of dimensions, and what is interpolated from them."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.ordered import running
from cellweave.sources.shared import discard, materialize

#: A square with so many points or fewer isn't split; the smallest squares have a side of the whole over two to the power of ``DEEPEST``.
LEAF, DEEPEST = 8, 30


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _placed(df: DataFrame, at: Sequence[str], key: Column, *rest: Column) -> DataFrame:
    """``key, c0, c1, ...`` and the rest, of rows with finite coordinates."""
    names = [f"c{i}" for i in range(len(at))]
    out = df.select(key.alias("key"), *[F.col(c).cast("double").alias(n) for c, n in zip(at, names, strict=True)], *rest)
    return out.where(functools.reduce(lambda a, b: a & b, map(_finite, names)))


class _Squares:
    """Squares (cubes) of side ``side / 2**level`` over all places, numbered by dimension ``u0, u1, ...``."""

    def __init__(self, dims: int, low: list[float], side: float):
        self.dims, self.low, self.side = dims, low, side
        self.u, self.c = [f"u{i}" for i in range(dims)], [f"c{i}" for i in range(dims)]

    def numbers(self, level: int) -> dict[str, Column]:
        """The square of coordinates; those on the far border belong to the last one."""
        n = 2**level
        return {u: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - F.lit(lo)) / F.lit(self.side) * n))).cast("long") for u, c, lo in zip(self.u, self.c, self.low, strict=True)}

    def above(self, levels: Column | int) -> list[Column]:
        return [F.call_function("shiftright", F.col(u), levels if isinstance(levels, Column) else F.lit(levels)).alias(u) for u in self.u]

    def far(self, nearest: bool) -> Column:
        """Distance from the coordinates to the nearest or the farthest point of a square ``level, u0, u1, ...``."""
        size = F.lit(self.side) / F.pow(F.lit(2.0), F.col("level"))
        parts = []
        for u, c, lo in zip(self.u, self.c, self.low, strict=True):
            a, b = F.lit(lo) + F.col(u) * size - F.col(c), F.col(c) - F.lit(lo) - (F.col(u) + 1) * size
            d = F.greatest(a, b, F.lit(0.0)) if nearest else F.greatest(F.abs(a), F.abs(b))
            parts.append(d * d)
        slack = 1 - 1e-9 if nearest else 1 + 1e-9  # numbers of squares are rounded
        return F.sqrt(sum(parts[1:], parts[0])) * slack + (-1e-12 if nearest else 1e-12) * self.side


def _tree(points: DataFrame, squares: _Squares, level: int) -> tuple[DataFrame, DataFrame]:
    """All squares ``level, u.., n, leaf`` that hold points, from the whole down to leaves, and the points with their leaf.

    Counts above ``level`` are sums of counts; below it only points of squares with more than ``LEAF`` are numbered again, level by level.
    """
    u = squares.u
    now = materialize(points.withColumns(squares.numbers(level)), "numbered")
    count = materialize(now.groupBy(*u).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(level)), "counts")
    upper = count.select(*u, "n", F.explode(F.sequence(F.lit(0), F.lit(level - 1))).alias("level")) if level else count.limit(0)
    upper = upper.select("level", "n", *squares.above(F.lit(level) - F.col("level"))).groupBy("level", *u).agg(F.sum("n").alias("n"))
    leaf = (F.col("n") <= LEAF) | (F.col("level") >= DEEPEST)
    levels, leaves = [upper.withColumn("leaf", F.lit(False))], []
    while True:
        flagged = count.withColumn("leaf", leaf)
        levels.append(flagged)
        leaves.append(now.join(flagged.where("leaf").select(*u, "level"), u))
        left = flagged.where(~F.col("leaf")).select(*u)
        if not left.take(1):
            break
        level += 1
        now = materialize(now.join(left, u, "left_semi").withColumns(squares.numbers(level)), "numbered")
        count = materialize(now.groupBy(*u).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(level)), "counts")
    names = ["level", *u, "n", "leaf"]
    tree = functools.reduce(DataFrame.unionByName, [x.select(*names) for x in levels])
    return materialize(tree, "tree"), materialize(functools.reduce(DataFrame.unionByName, leaves), "leaves")


def k_nearest(targets: DataFrame, points: DataFrame, k: int, t_keys: Sequence[str], p_key: str, at: Sequence[str] = ("x", "y"), columns: Sequence[str] = (), other: bool = False) -> DataFrame:
    """The ``k`` nearest points of each target: ``t_keys, rank, p_key, distance, columns`` (of the points); ties go to the smaller key.

    A tree of squares holds the number of points in each. A target begins with the smallest square around it that holds more than ``k`` points, which bounds how far the
    last of them can be, and with the squares around that one; squares are split until they are leaves, and those farther than the
    bound, which counts tighten at every level, are dropped. So a target meets a few squares whatever the density around it, and none is cut off:
    far points are found in large squares. Of points at one place only the ``k + 1`` smallest keys can count, and only these are kept.

    With ``other`` a point whose key is the target's (one key each) doesn't count. Rows without finite coordinates, or without a
    key, take no part; fewer than ``k`` points give fewer rows.
    """
    spark, dims = targets.sparkSession, len(at)
    key = F.struct(*[F.col(c) for c in t_keys])
    t = materialize(_placed(targets.distinct() if targets.columns == [*t_keys] else targets.dropDuplicates([*t_keys]), at, key), "targets")
    names = [f"c{i}" for i in range(dims)]
    p = _placed(points.where(F.col(p_key).isNotNull()), at, F.col(p_key), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]).withColumn("one", F.lit(1))
    p = materialize(running(p, names, "key", ["one"]).where(F.col("_b_one") <= k).drop("_b_one", "_t_one", "one"), "points")
    box = p.select(*names).unionByName(t.select(*names)).agg(*[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).first()
    n = p.count()
    kinds = ", ".join(f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in t_keys) + f", rank int, `{p_key}` {points.schema[p_key].dataType.simpleString()}, distance double" + "".join(f", `{c}` {points.schema[c].dataType.simpleString()}" for c in columns)
    if not n:
        return spark.createDataFrame([], kinds)
    low = [box[f"min{c}"] for c in names]
    side = max([box[f"max{c}"] - lo for c, lo in zip(names, low, strict=True)]) or 1.0
    level = min(DEEPEST, max(0, math.ceil(math.log2(max(n / LEAF, 1)) / dims)))
    squares = _Squares(dims, low, side)
    tree, leaves = _tree(p, squares, level)

    met = _met(t, tree, leaves, squares, level, k)
    mine = F.col(f"t.{t_keys[0]}") if len(t_keys) == 1 else None
    if other and mine is not None:
        met = met.where(mine != F.col("key"))
    rank = F.row_number().over(Window.partitionBy("t").orderBy("distance", "key"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(*[F.col(f"t.{c}").alias(c) for c in t_keys], "rank", F.col("key").alias(p_key), "distance", *[F.col(f"v{i}").alias(c) for i, c in enumerate(columns)])


def _met(t: DataFrame, tree: DataFrame, leaves: DataFrame, squares: _Squares, level: int, k: int) -> DataFrame:
    """Targets beside all points that may be among their ``k`` nearest and one more, with distances."""
    u, c = squares.u, squares.c
    ring = math.ceil(math.sqrt(squares.dims))
    # The smallest square around each target that holds enough: near the leaves' level for most, further up for few.
    enough = tree.where((F.col("n") > k) & (F.col("level") <= level)).select("level", *u)
    start, left = None, t
    for span in (range(max(0, level - 2), level + 1), range(0, max(0, level - 2))):
        if not len(span):
            continue
        levels = left.withColumns(squares.numbers(level)).withColumn("level", F.explode(F.array(*map(F.lit, span))))
        found = levels.select("key", *c, "level", *squares.above(F.lit(level) - F.col("level"))).join(enough, ["level", *u]).groupBy("key", *c).agg(F.max("level").alias("level"))
        found = materialize(found, "starts")
        start = found if start is None else start.unionByName(found)
        left = materialize(left.join(found.select("key"), "key", "left_anti"), "left")
    start = start.unionByName(left.withColumn("level", F.lit(0)))  # fewer points than asked for: all of them
    own = {x: F.col(f"_{x}") for x in u}
    finest = start.withColumns({f"_{x}": v for x, v in squares.numbers(level).items()})
    finest = finest.withColumns({f"_{x}": F.call_function("shiftright", F.col(f"_{x}"), F.lit(level) - F.col("level")) for x in u})
    moves = F.explode(F.array(*[F.struct(*[F.lit(m).alias(x) for m, x in zip(move, u, strict=True)]) for move in np.ndindex(*[2 * ring + 1] * squares.dims)]))
    around = finest.withColumn("m", moves).select(F.col("key").alias("t"), *c, "level", *[(own[x] + F.col(f"m.{x}") - ring).alias(x) for x in u])
    seen = around.join(tree, ["level", *u]).withColumns({"near": squares.far(True), "far": squares.far(False)})
    seen = materialize(_bounded(seen, k), "seen")
    done = seen.where("leaf")
    while True:
        open_ = seen.where(~F.col("leaf"))
        if not open_.take(1):
            break
        below = tree.select(F.col("level").alias("_l"), *[x for x in u], "n", "leaf").where("_l > 0")
        below = below.select((F.col("_l") - 1).alias("level"), *squares.above(1), *[F.col(x).alias(f"_{x}") for x in u], "n", "leaf")
        split = open_.select("t", *c, "level", *u).join(below, ["level", *u]).select("t", *c, (F.col("level") + 1).alias("level"), *[F.col(f"_{x}").alias(x) for x in u], "n", "leaf")
        split = split.withColumns({"near": squares.far(True), "far": squares.far(False)})
        last, seen = seen, materialize(_bounded(done.unionByName(split.select(done.columns)), k), "seen")  # leaves tighten the bound, too
        done = seen.where("leaf")
        discard(last)
    gap = [F.pow(F.col(f"t_{x}") - F.col(x), 2) for x in c]
    ends = done.select("t", "level", *u, *[F.col(x).alias(f"t_{x}") for x in c])
    return ends.join(leaves, ["level", *u]).withColumn("distance", F.sqrt(sum(gap[1:], gap[0])))


def _bounded(seen: DataFrame, k: int) -> DataFrame:
    """Without the squares that are farther than where the target is sure to have met ``k + 1`` points."""
    by = Window.partitionBy("t")  # a few squares each
    enough = F.sum("n").over(by.orderBy("far").rowsBetween(Window.unboundedPreceding, 0)) > k
    bound = F.coalesce(F.min(F.when(F.col("_e"), F.col("far"))).over(by), F.lit(float("inf")))
    return seen.withColumn("_e", enough).withColumn("_r", bound).where("near <= _r").drop("_e", "_r")


def inverse_distance(targets: DataFrame, points: DataFrame, value: str, k: int, t_keys: Sequence[str] = ("x", "y"), p_key: str = "id", at: Sequence[str] = ("x", "y"), power: float = 2.0) -> DataFrame:
    """Each target's mean of its ``k`` nearest points, however far, weighted by distance to the power of ``-power``; at a point's place the mean of the points there."""
    near = k_nearest(targets, points.where(F.col(value).isNotNull()), k, t_keys, p_key, at, [value])
    weight = F.when(F.col("distance") > 0, F.pow("distance", F.lit(-power)))
    here = F.avg(F.when(F.col("distance") == 0, F.col(value)))
    return near.groupBy(*t_keys).agg(F.coalesce(here, F.sum(F.col(value) * weight) / F.sum(weight)).alias(value))


def variogram(points: DataFrame, value: str, side: float, lag: float, bins: int, at: Sequence[str] = ("x", "y")) -> DataFrame:
    """``bin, pairs, distance, gamma``: half the mean squared difference of values by distance, in ``bins`` of ``lag``.

    Points are gathered into squares of ``side``, and squares meet those up to ``bins * lag`` away. The sums of values, of squares and the
    count of two squares give the sum of squared differences of all their points' pairs, so no pair of points is made; the distance is that of the squares' numbers, and pairs within one square have distance 0, bin 0.
    Squares are dealt to tiles of half that reach and copied to the tiles around, so pairs of squares are made within a tile and summed there; they are never shuffled or broadcast.
    """
    names = [f"c{i}" for i in range(len(at))]
    v = F.col("v")
    p = _placed(points, at, F.lit(0), F.col(value).cast("double").alias("v")).where(_finite("v"))
    s = p.groupBy(*[F.floor(F.col(c) / side).cast("long").alias(c) for c in names]).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    s = materialize(s, "squares")
    tile = math.ceil(bins * lag / side / 2)
    tiles = {f"t{i}": F.floor(F.col(c) / tile).cast("long") for i, c in enumerate(names)}
    moves = [m for m in np.ndindex(*[5] * len(at)) if m[0] > 1]  # the other square is ahead
    deal = F.explode(F.array(*[F.struct(*[F.lit(x - 2).alias(t) for x, t in zip(m, tiles, strict=True)]) for m in moves]))
    dealt = s.withColumns(tiles).withColumn("m", deal).select(*[(F.col(t) - F.col(f"m.{t}")).alias(t) for t in tiles], *[F.col(c).alias(f"o{c}") for c in names], F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    ahead = F.lit(False)
    for c in reversed(names):
        ahead = (F.col(f"o{c}") > F.col(c)) | ((F.col(f"o{c}") == F.col(c)) & ahead)
    apart = F.sqrt(sum((F.pow(F.col(f"o{c}") - F.col(c), 2) for c in names), F.lit(0.0))) * side
    met = s.withColumns(tiles).join(dealt.hint("merge"), [*tiles]).where(ahead).withColumn("d", apart).where(F.col("d") < bins * lag)  # a broadcast would hold every copy
    apart = met.select(F.floor(F.col("d") / lag).cast("int").alias("bin"), "d", (F.col("n") * F.col("n2")).alias("pairs"), (F.col("n2") * F.col("q") + F.col("n") * F.col("q2") - 2 * F.col("s") * F.col("s2")).alias("squared"))
    inside = s.where("n > 1").select(F.lit(0).alias("bin"), F.lit(0.0).alias("d"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), (F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("squared"))
    return apart.unionByName(inside).groupBy("bin").agg(F.sum("pairs").alias("pairs"), (F.sum(F.col("d") * F.col("pairs")) / F.sum("pairs")).alias("distance"), (F.greatest(F.sum("squared"), F.lit(0.0)) / (2 * F.sum("pairs"))).alias("gamma"))


def spherical(h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """The spherical model; 0 at distance 0, nugget plus partial sill from ``reach`` on."""
    r = np.minimum(h / reach, 1.0)
    return np.where(h > 0, nugget + sill * (1.5 * r - 0.5 * r**3), 0.0)


def fit_spherical(bins: list[tuple[float, float, float]], ranges: Sequence[float]) -> tuple[float, float, float]:
    """Nugget, partial sill and the one of ``ranges`` that fit ``(pairs, distance, gamma)`` best by weighted least squares; neither is below 0."""
    w, h, g = (np.array(x, float) for x in zip(*bins, strict=True))
    best = None
    for reach in ranges:
        shape = spherical(h, 0.0, 1.0, reach)
        tries = []
        a = np.stack([np.ones_like(shape), shape], 1)
        full = np.linalg.lstsq(a * np.sqrt(w)[:, None], g * np.sqrt(w), rcond=None)[0]
        if (full >= 0).all():
            tries.append(full)
        tries += [np.array([np.average(g, weights=w), 0.0]), np.array([0.0, max((w * g * shape).sum() / max((w * shape * shape).sum(), 1e-300), 0.0)])]
        for x in tries:
            error = float((w * (a @ x - g) ** 2).sum())
            if best is None or error < best[0] - 1e-12 * abs(best[0]):
                best = error, float(x[0]), float(x[1]), float(reach)
    return best[1:]


def krige(targets: DataFrame, points: DataFrame, value: str, model: tuple[float, float, float], k: int, t_keys: Sequence[str] = ("x", "y"), at: Sequence[str] = ("x", "y")) -> DataFrame:
    """Ordinary kriging of each target from its ``k`` nearest points, with a spherical model of nugget, partial sill and range: ``t_keys, estimate, variance, n``.

    Points at one place count once, with their mean. Each target's weights, which add up to one, solve a system of ``k + 1`` unknowns; tasks solve batches of them.
    At a point's place the estimate is its value and the variance 0. A model without any variance gives plain means.
    """
    names = [f"c{i}" for i in range(len(at))]
    p = _placed(points, at, F.lit(0), F.col(value).cast("double").alias("v")).where(_finite("v")).groupBy(*names).agg(F.avg("v").alias("v"))
    p = materialize(p.withColumn("place", F.struct(*names)), "places")
    t = targets.select(*t_keys, *[F.col(c).cast("double").alias(n) for c, n in zip(at, names, strict=True)])
    near = k_nearest(t, p, k, t_keys, "place", names, ["v"])
    group = near.groupBy(*t_keys).agg(F.sort_array(F.collect_list(F.struct("rank", "distance", "place", "v"))).alias("near"))  # k rows each
    flat = group.select(F.struct(*t_keys).alias("t"), F.transform("near", lambda r: r["distance"]).alias("d"), F.flatten(F.transform("near", lambda r: F.array(*[r["place"][n] for n in names]))).alias("c"), F.transform("near", lambda r: r["v"]).alias("v"))
    kinds = f"t {flat.schema['t'].dataType.simpleString()}, estimate double, variance double, n int"
    dims = len(at)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            d, c, v = (batch.column(i).flatten().to_numpy() for i in (1, 2, 3))
            begin = np.cumsum(sizes) - sizes
            out = np.zeros((2, batch.num_rows))
            for m in np.unique(sizes):
                rows = np.flatnonzero(sizes == m)
                for part in np.array_split(rows, max(1, len(rows) * m * m // 1_000_000)):
                    index = begin[part][:, None] + np.arange(m)
                    out[:, part] = ordinary(d[index], c.reshape(-1, dims)[index], v[index], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1]), pa.array(sizes.astype(np.int32))], ["t", "estimate", "variance", "n"])

    return flat.mapInArrow(solve, kinds).select("t.*", "estimate", "variance", "n")


def ordinary(d: np.ndarray, c: np.ndarray, v: np.ndarray, model: tuple[float, float, float]) -> np.ndarray:
    """Estimates and variances of a batch of ordinary kriging systems: distances, coordinates and values of each target's points."""
    n, m = d.shape
    if not model[0] + model[1]:
        return np.stack([np.where(d[:, 0] == 0, v[:, 0], v.mean(1)), np.zeros(n)])
    a = np.ones((n, m + 1, m + 1))
    a[:, :m, :m] = spherical(np.sqrt(((c[:, :, None, :] - c[:, None, :, :]) ** 2).sum(-1)), *model)
    a[:, m, m] = 0
    b = np.ones((n, m + 1, 1))
    b[:, :m, 0] = spherical(d, *model)
    w = np.linalg.solve(a, b)[:, :, 0]
    variance = np.maximum((w * b[:, :, 0]).sum(1), 0.0)
    exact = d[:, 0] == 0
    return np.stack([np.where(exact, v[:, 0], (w[:, :m] * v).sum(1)), np.where(exact, 0.0, variance)])
