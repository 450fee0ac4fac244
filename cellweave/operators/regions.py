"""Segmentation: regions that grow by merging with their best neighbours, and superpixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import graph, nearest
from cellweave.operators.flood import HALF, ends
from cellweave.operators.focal import neighbours
from cellweave.sources.shared import discard, materialize


class _Regions:
    """Regions ``id, n, s_<band>`` (cells and sums), edges ``a < b`` between them, and the merges ``id, to`` so far."""

    def __init__(self, cells: DataFrame, bands: Sequence[str], width: int, diagonal: bool):
        self.bands = list(bands)
        present = [F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double")) for b in bands]
        ok = present[0]
        for p in present[1:]:
            ok = ok & p
        self.start = materialize(cells.where(ok).select("x", "y", (F.col("y") * width + F.col("x")).cast("long").alias("id"), *[F.col(b).cast("double").alias(b) for b in bands]), "cells")
        near = neighbours(self.start, HALF if diagonal else HALF[:2], ["id"])
        self.edges = materialize(near.select(F.least("id", "n_id").alias("a"), F.greatest("id", "n_id").alias("b")), "edges")
        self.now = self.start.select("id", F.lit(1).cast("long").alias("n"), *[F.col(b).alias(f"s_{b}") for b in bands])
        self.merges: list[DataFrame] = []

    def _apart(self) -> DataFrame:
        """Edges with the distance of their regions' means, ``a, b, d`` and both sizes."""
        side = lambda end: self.now.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), *[(F.col(f"s_{b}") / F.col("n")).alias(f"{end}_{b}") for b in self.bands])
        gap = [F.pow(F.col(f"a_{b}") - F.col(f"b_{b}"), 2) for b in self.bands]
        return self.edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.sqrt(sum(gap[1:], gap[0])).alias("d"), "n_a", "n_b")

    @staticmethod
    def _best(apart: DataFrame) -> DataFrame:
        """The nearest neighbour ``id, n, other, d`` of each region that ``apart`` lists; all agree on which of two equal edges comes first."""
        edge = F.struct("d", "a", "b")
        each = apart.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("id"), F.col("n_b").alias("n")))).alias("e"), edge.alias("m"))
        best = each.groupBy(F.col("e.id").alias("id"), F.col("e.n").alias("n")).agg(F.min("m").alias("m"))
        return best.select("id", "n", F.when(F.col("id") == F.col("m.a"), F.col("m.b")).otherwise(F.col("m.a")).alias("other"), "m.d")

    def _merge(self, moved: DataFrame) -> None:
        """Applies the merges ``id, to``, whose targets don't move."""
        self.merges.append(moved)
        into = lambda c: moved.select(F.col("id").alias(c), F.col("to").alias(f"_{c}"))
        sums = ["n", *[f"s_{b}" for b in self.bands]]
        now = self.now.join(into("id"), "id", "left").groupBy(F.coalesce("_id", "id").alias("id")).agg(*[F.sum(c).alias(c) for c in sums])
        a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        edges = self.edges.join(into("a"), "a", "left").join(into("b"), "b", "left").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
        last = self.now, self.edges
        self.now, self.edges = materialize(now, "regions"), materialize(edges, "edges")
        for table in last:
            if len(self.merges) > 1 or table is not last[0]:
                discard(table)

    @staticmethod
    def _joined(best: DataFrame, alone: Column) -> DataFrame:
        """The merges ``id, to`` of regions ``id, other`` that chose each other, or that ``alone`` lets follow their choice: all that hang together, into one of theirs."""
        back = best.select(F.col("other").alias("id"), F.col("id").alias("other"), F.lit(True).alias("_back"))
        pair = F.col("_back").isNotNull()
        chain = best.join(back, ["id", "other"], "left").where(pair | alone).select("id", F.when(pair & (F.col("id") < F.col("other")), None).otherwise(F.col("other")).alias("to"))
        chain = materialize(chain, "chain")
        targets = chain.select(F.col("to").alias("id")).distinct().join(chain.select("id"), "id", "left_anti").where("id IS NOT NULL")
        found = ends(chain.unionByName(targets.withColumn("to", F.lit(None).cast("long"))), "id", "to")
        return materialize(found.where("id <> root").select("id", F.col("root").alias("to")), "moved")

    def grow(self, threshold: float, follow: float = 0.0) -> int:
        """Merges mutual best neighbours no further apart than ``threshold``, and any with their best no further than its share ``follow``, until there are none; the number of rounds."""
        rounds = 0
        while True:
            best = materialize(self._best(self._apart().where(F.col("d") <= threshold)), "best")
            if not best.take(1):
                return rounds
            self._merge(self._joined(best, F.col("d") <= follow * threshold))
            discard(best)
            rounds += 1

    def absorb(self, least: int) -> None:
        """Regions of fewer than ``least`` cells join their nearest neighbour, however far, until none is left that has one."""
        while True:
            best = materialize(self._best(self._apart()).where(F.col("n") < least), "best")
            if not best.take(1):
                return
            self._merge(self._joined(best, F.lit(True)))
            discard(best)

    def labels(self) -> DataFrame:
        """``id, region`` of each cell."""
        if not self.merges:
            return self.start.select("id", F.col("id").alias("region"))
        moved = self.merges[0]
        for m in self.merges[1:]:
            moved = moved.unionByName(m)
        return ends(self.start.select("id").join(moved, "id", "left"), "id", "to").withColumnRenamed("root", "region")


def grow_regions(cells: DataFrame, bands: Sequence[str], width: int, thresholds: Sequence[float], least: int = 1, follow: float = 0.0, diagonal: bool = False) -> DataFrame:
    """``x, y, threshold, region``: a segmentation for each threshold, each grown on from the one before; regions are named by a cell of theirs.

    Every cell begins as a region. In each round regions whose means are nearest to each other, of all neighbours' on both sides, merge if the distance of
    their means is within the threshold; rounds go on until none is. A region that is the best of many takes one in a round, so wide even areas take many rounds; regions no
    further from their best than the share ``follow`` of the threshold join it without being its best, too, which halves such regions in each round (with 1, all). Then regions of fewer than ``least`` cells join their nearest neighbour. Equal distances
    are settled by the smaller region numbers, so reruns agree. Only regions, their edges and the merges are kept between rounds, aggregates of the
    tables before; a region may have any number of cells. Cells with a null band belong to no region and aren't returned.
    """
    regions, out = _Regions(cells, bands, width, diagonal), None
    for t in thresholds:
        regions.grow(t, follow)
        if least > 1:
            regions.absorb(least)
        found = materialize(regions.start.join(regions.labels(), "id").select("x", "y", F.lit(float(t)).alias("threshold"), "region"), "labels")
        out = found if out is None else out.unionByName(found)
    return out


def superpixels(cells: DataFrame, bands: Sequence[str], step: int, compactness: float, rounds: int = 10) -> DataFrame:
    """``x, y, superpixel``: clusters of cells that are near in place and in bands, begun on a grid of ``step`` cells.

    A cell belongs to the centre, of those within ``step`` in both directions, with the least ``d_bands^2 + (compactness * d_place / step)^2``, ties to the smaller number;
    centres then move to the mean of their cells. Centres are dealt to the squares that cells around them lie in, so a cell meets a few, and sums are
    partial before they travel. A centre without cells goes; a cell that no centre reaches any more keeps the one it had.
    """
    bands = list(bands)
    square = lambda c: F.floor(F.col(c) / step).cast("long")
    c = cells.select("x", "y", *[F.col(b).cast("double").alias(b) for b in bands])
    for b in bands:
        c = c.where(F.col(b).isNotNull() & ~F.isnan(b))
    c = materialize(c.withColumns({"sx": square("x"), "sy": square("y")}), "cells")
    # A number for each square of the grid, the same in every run: its first cell in row-major order.
    first = c.groupBy("sx", "sy").agg(F.min(F.struct("y", "x")).alias("f"))
    ranked = first.select("sx", "sy", F.col("f.y").cast("long").alias("fy"), F.col("f.x").cast("long").alias("fx"))
    held = c.join(ranked, ["sx", "sy"]).select("x", "y", *bands, F.struct("fy", "fx").alias("k"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    means = lambda df: df.groupBy("k").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), *[F.avg(b).alias(f"c_{b}") for b in bands])
    held = materialize(held, "held")
    for _ in range(rounds):
        centre = means(held).withColumn("m", around)
        dealt = centre.select("k", "cx", "cy", *[f"c_{b}" for b in bands], (square("cx") + F.col("m.i")).alias("sx"), (square("cy") + F.col("m.j")).alias("sy"))
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        d: Column = (dx * dx + dy * dy) * (compactness / step) ** 2
        for b in bands:
            d = d + F.pow(F.col(b) - F.col(f"c_{b}"), 2)
        met = c.join(dealt, ["sx", "sy"]).where((F.abs(dx) <= step) & (F.abs(dy) <= step))
        best = met.groupBy("x", "y").agg(F.min(F.struct(F.round(d, 9).alias("d"), "k")).alias("m")).select("x", "y", F.col("m.k").alias("n"))
        last, held = held, materialize(held.join(best, ["x", "y"], "left").select("x", "y", *bands, F.coalesce("n", "k").alias("k")), "held")
        discard(last)
    return held.select("x", "y", F.concat_ws("_", "k.fx", "k.fy").alias("superpixel"))


def zero_to_null(cells: DataFrame, value: str, width: int) -> DataFrame:
    """Zeros around a picture become null, zeros within it the value of the nearest cell that has another one.

    Around it are the clumps of zeros, by sides, that hold a corner of all cells' bounding box. Of cells equally near the one
    with the smallest number ``y * width + x`` counts, ``x`` being below ``width``. Nulls stay null, and a grid without other values becomes null.
    """
    zeros = graph.clumps(cells.where(F.col(value) == 0).select("x", "y", value), value, width)
    box = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row
    at_corner = F.col("x").isin(F.col("x0"), F.col("x1")) & F.col("y").isin(F.col("y0"), F.col("y1"))
    outer = zeros.crossJoin(F.broadcast(box)).where(at_corner).select("clump").distinct()
    inner = zeros.join(outer, "clump", "left_anti").select("x", "y")
    given = cells.where(F.col(value) != 0).select("x", "y", F.col(value).alias("_near"), (F.col("y") * width + F.col("x")).alias("_cell"))
    near = nearest.k_nearest(inner, given, 1, ["x", "y"], "_cell", columns=["_near"]).select("x", "y", "_near")
    return cells.join(near, ["x", "y"], "left").withColumn(value, F.when(F.col(value) != 0, F.col(value)).otherwise(F.col("_near"))).drop("_near")
