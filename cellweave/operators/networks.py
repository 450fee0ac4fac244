"""Graphs between patches and points: lightest spanning forests, neighbourhood graphs and their indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.flood import ends
from cellweave.operators.graph import connected_components
from cellweave.sources.shared import discard, materialize


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges ``a, b, w`` (a < b) of the lightest forest that connects all that ``edges`` do; equal weights go by ``a`` and ``b``.

    In each round every tree takes its lightest edge to another one and all trees so joined become one, so at least half of them go; of the edges between two
    trees only the lightest stays. Loops, null ends and null weights are ignored, and of several edges between two nodes the lightest counts.
    """
    start = edges.where("a <> b AND w IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    now = materialize(start.select("a", "b", F.struct("w", F.col("a").alias("ea"), F.col("b").alias("eb")).alias("e")), "edges")
    out = now.limit(0).select(F.col("e.ea").alias("a"), F.col("e.eb").alias("b"), F.col("e.w").alias("w"))
    while now.take(1):
        both = now.select("a", "b", "e").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = materialize(both.groupBy("a").agg(F.min_by("b", "e").alias("b"), F.min("e").alias("e")), "best")
        chosen = materialize(best.select("e.*").distinct(), "chosen")
        out = out.unionByName(chosen.select(F.col("ea").alias("a"), F.col("eb").alias("b"), "w"))
        # Two trees that chose the same edge point at each other; the smaller one stays.
        back = best.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("_back"))
        pointed = best.select("a", "b").join(back, ["a", "b"], "left").select("a", F.when(F.col("_back") & (F.col("a") < F.col("b")), None).otherwise(F.col("b")).alias("b"))
        root = materialize(ends(pointed, "a", "b"), "trees")
        at = lambda end: root.select(F.col("a").alias(end), F.col("root").alias(f"{end}2"))  # noqa: B023, E731
        new = now.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"), "e").groupBy("a", "b").agg(F.min("e").alias("e"))
        last, now = now, materialize(new, "edges")
        for table in (last, best, root):
            discard(table)
    return out


def neighbourhood_graph(edges: DataFrame, kind: str) -> DataFrame:
    """The edges ``a, b, w`` that stay when a third node in between takes an edge away.

    ``nearest``: the lightest edge of each node, ties to the smaller other one. ``gabriel``: no node ``c`` with ``w(a, c)^2 + w(b, c)^2 < w(a, b)^2``.
    ``relative``: no ``c`` nearer to both ends than these are to each other. ``edges`` hold every pair up to some distance, so the nodes
    that decide on an edge are joined through lighter edges of its ends; nothing beyond an edge's own reach is looked at.
    """
    e = edges.where("a <> b AND w IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    e = materialize(e, "edges")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    if kind == "nearest":
        best = both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select("a", "m.b", "m.w")
        return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct()
    if kind not in ("gabriel", "relative"):
        raise ValueError(kind)
    first = both.select("a", F.col("b").alias("c"), F.col("w").alias("wa"))
    second = both.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("wb"))
    between = e.join(first, "a").where("wa < w AND c <> b").join(second, ["b", "c"]).where("wb < w")
    if kind == "gabriel":
        between = between.where("wa * wa + wb * wb < w * w")
    return e.join(between.select("a", "b").distinct(), ["a", "b"], "left_anti").select("a", "b", "w")


def graph_indices(nodes: DataFrame, key: str, size: str, edges: DataFrame) -> DataFrame:
    """One row: nodes, links, groups, connectance (share of possible links), largest and mean group in nodes and in size. A node without links is a group of its own."""
    link = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    root = connected_components(link)
    at = nodes.select(F.col(key).alias("node"), F.col(size).cast("double").alias("s")).join(root, "node", "left").select(F.coalesce("root", "node").alias("root"), "s")
    group = at.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
    all_ = group.agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"), F.avg("n").alias("mean_nodes"), F.max("s").alias("largest_size"), F.avg("s").alias("mean_size"))
    row = all_.crossJoin(link.agg(F.count(F.lit(1)).alias("links")))  # one row each
    n = F.col("nodes")
    return row.select(F.coalesce(n, F.lit(0)).alias("nodes"), "links", "groups", F.try_divide(F.col("links"), n * (n - 1) / 2).alias("connectance"), "largest", "mean_nodes", "largest_size", "mean_size")
