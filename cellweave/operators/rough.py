"""Dominance-based rough sets: what classes the rows that dominate a row, or that it dominates, may have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranks(df: DataFrame, column: str, gain: bool) -> DataFrame:
    """A criterion's grades with their rank from the worst (``up``) and from the best one (``down``): a row for each grade."""
    worst, best = (F.asc(column), F.desc(column)) if gain else (F.desc(column), F.asc(column))
    return df.select(column).distinct().withColumns({f"{column}_{k}": F.row_number().over(Window.orderBy(w)) for k, w in (("up", worst), ("down", best))})


def _cone(cells: DataFrame, ranks: Sequence[str], value: str, least: bool) -> DataFrame:
    """For each place of the lattice the least (largest) value of the cells whose ranks all reach it.

    One criterion after another, a cell counts at all ranks up to its own and what meets is aggregated, so rows never
    exceed the lattice times one criterion's grades and no pairs of rows are made.
    """
    over = F.min if least else F.max
    for rank in ranks:
        others = [r for r in ranks if r != rank]
        cells = cells.select(*others, value, F.explode(F.sequence(F.lit(1), rank)).alias(rank)).groupBy(*ranks).agg(over(value).alias(value))
    return cells


def class_bounds(df: DataFrame, criteria: Mapping[str, bool], decision: str) -> DataFrame:
    """Each combination of grades and class with its rows ``n``, and the classes ``low`` and ``high`` that dominance leaves it.

    ``criteria`` says for each column whether more is better. A row dominates another one if it is at least as good in every
    criterion; ``low`` is the worst class of the rows that dominate this one, ``high`` the best class of those that it dominates, itself
    among both. Where no row contradicts it, both are the row's own class. Larger classes are better ones.

    Criteria are grades: the lattice of their combinations, the product of their numbers of grades, is aggregated as rows, whatever
    the number of rows of ``df``. Rows with a null in a criterion or the class are left out; repeated rows count in ``n``.
    """
    names = list(criteria)
    cells = df.select(*names, decision).dropna().groupBy(*names, decision).agg(F.count(F.lit(1)).alias("n"))
    ranked = cells
    for c, gain in criteria.items():
        ranked = ranked.join(_ranks(cells, c, gain), c)
    up, down = ([f"{c}_{k}" for c in names] for k in ("up", "down"))
    low = _cone(ranked.select(*up, F.col(decision).alias("low")), up, "low", least=True)
    high = _cone(ranked.select(*down, F.col(decision).alias("high")), down, "high", least=False)
    return ranked.join(low, up).join(high, down).select(*names, decision, "n", "low", "high")


def approximations(bounds: DataFrame, decision: str) -> DataFrame:
    """Lower and upper approximations of the unions of classes, from ``class_bounds``.

    A row for each class and ``side`` (``at_least``: this class and better ones; ``at_most``: this and worse ones): the union's rows ``size``, those
    that surely (``lower``) and possibly (``upper``) belong to it, those in doubt (``boundary``), and ``accuracy``, lower by upper.
    """
    counts = bounds.groupBy(decision, "low", "high").agg(F.sum("n").alias("n"))
    ranks = _ranks(counts, decision, True).withColumnsRenamed({decision: "class", f"{decision}_up": "up", f"{decision}_down": "down"})
    for c in (decision, "low", "high"):
        named = ranks.select(F.col("class").alias(c), F.col("up").alias(f"{c}_up"), F.col("down").alias(f"{c}_down"))
        counts = counts.join(named, c)

    def union(side: str, k: str, sure: str, possible: str) -> DataFrame:
        each = counts.select("n", f"{decision}_{k}", f"{sure}_{k}", F.explode(F.sequence(F.lit(1), f"{possible}_{k}")).alias(k))
        held = lambda c: F.coalesce(F.sum(F.when(F.col(k) <= F.col(f"{c}_{k}"), F.col("n"))), F.lit(0))
        sums = each.groupBy(k).agg(held(decision).alias("size"), held(sure).alias("lower"), F.sum("n").alias("upper"))
        return sums.join(ranks, k).select("class", F.lit(side).alias("side"), "size", "lower", "upper")

    both = union("at_least", "up", "low", "high").unionByName(union("at_most", "down", "high", "low"))
    return both.withColumns({"boundary": F.col("upper") - F.col("lower"), "accuracy": F.col("lower") / F.col("upper")})


def quality(bounds: DataFrame) -> DataFrame:
    """The share of rows that no other row contradicts; null without rows."""
    return bounds.agg((F.sum(F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(0)) / F.sum("n")).alias("quality"))
