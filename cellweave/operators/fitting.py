"""Curves and surfaces fitted per key: demand projection, harmonics, smoothing, local regression and class statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.ordered import running


def project_demand(observed: DataFrame, projected: DataFrame, region: str, year: str, population: str, developed: str) -> DataFrame:
    """Developed cells per region and projected year, by the best of three curves over population, and their yearly growth.

    Linear, logarithmic and exponential curves are straight lines over transformed columns, so their fits are aggregates. The curve
    with the least error wins; where its slope is negative, the last density times the population takes its place.
    """
    x, y = F.col(population).cast("double"), F.col(developed).cast("double")
    forms = {"linear": (x, y), "logarithmic": (F.when(x > 0, F.ln(x)), y), "exponential": (x, F.when(y > 0, F.ln(y)))}
    fits = observed.groupBy(region).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.try_divide(y, x), F.col(year)).alias("density"),
        *[f(b, a).alias(f"{k}_{n}") for k, (a, b) in forms.items() for n, f in (("slope", F.regr_slope), ("base", F.regr_intercept))],
    )

    def curve(k: str, v: Column) -> Column:
        s, b = F.col(f"{k}_slope"), F.col(f"{k}_base")
        return {"linear": b + s * v, "logarithmic": F.greatest(F.lit(0.0), b + s * F.ln(F.when(v > 1, v))), "exponential": F.exp(b + s * v)}[k]

    error = observed.join(fits, region).groupBy(region).agg(*[F.sqrt(F.try_divide(F.sum(F.pow(y - curve(k, x), 2)), F.when(F.max("n") > 2, F.max("n") - 2).otherwise(None))).alias(f"{k}_rmse") for k in forms])
    both = fits.join(error, region)
    best = F.array_min(F.array(*[F.when(F.col(f"{k}_rmse").isNotNull(), F.struct(F.col(f"{k}_rmse").alias("rmse"), F.lit(k).alias("k"))) for k in forms]))
    chosen = both.withColumn("_best", best).withColumns({"method": F.col("_best.k"), "rmse": F.col("_best.rmse")})
    rising = F.coalesce(*[F.when(F.col("method") == k, F.col(f"{k}_slope") >= 0) for k in forms], F.lit(False))
    value = F.when(rising, F.coalesce(*[F.when(F.col("method") == k, curve(k, x)) for k in forms])).otherwise(F.col("density") * x)
    out = projected.join(chosen, region).select(region, year, F.when(rising, F.col("method")).otherwise("density").alias("method"), value.alias("projected"))
    w = Window.partitionBy(region).orderBy(year)
    return out.withColumn("demand", F.greatest(F.lit(0.0), F.col("projected") - F.lag("projected").over(w)))


def harmonics(df: DataFrame, keys: Sequence[str], t: str, v: str, period: float, count: int, ridge: float = 1e-6) -> DataFrame:
    """Mean, amplitudes and phases of the first harmonics of each key's series, from its normal equations.

    The sums of products are aggregated before they travel; a key's fit then needs one small row, whatever the series' length.
    """
    phase = lambda k: 2 * np.pi * k * F.col(t).cast("double") / period
    basis = [F.lit(1.0), *[f(phase(k)) for k in range(1, count + 1) for f in (F.cos, F.sin)]]
    m = len(basis)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    y = F.col(v).cast("double")
    sums = df.where(y.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(basis[i] * basis[j]).alias(f"_a{i}_{j}") for i, j in pairs], *[F.sum(basis[i] * y).alias(f"_b{i}") for i in range(m)])
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys] + ["n long, mean double"] + [f"amplitude{k} double, phase{k} double" for k in range(1, count + 1)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            a = np.zeros((len(part), m, m))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = part[f"_a{i}_{j}"]
            a += ridge * np.eye(m)
            b = part[[f"_b{i}" for i in range(m)]].to_numpy()
            c = np.linalg.solve(a, b[:, :, None])[:, :, 0] if len(part) else b
            out = part[[*keys, "n"]].copy()
            out["mean"] = c[:, 0]
            for k in range(1, count + 1):
                out[f"amplitude{k}"] = np.hypot(c[:, 2 * k - 1], c[:, 2 * k])
                out[f"phase{k}"] = np.degrees(np.arctan2(c[:, 2 * k], c[:, 2 * k - 1])) % 360
            yield out

    return sums.mapInPandas(solve, kinds)


def polynomial_smoothing(df: DataFrame, keys: Sequence[str], t: str, v: str, width: int, order: int) -> DataFrame:
    """Each value replaced by that of a polynomial through its ``width`` (odd) neighbours; ends and windows with nulls stay as they are.

    The fit of equally spaced values is a fixed weighted sum, so it is a window expression.
    """
    if width % 2 == 0 or order >= width:
        raise ValueError("the width is odd and larger than the order")
    half = width // 2
    weights = np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))[0]
    w = Window.partitionBy(*keys).orderBy(t)
    near = [F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w) if k else F.col(v) for k in range(-half, half + 1)]
    total = sum((x * float(c) for x, c in zip(near, weights, strict=True)), F.lit(0.0))
    return df.select(*keys, t, v, F.coalesce(total, F.col(v)).alias("smooth"))


def local_regression(df: DataFrame, keys: Sequence[str], t: str, v: str, reach: int) -> DataFrame:
    """At each time the value of a line through the neighbours within ``reach``, weighted by the tricube of their distance.

    A line's weighted fit needs five sums; each row is dealt to the times that it serves, and the sums are partial before they travel.
    """
    far = reach + 1
    at = F.explode(F.sequence(F.col(t) - reach, F.col(t) + reach))
    d = (F.col(t) - F.col("_at")).cast("double")
    w = F.pow(1 - F.pow(F.abs(d) / far, 3), 3)
    y = F.col(v).cast("double")
    dealt = df.where(F.col(v).isNotNull()).select(*keys, t, v, at.alias("_at"))
    s = dealt.groupBy(*keys, F.col("_at").alias(t)).agg(*[F.sum(e).alias(n) for n, e in (("_w", w), ("_x", w * d), ("_y", w * y), ("_xx", w * d * d), ("_xy", w * d * y))])
    bottom = F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x")
    line = F.when(F.abs(bottom) > 1e-9, (F.col("_y") * F.col("_xx") - F.col("_x") * F.col("_xy")) / bottom).otherwise(F.col("_y") / F.col("_w"))
    return df.select(*keys, t, v).join(s, [*keys, t], "left").select(*keys, t, v, line.alias("smooth"))


def class_statistics(df: DataFrame, cls: str, a: object, b: object, features: Sequence[str]) -> DataFrame:
    """Mean and deviation of each feature in two classes, Welch's t and the Kolmogorov-Smirnov distance.

    The distance runs over the features' histograms of distinct values.
    """
    long = df.where(F.col(cls).isin(a, b)).select((F.col(cls) == F.lit(a)).alias("first"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("p")).select("first", "p.*").where("v IS NOT NULL")
    one, two = F.when(F.col("first"), F.col("v")), F.when(~F.col("first"), F.col("v"))
    m = long.groupBy("feature").agg(*[f(e).alias(f"{n}_{k}") for k, e in (("a", one), ("b", two)) for n, f in (("n", F.count), ("mean", F.avg), ("stddev", F.stddev_samp))])
    steps = long.groupBy("feature", "v").agg(F.count(one).alias("na"), F.count(two).alias("nb"))
    upto = lambda c: F.try_divide(F.col(f"_b_{c}") + F.col(c), F.col(f"_t_{c}"))
    gap = F.abs(upto("na") - upto("nb"))
    ks = running(steps, ["feature"], "v", ["na", "nb"]).select("feature", gap.alias("_gap")).groupBy("feature").agg(F.max("_gap").alias("ks"))
    error = F.sqrt(F.pow("stddev_a", F.lit(2)) / F.col("n_a") + F.pow("stddev_b", F.lit(2)) / F.col("n_b"))
    return m.join(ks, "feature").withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), error))


def fill_category(cells: DataFrame, cls: str, category: int) -> DataFrame:
    """Cells of a category take the most frequent class round them (ties to the smallest), round by round from the outside in, until none is left that other classes reach.

    A cell is filled as soon as it has a neighbour with a class, so those that decide on it were all filled in the round before: only open cells and the last
    round's are carried, and the rest isn't read again.
    """
    from cellweave.operators.focal import offsets
    from cellweave.sources.shared import discard, materialize

    here = F.col(cls)
    start = materialize(cells.select("x", "y", F.when(here != category, here).alias(cls), here.isNotNull().alias("_in")), "fill")
    open_ = materialize(start.where(here.isNull() & F.col("_in")).select("x", "y"), "open")
    rim, done = start.where(here.isNotNull()).select("x", "y", cls), start.where(here.isNotNull() | ~F.col("_in")).select("x", "y", cls)
    deal = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets(1, centre=False)]))
    rounds = 0
    while True:
        dealt = rim.withColumn("m", deal).select((F.col("x") + F.col("m.i")).alias("x"), (F.col("y") + F.col("m.j")).alias("y"), cls)
        votes = dealt.join(open_, ["x", "y"], "left_semi").groupBy("x", "y", cls).agg(F.count(F.lit(1)).alias("n"))
        new = materialize(votes.groupBy("x", "y").agg(F.min_by(cls, F.struct(-F.col("n"), here)).alias(cls)), "filled")
        if not new.take(1):
            break
        rim, done, last, rounds = new, done.unionByName(new), open_, rounds + 1
        open_ = materialize(open_.join(new, ["x", "y"], "left_anti"), "open")
        discard(last)
        if rounds % 20 == 0:  # else the plan names a table for each round
            done = materialize(done, "done")
    return done.unionByName(open_.withColumn(cls, F.lit(category).cast(start.schema[cls].dataType)))
