"""Decisions over many criteria, similarity of environments and evaluation of predictions."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.ordered import running
from cellweave.sources.shared import materialize


def _shares(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


def topsis(df: DataFrame, key: str, weights: Mapping[str, float], cost: Sequence[str] = ()) -> DataFrame:
    """Closeness of each alternative to the ideal one, from vector-normalised weighted criteria."""
    w = _shares(weights)
    norm = df.agg(*[F.sqrt(F.sum(F.pow(F.col(c).cast("double"), 2))).alias(f"_n_{c}") for c in w], *[f(c).alias(f"_{k}_{c}") for c in w for k, f in (("lo", F.min), ("hi", F.max))])
    x = df.crossJoin(F.broadcast(norm))  # one row
    v = lambda c, k="": F.try_divide(F.col(f"_{k}_{c}" if k else c).cast("double"), F.col(f"_n_{c}")) * w[c]
    far = lambda good: F.sqrt(sum((F.pow(v(c) - v(c, "hi" if (c not in cost) == good else "lo"), 2) for c in w), F.lit(0.0)))
    return x.select(key, F.try_divide(far(False), far(False) + far(True)).alias("closeness"))


def promethee(df: DataFrame, key: str, weights: Mapping[str, float]) -> DataFrame:
    """Positive, negative and net flow of each alternative, without forming pairs.

    For a criterion the sum of positive differences to all others is rank times value minus the sum of the smaller ones, so
    counts of distinct values and their running sums suffice; these run over the values' histogram, not over rows.
    """
    w = _shares(weights)
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("w"), F.col(c).cast("double").alias("v")) for c, s in w.items()])).alias("p")).select(key, "p.*").where("v IS NOT NULL")
    values = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    cum = running(values, ["c"], "v", ["n", "s"]).withColumnsRenamed({"_b_n": "nb", "_b_s": "sb", "_t_n": "nt", "_t_s": "st"})
    na, sa = F.col("nt") - F.col("nb") - F.col("n"), F.col("st") - F.col("sb") - F.col("n") * F.col("v")
    flows = cum.select("c", "v", (F.col("nb") * F.col("v") - F.col("sb")).alias("up"), (sa - na * F.col("v")).alias("down"))
    got = long.join(flows, ["c", "v"]).groupBy(key).agg(*[(F.sum(F.col("w") * F.col(c)) / len(w)).alias(n) for c, n in (("up", "positive"), ("down", "negative"))])
    return got.select(key, "positive", "negative", (F.col("positive") - F.col("negative")).alias("net"))


def electre(df: DataFrame, key: str, weights: Mapping[str, float], most: int | None = None) -> DataFrame:
    """Concordance and discordance of each alternative against all others.

    Concordance is a sum of ranks, from histograms of the values. Discordance takes the largest of several gaps for each pair. Of one or two criteria it is
    a sum over ranges of values, and no pairs are made; of more, or where a value isn't finite, pairs of distinct alternatives are compared, and their number grows with the square. If
    ``most`` is given, more alternatives than that are an error.
    """
    if most is not None and df.count() > most:
        raise ValueError(f"more than {most} alternatives; their pairs grow with the square")
    w = _shares(weights)
    rows = df.where(F.col(key).isNotNull()).select(key, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(w)])
    names = rows.columns[1:]
    kinds = materialize(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "kinds")
    long = kinds.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("w"), F.col(c).alias("v")) for c, s in zip(names, w.values(), strict=True)])).alias("p")).select("n", "p.*").where("v IS NOT NULL")
    values = long.groupBy("c", "w", "v").agg(F.sum("n").alias("n"))
    ranks = running(values, ["c"], "v", ["n"]).select("c", "v", (F.col("w") * (2 * F.col("_b_n") + F.col("n") - F.col("_t_n"))).alias("s"))
    odd = functools.reduce(lambda p, q: p | q, [F.isnan(c) | (F.abs(c) == float("inf")) for c in names])
    disc = _gaps_by_pairs(kinds, names) if len(names) > 2 or kinds.where(odd).take(1) else _gaps_by_ranges(kinds, names)
    same = [F.col(c).eqNullSafe(F.col(f"a{c}")) for c in names]
    out = rows.join(disc, functools.reduce(lambda p, q: p & q, same))
    conc = F.lit(0.0)
    for c in names:
        out = out.join(ranks.where(F.col("c") == c).select(F.col("v").alias(c), F.col("s").alias(f"s{c}")), c, "left")
        conc = conc + F.coalesce(f"s{c}", F.lit(0.0))
    return out.groupBy(key).agg(F.sum(conc).alias("concordance"), F.sum("discordance").alias("discordance"))


def _gaps_by_pairs(kinds: DataFrame, names: Sequence[str]) -> DataFrame:
    """The sum over all pairs of the largest gap above less the largest gap below, with names behind an ``a``; tasks hold about 100 million pairs each."""
    a, b = (kinds.select(*[F.col(c).alias(f"{e}{c}") for c in names], F.col("n").alias(f"{e}n")) for e in "ab")
    tasks = min(10_000, max(8, kinds.count() ** 2 // 100_000_000))
    gap = lambda x, y: F.greatest(F.lit(0.0), *[F.col(f"{x}{c}") - F.col(f"{y}{c}") for c in names])
    return a.repartition(tasks).crossJoin(b).groupBy(*[f"a{c}" for c in names]).agg(F.sum(F.col("bn") * (gap("a", "b") - gap("b", "a"))).alias("discordance"))


def _gaps_by_ranges(kinds: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same for one or two criteria with finite values, in rows that grow with ``n log n``.

    With the gaps ``u, v`` of a pair it is ``u + v``, less the nearer to 0 of them if both have one sign. Sums of ``u`` and ``v`` come from counts and totals. Which is the nearer depends on the order of the differences
    between both criteria: ``u`` where the one above in the first criterion isn't below in the difference, else ``v``. Differences are ranked;
    two ranks first part at one bit, so for each bit, and the bits above it, running sums over a criterion's values give all pairs that part there.
    """
    x, y = F.col(names[0]), F.col(names[1]) if len(names) > 1 else F.lit(None).cast("double")
    k = kinds.select(x.alias("x"), y.alias("y"), "n")
    n = F.col("n")
    total = k.agg(*[F.coalesce(F.sum(F.when(F.col(c).isNotNull(), v)), F.lit(0)).alias(f"{m}{c}") for c in "xy" for m, v in (("n", n), ("s", n * F.col(c)))])
    both = k.where("x IS NOT NULL AND y IS NOT NULL").withColumn("d", F.col("y") - F.col("x"))
    levels = both.groupBy("d").agg(F.lit(1).alias("one"), F.sum("n").alias("nd"), F.sum(n * F.col("x")).alias("sd"))
    levels = materialize(running(levels, [], "d", ["one"]), "differences")
    most = levels.select("_t_one").first()
    bits = max(1, (most[0] - 1).bit_length()) if most else 1
    ranked = materialize(both.join(levels.select("d", F.col("_b_one").cast("long").alias("r"), "nd", "sd"), "d"), "ranked")
    deal = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(b).alias("b"), F.col(c).alias("v")) for b in range(bits) for c in "xy"]))
    bit = F.call_function("shiftright", F.col("r"), F.col("p.b")).bitwiseAND(F.lit(1)).alias("bit")
    dealt = ranked.select("x", "y", "n", "r", deal.alias("p")).select("x", "y", "n", "p.c", "p.b", F.call_function("shiftright", F.col("r"), F.col("p.b") + 1).alias("head"), "p.v", bit)
    at = ["c", "b", "head"]
    values = dealt.groupBy(*at, "v").agg(*[F.coalesce(F.sum(F.when(F.col("bit") == i, n)), F.lit(0)).alias(f"n{i}") for i in (0, 1)])
    values = values.withColumns({f"s{i}": F.col(f"n{i}") * F.col("v") for i in (0, 1)})
    below = lambda i: F.col("v") * F.col(f"_b_n{i}") - F.col(f"_b_s{i}")
    above = lambda i: F.col("v") * (F.col(f"_t_n{i}") - F.col(f"_b_n{i}") - F.col(f"n{i}")) - (F.col(f"_t_s{i}") - F.col(f"_b_s{i}") - F.col(f"s{i}"))
    first = F.col("c") == "x"
    near = running(values, at, "v", ["n0", "s0", "n1", "s1"]).select(*at, "v", F.when(first, above(1)).otherwise(below(1)).alias("g0"), F.when(first, below(0)).otherwise(above(0)).alias("g1"))
    parted = dealt.join(near, [*at, "v"]).groupBy("x", "y").agg(F.sum(F.when(F.col("bit") == 0, F.col("g0")).otherwise(F.col("g1"))).alias("g"))
    nearer = ranked.join(parted, ["x", "y"]).select(F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("g") + F.col("nd") * F.col("x") - F.col("sd")).alias("g"))
    whole = k.join(F.broadcast(total)).join(nearer, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")  # one row
    part = [F.coalesce(v, F.lit(0.0)) for v in (F.col("nx") * F.col("x") - F.col("sx"), F.col("ny") * F.col("y") - F.col("sy"), -F.col("g"))]
    return whole.select(*[F.col(c).alias(f"a{o}") for c, o in zip("xy", names)], (part[0] + part[1] + part[2]).alias("discordance"))


#: Random consistency of pairwise comparisons by size, fixed values.
RANDOM_INDEX = (0.0, 0.0, 0.58, 0.9, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49)


def comparison_weights(matrix: Sequence[Sequence[float]]) -> tuple[list[float], float]:
    """Weights from a matrix of pairwise comparisons (its principal eigenvector) and its consistency ratio."""
    m = np.array(matrix, float)
    values, vectors = np.linalg.eig(m)
    top = int(values.real.argmax())
    w = np.abs(vectors[:, top].real)
    n = len(m)
    index = (values[top].real - n) / (n - 1) if n > 1 else 0.0
    random = RANDOM_INDEX[min(n, len(RANDOM_INDEX)) - 1]
    return (w / w.sum()).tolist(), float(index / random) if random else 0.0


def weighted_sum(df: DataFrame, key: str, weights: Mapping[str, float]) -> DataFrame:
    """The weighted sum of criteria, null if one of them is."""
    return df.select(key, sum((F.col(c).cast("double") * w for c, w in _shares(weights).items()), F.lit(0.0)).alias("score"))


def environmental_similarity(reference: DataFrame, other: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """Similarity of each row to a reference by variable, and the least of them.

    The share of reference values below a value comes from the reference's histogram: both are put in order together, and a
    running sum over distinct values gives the share.
    """
    long = lambda df, cols: df.select(*cols, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in variables])).alias("p")).select(*cols, "p.*").where("v IS NOT NULL")
    ref = long(reference, []).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    new = long(other, [key])
    points = ref.unionByName(new.select("c", "v").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("c", "v").agg(F.sum("n").alias("n"))
    ends = ref.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    f = 100 * F.col("_b_n") / F.col("_t_n")
    ranked = running(points, ["c"], "v", ["n"]).join(F.broadcast(ends), "c").select("c", "v", f.alias("f"), "lo", "hi")  # a row per variable
    span = F.col("hi") - F.col("lo")
    s = F.when(F.col("f") == 0, F.try_divide(100 * (F.col("v") - F.col("lo")), span)).when(F.col("f") <= 50, 2 * F.col("f")).when(F.col("f") < 100, 2 * (100 - F.col("f"))).otherwise(F.try_divide(100 * (F.col("hi") - F.col("v")), span))
    scored = new.join(ranked.select("c", "v", s.alias("s")), ["c", "v"])
    return scored.groupBy(key).agg(*[F.max(F.when(F.col("c") == c, F.col("s"))).alias(f"mess_{c}") for c in variables], F.min("s").alias("mess"))


def novelty(reference: DataFrame, other: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """Type 1 (outside of the reference's ranges, below 0) or else type 2 novelty (Mahalanobis distance against the reference's largest)."""
    n = len(variables)
    means = reference.dropna(subset=list(variables)).agg(*[f(v).alias(f"_{k}{i}") for i, v in enumerate(variables) for k, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))], *[F.covar_samp(variables[i], variables[j]).alias(f"_c{i}_{j}") for i in range(n) for j in range(i, n)])
    row = means.first()  # one row of as many figures as there are pairs of variables
    cov = np.array([[row[f"_c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    inverse = np.linalg.pinv(cov)
    centred = [F.col(v) - F.lit(row[f"_m{i}"]) for i, v in enumerate(variables)]
    d2 = sum((centred[i] * centred[j] * F.lit(float(inverse[i, j])) for i in range(n) for j in range(n)), F.lit(0.0))
    most = reference.dropna(subset=list(variables)).agg(F.max(d2).alias("d")).first()["d"]
    out = []
    for i, v in enumerate(variables):
        lo, hi = row[f"_lo{i}"], row[f"_hi{i}"]
        out.append(F.least(F.col(v) - F.lit(lo), F.lit(hi) - F.col(v), F.lit(0.0)) / F.lit(float(hi - lo) or None))
    nt1 = sum(out, F.lit(0.0))
    nt2 = F.sqrt(d2 / F.lit(most))
    return other.select(key, nt1.alias("nt1"), nt2.alias("nt2"), F.when(nt1 < 0, nt1).otherwise(nt2).alias("novelty"))


def variance_inflation(df: DataFrame, variables: Sequence[str]) -> dict[str, float]:
    """1 / (1 - R2) of each variable against the others, from one pass of correlations; infinite if it depends on them."""
    ok = df.dropna(subset=list(variables))
    n = len(variables)
    row = ok.agg(*[F.corr(variables[i], variables[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i + 1, n)]).first()
    m = np.eye(n)
    for i in range(n):
        for j in range(i + 1, n):
            m[i, j] = m[j, i] = row[f"c{i}_{j}"]
    out = {}
    for i, v in enumerate(variables):
        rest = [j for j in range(n) if j != i]
        r2 = float(m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)]) @ m[rest, i]) if rest else 0.0
        out[v] = float("inf") if r2 > 0.9999999999 else 1 / (1 - r2)
    return out


def stepwise_vif(df: DataFrame, variables: Sequence[str], limit: float = 10.0) -> list[tuple[int, str, float]]:
    """The largest inflation of each step while it reaches the limit; its variable goes."""
    left, steps = list(variables), []
    while len(left) > 1:
        vif = variance_inflation(df, left)
        worst = max(left, key=lambda v: (vif[v], v))
        if vif[worst] < limit:
            break
        steps.append((len(steps) + 1, worst, vif[worst]))
        left.remove(worst)
    return steps


def evaluation_curve(df: DataFrame, truth: str, score: str, bins: int) -> DataFrame:
    """Rates, skill and kappa at ``bins`` descending thresholds of a score; counts by bin are summed from the highest bin on."""
    ok = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    limits = ok.agg(F.min(score).cast("double").alias("_lo"), F.max(score).cast("double").alias("_hi"))
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("_hi") - F.col(score)) * bins, F.col("_hi") - F.col("_lo")))).cast("int")
    counts = ok.crossJoin(F.broadcast(limits)).groupBy(at.alias("bin"), "_lo", "_hi").agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("q"))
    w = Window.orderBy("bin")  # as many rows as bins
    run = counts.select("bin", (F.col("_hi") - (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("threshold"), *[F.sum(c).over(w).alias(n) for c, n in (("p", "tp"), ("q", "fp"))], *[F.sum(c).over(Window.partitionBy()).alias(n) for c, n in (("p", "np"), ("q", "nn"))])
    tpr, fpr = F.try_divide("tp", "np"), F.try_divide("fp", "nn")
    tn, fn = F.col("nn") - F.col("fp"), F.col("np") - F.col("tp")
    kappa = F.try_divide(2.0 * (F.col("tp") * tn - fn * F.col("fp")), (F.col("tp") + F.col("fp")) * F.col("nn") + F.col("np") * (tn + fn))
    out = run.select("bin", "threshold", "tp", "fp", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("tss"), kappa.alias("kappa"), F.sqrt(F.pow(1 - tpr, 2) + F.pow(fpr, 2)).alias("distance"))
    lag = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    return out.withColumn("auc_to_here", F.sum((F.col("fpr") - lag("fpr")) * (F.col("tpr") + lag("tpr")) / 2).over(w))
