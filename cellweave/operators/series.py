"""Series of values per cell: regression, accumulation, quantiles, trends, seasons and filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Straight line through each key's complete pairs, with fit and test figures; nulls where there are too few pairs."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy")
    )
    slope = F.try_divide("sxy", "sxx")
    r2 = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))
    f = F.try_divide(r2 * (F.col("n") - 2), 1 - r2)
    enough = lambda e, n=2: F.when(F.col("n") >= n, e)
    return sums.select(
        *keys,
        "n",
        enough(slope).alias("slope"),
        enough(F.col("my") - slope * F.col("mx")).alias("offset"),
        enough(F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))).alias("corr"),
        enough(r2).alias("r2"),
        enough(1 - (1 - r2) * (F.col("n") - 1) / F.when(F.col("n") > 2, F.col("n") - 2), 3).alias("adj_r2"),
        enough(f, 3).alias("f"),
        enough(F.sqrt(f), 3).alias("t"),
    )


def multiple_regression(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Least squares without an intercept per key, from the sums of products: one aggregation, whatever the length of a series.

    Rows with a null are dropped; keys with fewer rows than coefficients, or dependent columns, get nulls.
    """
    ok = df.dropna(subset=[*xs, y])
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    sums = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(xs[i]).cast("double") * F.col(xs[j])).alias(f"_x{i}_{j}") for i, j in pairs], *[F.sum(F.col(x).cast("double") * F.col(y)).alias(f"_y{i}") for i, x in enumerate(xs)]
    )
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys] + ["n long"] + [f"b_{x} double" for x in xs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            m = np.zeros((len(part), len(xs), len(xs)))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = part[f"_x{i}_{j}"]
            rhs = part[[f"_y{i}" for i in range(len(xs))]].to_numpy()
            out = part[[*keys, "n"]].copy()
            scale = np.sqrt(np.maximum(np.einsum("kii->ki", m), 1e-300))
            norm = m / scale[:, :, None] / scale[:, None, :]
            good = (part["n"].to_numpy() >= len(xs)) & (np.linalg.matrix_rank(norm, tol=1e-10) == len(xs) if len(part) else False)
            b = np.full((len(part), len(xs)), np.nan)
            if good.any():
                b[good] = np.linalg.solve(norm[good], (rhs / scale)[good][:, :, None])[:, :, 0] / scale[good]
            for i, x in enumerate(xs):
                out[f"b_{x}"] = pd.Series(b[:, i], index=part.index).astype(object).where(good, None)
            yield out

    return sums.mapInPandas(solve, kinds)


def growing_degree_days(df: DataFrame, keys: Sequence[str], value: str, *, baseline: float, cutoff: float | None = None, scale: float = 1.0, shift: float = 0.0, low: float | None = None, high: float | None = None, huglin: bool = False) -> DataFrame:
    """Mean (or mean of mean and maximum) above a baseline, capped at the cutoff; values out of range are nulls."""
    v = F.col(value) * scale + shift
    if low is not None:
        v = F.when(v.between(low, high), v)
    avg = (F.avg(v) + F.max(v)) / 2 if huglin else F.avg(v)
    avg = F.greatest(avg, F.lit(baseline))
    if cutoff is not None:
        avg = F.least(avg, F.lit(cutoff))
    return df.groupBy(*keys).agg(F.when(F.count(v) > 0, F.greatest(F.lit(0.0), avg - baseline)).alias("gdd"))


def reference_quantile(v: Column, references: Column) -> Column:
    """Where a value lies in the sorted array ``references``: 0 to 1 inside, -1 below, 2 above; null if a reference is null."""
    refs = F.array_sort(references)
    n = F.size(refs)
    below = F.size(F.filter(refs, lambda r: r < v))
    equal = F.size(F.filter(refs, lambda r: r == v))
    lo, hi = F.element_at(refs, F.greatest(below, F.lit(1))), F.element_at(refs, F.least(below + 1, n))
    inside = F.when(equal > 0, (below + (equal - 1) / 2) / (n - 1)).otherwise((below - 1 + (v - lo) / (hi - lo)) / (n - 1))
    return (
        F.when(v.isNull() | F.exists(references, lambda r: r.isNull()) | (n == 0), None)
        .when(below + equal == 0, -1.0)
        .when(below == n, 2.0)
        .when(n == 1, 0.5)
        .otherwise(inside)
    )


#: Series of up to so many values have all their slopes in memory at once; longer ones are passed over in blocks of as many slopes.
SLOPES_AT_ONCE = 2_000_000


def _slopes(t: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Slopes of all pairs of different times, later less earlier, in blocks, with the sum of the signs of their rises. Pairs of one time have no slope, but a sign."""
    n = len(t)
    step = max(1, SLOPES_AT_ONCE // max(n, 1))
    for at in range(0, n, step):
        rows = slice(at, min(at + step, n))
        dt, dv = t[None, at:] - t[rows, None], v[None, at:] - v[rows, None]
        later = np.arange(at, n)[None, :] > np.arange(n)[rows, None]
        some = later & (dt != 0)
        yield dv[some] / dt[some], int(np.sign(dv[later]).sum())


def middle_slope(t: np.ndarray, v: np.ndarray) -> tuple[float | None, int]:
    """The median slope (the upper one of two) and the Mann-Kendall sum of a series in the order of time.

    The bits of a double, turned so that they sort as it does, are narrowed down 16 at a time by histograms of all slopes, so a long series takes time
    with the square of its length, as its slopes do, but memory in proportion to it.
    """
    if len(t) * (len(t) - 1) // 2 <= SLOPES_AT_ONCE:
        parts = list(_slopes(t, v))
        slopes, kendall = np.concatenate([np.zeros(0), *[s for s, _ in parts]]), sum(k for _, k in parts)
        return (float(np.partition(slopes, len(slopes) // 2)[len(slopes) // 2]) if len(slopes) else None), kendall
    prefix, rank = np.uint64(0), None
    for level in range(4):
        shift = np.uint64(48 - 16 * level)
        counts, kendall = np.zeros(1 << 16, np.int64), 0
        for s, k in _slopes(t, v):
            bits = (s + 0.0).view(np.int64)
            keys = np.where(bits < 0, ~bits, bits | np.int64(-(2**63))).view(np.uint64)
            if level:
                keys = keys[keys >> (shift + np.uint64(16)) == prefix]
            counts += np.bincount((keys >> shift & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            kendall += k
        if rank is None:
            if not counts.sum():
                return None, kendall
            rank = int(counts.sum()) // 2
        ends = np.cumsum(counts)
        at = int(np.searchsorted(ends, rank, "right"))
        rank -= int(ends[at] - counts[at])
        prefix = prefix << np.uint64(16) | np.uint64(at)
    bits = prefix.view(np.int64)
    return float((bits ^ np.int64(-(2**63)) if bits < 0 else ~bits).view(np.float64)), kendall


def theil_sen(df: DataFrame, keys: Sequence[str], t: str, v: str) -> DataFrame:
    """Median slope (the upper one) and the Mann-Kendall sum of each key's series, of any length; null slope with fewer than two times.

    A series' values travel once, to one task, which passes over the slopes of its pairs in blocks (``middle_slope``); no pair becomes a row.
    """
    rows = df.where(F.col(t).isNotNull() & F.col(v).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v")))).alias("s"))
    rows = rows.select(F.struct(*keys).alias("k"), F.transform("s", lambda x: x["t"]).alias("t"), F.transform("s", lambda x: x["v"]).alias("v"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [middle_slope(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            n = np.diff(batch.column(1).offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array([m for m, _ in found], pa.float64()), pa.array([k for _, k in found], pa.int64())], ["k", "n", "slope", "mann_kendall"])

    return rows.mapInArrow(fit, f"k {rows.schema['k'].dataType.simpleString()}, n int, slope double, mann_kendall long").select("k.*", "n", "slope", "mann_kendall")


def newest(df: DataFrame, keys: Sequence[str], t: str, v: str, oldest: bool = False) -> DataFrame:
    """The first value that isn't null, newest (or oldest) first."""
    pick = F.min_by if oldest else F.max_by
    return df.where(F.col(v).isNotNull()).groupBy(*keys).agg(pick(v, t).alias(v))


def moving(df: DataFrame, keys: Sequence[str], t: str, v: str, width: int) -> DataFrame:
    """Mean and median over ``width`` (odd) neighbours in time, fewer at the ends."""
    if width % 2 == 0:
        raise ValueError("the width is odd")
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-(width // 2), width // 2)
    return df.select(*keys, t, v, F.avg(v).over(w).alias("moving_mean"), F.percentile(v, F.lit(0.5)).over(w).alias("moving_median"))


def islands(df: DataFrame, keys: Sequence[str], t: str, v: str, threshold: float, *, max_gap: int = 0, min_length: int = 1, below: bool = False) -> DataFrame:
    """Seasons: runs of steps at or above (or below) a threshold, gaps of up to ``max_gap`` steps inside them.

    ``core`` is the longest stretch without a gap; seasons whose core is shorter than ``min_length`` are left out.
    """
    on = df.where((F.col(v) < threshold) if below else (F.col(v) >= threshold)).select(*keys, t)
    w = Window.partitionBy(*keys).orderBy(t)
    step = F.col(t) - F.lag(t).over(w)
    runs = on.withColumns({"_new": F.when(step == 1, 0).otherwise(1), "_open": F.when(step <= max_gap + 1, 0).otherwise(1)})
    runs = runs.withColumns({"_run": F.sum("_new").over(w), "_season": F.sum("_open").over(w)})
    cores = runs.groupBy(*keys, "_season", "_run").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return cores.groupBy(*keys, "_season").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.max(F.col("b") - F.col("a") + 1).alias("core")).where(F.col("core") >= min_length).select(*keys, "start", "end", "core")


def line_bands(df: DataFrame, keys: Sequence[str], v: str, n: float = 1.0, error: bool = False) -> DataFrame:
    """Mean per key and the band of ``n`` standard deviations (or errors) around it."""
    half = n * F.stddev_samp(v) / (F.sqrt(F.count(v)) if error else F.lit(1.0))
    half = F.coalesce(half, F.lit(0.0))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.avg(v) - half).alias("low"), (F.avg(v) + half).alias("high"))


def bioclim(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bioclimatic figures from columns ``month, tmin, tmax, prec`` (12 months a key), quarters of three months wrapping round."""
    tavg = (F.col("tmin") + F.col("tmax")) / 2
    m = monthly.withColumns({"tavg": tavg})
    quarter = m.select(*keys, "tavg", "prec", F.explode(F.array(*[F.pmod(F.col("month") - 1 - k, F.lit(12)) for k in range(3)])).alias("q"))
    quarters = quarter.groupBy(*keys, "q").agg(F.avg("tavg").alias("qt"), F.sum("prec").alias("qp"))
    best = lambda out, by: F.max_by(out, F.struct(F.col(by), -F.col("q")))
    worst = lambda out, by: F.min_by(out, F.struct(F.col(by), F.col("q")))
    season = quarters.groupBy(*keys).agg(
        best("qt", "qp").alias("bio8"), worst("qt", "qp").alias("bio9"), F.max("qt").alias("bio10"), F.min("qt").alias("bio11"), F.max("qp").alias("bio16"), F.min("qp").alias("bio17"), best("qp", "qt").alias("bio18"), worst("qp", "qt").alias("bio19")
    )
    year = m.groupBy(*keys).agg(
        F.avg("tavg").alias("bio1"), F.avg(F.col("tmax") - F.col("tmin")).alias("bio2"), (100 * F.stddev_samp("tavg")).alias("bio4"), F.max("tmax").alias("bio5"), F.min("tmin").alias("bio6"), F.sum("prec").alias("bio12"), F.max("prec").alias("bio13"), F.min("prec").alias("bio14"), F.try_divide(100 * F.stddev_samp("prec"), 1 + F.avg("prec")).alias("bio15")
    )
    out = year.withColumn("bio7", F.col("bio5") - F.col("bio6")).withColumn("bio3", F.try_divide(100 * F.col("bio2"), F.col("bio7")))
    return out.join(season, list(keys)).select(*keys, *[f"bio{k}" for k in range(1, 20)])
