"""Zonal statistics: cells grouped by zone and aggregated in one shuffle, with partial sums on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.ordered import percentile_columns, running


def univar(cells: DataFrame, zones: Sequence[str], value: str) -> DataFrame:
    """Univariate statistics of ``value`` in each zone; null cells are counted and otherwise skipped."""
    v = F.col(value)
    return cells.groupBy(*zones).agg(
        F.count(v).alias("n"),
        (F.count(F.lit(1)) - F.count(v)).alias("null_cells"),
        F.count(F.lit(1)).alias("cells"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"),
        F.avg(v).alias("mean"),
        F.avg(F.abs(v)).alias("mean_of_abs"),
        F.sum(v).alias("sum"),
        F.sum(F.abs(v)).alias("sum_abs"),
    )


def moments(cells: DataFrame, zones: Sequence[str], value: str) -> DataFrame:
    """Sample variance and what follows from it, skewness and kurtosis from the sums of the first four powers.

    Zones without a value are left out; a variance needs two values, and shape needs a variance above 0.
    """
    v = F.col(value).cast("double")
    sums = cells.groupBy(*zones).agg(F.count(v).alias("n"), *[F.sum(F.pow(v, k)).alias(f"s{k}") for k in (1, 2, 3, 4)]).where("n > 0")
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    mean = s1 / n
    variance = F.when(n > 1, F.greatest(F.try_divide(s2 - s1 * mean, n - 1), F.lit(0.0)))
    third = s3 / n - 3 * s1 * s2 / (n * n) + 2 * F.pow(mean, 3)
    fourth = s4 / n - 4 * s1 * s3 / (n * n) + 6 * s1 * s1 * s2 / F.pow(n, F.lit(3)) - 3 * F.pow(mean, 4)
    return sums.select(
        *zones,
        "n",
        variance.alias("variance"),
        F.sqrt(variance).alias("stddev"),
        F.try_divide(100 * F.sqrt(variance), mean).alias("coeff_var"),
        F.try_divide(third, F.pow(variance, 1.5)).alias("skewness"),
        (F.try_divide(fourth, variance * variance) - 3).alias("kurtosis"),
    )


def quartiles(cells: DataFrame, zones: Sequence[str], value: str, percents: Sequence[float] = (25, 50, 75)) -> DataFrame:
    """Exact interpolated percentiles by zone, null where a zone has no value; all of them come from one sorted histogram."""
    counts = cells.groupBy(*zones, value).agg(F.count(value).alias("_n"))  # a null's count is 0
    shares = {f"perc_{p:g}".replace(".", "_"): p / 100 for p in percents}
    return running(counts, zones, value, ["_n"]).groupBy(*zones).agg(*percentile_columns(value, "_n", shares))


def boxplot(cells: DataFrame, zones: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers, notches and the number of outliers by zone; whiskers end ``reach`` interquartile ranges out."""
    counts = running(cells.where(F.col(value).isNotNull()).groupBy(*zones, value).agg(F.count(F.lit(1)).alias("_n")), zones, value, ["_n"])
    q = counts.groupBy(*zones).agg(F.sum("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), *percentile_columns(value, "_n", {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    iqr = F.col("q3") - F.col("q1")
    limits = q.withColumns(
        {
            "lower": F.greatest("min", F.col("q1") - reach * iqr),
            "upper": F.least("max", F.col("q3") + reach * iqr),
            "notch_low": F.col("q2") - 1.57 * iqr / F.sqrt("n"),
            "notch_high": F.col("q2") + 1.57 * iqr / F.sqrt("n"),
        }
    )
    ends = limits.select(*[F.col(z).alias(f"_z{i}") for i, z in enumerate(zones)], F.col("lower").alias("_lower"), F.col("upper").alias("_upper"))
    same = [F.col(z).eqNullSafe(F.col(f"_z{i}")) for i, z in enumerate(zones)]
    outside = (F.col(value) < F.col("_lower")) | (F.col(value) > F.col("_upper"))
    counted = counts.join(ends, same).groupBy(*[f"_z{i}" for i in range(len(zones))]).agg(F.coalesce(F.sum(F.when(outside, F.col("_n"))), F.lit(0)).alias("outliers"))
    return limits.join(counted, same).select(*limits.columns, "outliers")


def class_proportions(cells: DataFrame, zone: str, cls: str, percent: bool = False, decimals: int = 4) -> DataFrame:
    """Share of each class in each zone, absent classes with 0, and whether the class is the zone's mode (ties to the smallest)."""
    counts = cells.groupBy(zone, cls).agg(F.count(F.lit(1)).alias("n"))
    every = cells.select(zone).distinct().crossJoin(cells.select(cls).distinct())
    full = every.join(counts, every[zone].eqNullSafe(counts[zone]) & every[cls].eqNullSafe(counts[cls]), "left").select(every[zone], every[cls], F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(zone)
    best = F.min_by(F.struct(cls), F.struct(-F.col("n"), F.col(cls).isNull(), F.col(cls))).over(w)[cls]
    return full.select(zone, cls, "n", F.round((100 if percent else 1) * F.col("n") / F.sum("n").over(w), decimals).alias("proportion"), F.col(cls).eqNullSafe(best).alias("is_mode"))


def confusion(pairs: DataFrame, classified: str, reference: str) -> DataFrame:
    """Counts for each pair of classes, with 0 for pairs that don't occur; both sides have the same classes."""
    counts = pairs.where(F.col(classified).isNotNull() & F.col(reference).isNotNull()).groupBy(F.col(classified).alias("classified"), F.col(reference).alias("reference")).agg(F.count(F.lit(1)).alias("n"))
    names = counts.select(F.explode(F.array("classified", "reference")).alias("c")).distinct()
    grid = names.select(F.col("c").alias("classified")).crossJoin(names.select(F.col("c").alias("reference")))
    return grid.join(counts, ["classified", "reference"], "left").select("classified", "reference", F.coalesce("n", F.lit(0)).alias("n"))


def accuracies(matrix: DataFrame) -> DataFrame:
    """User's and producer's accuracy, omission and commission in percent by class, and overall accuracy and kappa."""
    diagonal = F.when(F.col("classified") == F.col("reference"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("classified").alias("class")).agg(F.sum("n").alias("row"), F.sum(diagonal).alias("hit"))
    cols = matrix.groupBy(F.col("reference").alias("class")).agg(F.sum("n").alias("col"))
    both = rows.join(cols, "class").crossJoin(_agreement(matrix))  # one row
    ua = F.when(F.col("row") == 0, None).otherwise(F.try_divide(100 * F.col("hit"), F.col("row")))
    pa = F.when(F.col("col") == 0, None).otherwise(F.try_divide(100 * F.col("hit"), F.col("col")))
    return both.select("class", *[F.round(e, 2).alias(k) for k, e in (("user_accuracy", ua), ("commission", 100 - ua), ("producer_accuracy", pa), ("omission", 100 - pa), ("overall_accuracy", F.col("overall")), ("kappa", F.col("kappa")))])


def _agreement(matrix: DataFrame) -> DataFrame:
    total = matrix.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("classified") == F.col("reference"), F.col("n"))).alias("hits"))
    row = matrix.groupBy(F.col("classified").alias("c")).agg(F.sum("n").alias("r"))
    col = matrix.groupBy(F.col("reference").alias("c")).agg(F.sum("n").alias("k"))
    chance = row.join(col, "c").agg(F.sum(F.col("r").cast("double") * F.col("k")).alias("chance"))
    oa, pc = F.try_divide(F.col("hits"), F.col("total")), F.try_divide(F.col("chance"), F.col("total").cast("double") * F.col("total"))
    return total.crossJoin(chance).select((100 * oa).alias("overall"), F.try_divide(oa - pc, 1 - pc).alias("kappa"))  # one row each


def weighted_kappa(matrix: DataFrame, power: int = 1) -> DataFrame:
    """Kappa with disagreement weighted by the class distance to a power: 0 any, 1 linear, 2 quadratic."""
    gap = F.col("classified") - F.col("reference")
    w = (gap != 0).cast("double") if power == 0 else F.pow(F.abs(gap).cast("double"), power)
    seen = matrix.agg(F.sum(w * F.col("n")).alias("o"), F.sum("n").alias("total"))
    row = matrix.groupBy("classified").agg(F.sum("n").alias("r"))
    col = matrix.groupBy("reference").agg(F.sum("n").alias("k"))
    chance = row.crossJoin(col).agg(F.sum(w * F.col("r") * F.col("k")).alias("e"))
    return seen.crossJoin(chance).select((1 - F.try_divide(F.col("o") * F.col("total"), F.col("e"))).alias("kappa"))


def histogram_bin(v: Column, start: float, end: float, bins: int) -> Column:
    """Right-closed bin from 1 to ``bins``; 0 below the range, ``bins + 1`` above it; the first bin has its start too."""
    step = (end - start) / bins
    return F.when(v < start, 0).when(v > end, bins + 1).otherwise(F.greatest(F.lit(1), F.ceil((v - start) / step).cast("int")))


def joint_histogram(df: DataFrame, keys: Sequence[str], first: tuple[str, float, float, int], second: tuple[str, float, float, int]) -> DataFrame:
    """Density of value pairs over two ranges of bins with under- and overflow; rows with a null in either are skipped."""
    bins = [histogram_bin(F.col(c), *spec).alias(f"bin{k}") for k, (c, *spec) in enumerate((first, second), 1)]
    counted = df.where(F.col(first[0]).isNotNull() & F.col(second[0]).isNotNull()).groupBy(*keys, *bins).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def diversity(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Diversity of the parts that make up each key's total: entropies, effective numbers, evenness and Simpson's indices."""
    v = F.col(value).cast("double")
    parts = df.where(v > 0)
    whole = parts.groupBy(*keys).agg(F.sum(v).alias("total"), F.count(F.lit(1)).alias("richness"), F.sum(v * F.ln(v)).alias("vlnv"), F.sum(v * v).alias("squares"))
    shannon = F.ln("total") - F.col("vlnv") / F.col("total")
    simpson = F.col("squares") / (F.col("total") * F.col("total"))
    return whole.select(
        *keys,
        "richness",
        shannon.alias("shannon"),
        F.exp(shannon).alias("effective_number"),
        F.when(F.col("richness") > 1, shannon / F.ln("richness")).alias("evenness"),
        (1 / simpson).alias("inverse_simpson"),
        (1 - simpson).alias("gini_simpson"),
        (-F.ln(simpson)).alias("renyi_2"),
    )


def niche_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Overlap D, similarity I and Pearson's r of two surfaces, each as shares of its own total."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = both.agg(F.sum(a).alias("_ta"), F.sum(b).alias("_tb"))
    pa, pb = F.col(a) / F.col("_ta"), F.col(b) / F.col("_tb")
    return both.crossJoin(F.broadcast(sums)).agg(  # one row of totals
        (1 - F.sum(F.abs(pa - pb)) / 2).alias("niche_d"), (1 - F.sum(F.pow(F.sqrt(pa) - F.sqrt(pb), 2)) / 2).alias("niche_i"), F.corr(a, b).alias("pearson")
    )


def environmental_bias(df: DataFrame, value: str, sample: Column) -> DataFrame:
    """Distance of the sample's median from that of all cells, in median absolute deviations."""
    counts = running(df.groupBy(value).agg(F.count(value).alias("_n"), F.count(F.when(sample, F.col(value))).alias("_s")), [], value, ["_n", "_s"])
    m = counts.agg(*percentile_columns(value, "_n", {"_all": 0.5}), *percentile_columns(value, "_s", {"_part": 0.5}))
    gaps = counts.crossJoin(F.broadcast(m.select("_all"))).groupBy(F.abs(F.col(value) - F.col("_all")).alias("_gap")).agg(F.sum("_n").alias("_n"))  # one row
    mad = running(gaps, [], "_gap", ["_n"]).agg(*percentile_columns("_gap", "_n", {"mad": 0.5}))
    return m.crossJoin(mad).select(F.col("_all").alias("median_all"), F.col("_part").alias("median_sample"), "mad", F.try_divide(F.abs(F.col("_all") - F.col("_part")), F.col("mad")).alias("bias"))  # one row each


def shift_information(df: DataFrame, keys: Sequence[str], date: str, cls: str) -> DataFrame:
    """How much the distribution of classes changes between dates: entropy gain, gain ratio, distance and chi square."""
    cell = df.groupBy(*keys, date, cls).agg(F.count(F.lit(1)).cast("double").alias("n"))
    per_date = cell.groupBy(*keys, date).agg(F.sum("n").alias("nd"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    dates = per_date.groupBy(*keys).agg(F.sum("nd").alias("total"), F.count(F.lit(1)).alias("dates"), F.sum(F.col("nd") * F.log2("nd") - F.col("nlogn")).alias("inner"))
    per_class = cell.groupBy(*keys, cls).agg(F.sum("n").alias("nc"))
    combined = per_class.groupBy(*keys).agg(F.sum("nc").alias("_t"), F.sum(F.col("nc") * F.log2("nc")).alias("_s")).select(*keys, (F.log2("_t") - F.col("_s") / F.col("_t")).alias("h_all"))
    # chi square over all class-date pairs is total * (sum n^2 / (nd * nc) - 1), which needs the pairs that occur only
    chi = cell.join(per_date.drop("nlogn"), [*keys, date]).join(per_class, [*keys, cls]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("n") / (F.col("nd") * F.col("nc"))).alias("_q"))
    out = dates.join(combined, list(keys)).join(chi, list(keys))
    h_in = F.col("inner") / F.col("total")
    return out.select(*keys, "dates", F.greatest(F.lit(0.0), F.col("h_all") - h_in).alias("gain"), (1 - F.try_divide(h_in, F.col("h_all"))).alias("ratio"), (F.col("total") * (F.col("_q") - 1)).alias("chi_square"))
