"""Ratings and lookups of sites: rain, water temperature, floods, rock slopes, rules, folds and boxes."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.surface import in_squares, levelled, levels_of, squares

#: For each return period in years, the two coefficients under 40, under 120 and under 1440 minutes.
RAIN_COEFFICIENTS = {
    2: ((0.166, 0.701), (0.237, 0.803), (0.235, 0.801)),
    5: ((0.171, 0.688), (0.265, 0.803), (0.324, 0.845)),
    10: ((0.163, 0.656), (0.280, 0.803), (0.380, 0.867)),
    20: ((0.169, 0.648), (0.300, 0.803), (0.463, 0.894)),
    50: ((0.174, 0.638), (0.323, 0.803), (0.580, 0.925)),
    100: ((0.173, 0.625), (0.335, 0.803), (0.642, 0.939)),
}


def design_rainfall(cells: DataFrame, zone: str, daily: Mapping[int, str], minutes: float, area: str | None = None, largest: float = 0) -> DataFrame:
    """Rain of so many minutes for each zone and return period, from the zone's mean daily rain; -1 where its area exceeds ``largest``."""
    if not 0 < minutes < 1440:
        raise ValueError("the rain must last less than a day")
    means = cells.groupBy(zone).agg(*[F.avg(c).alias(f"_{years}") for years, c in daily.items()], (F.max(area) if area else F.lit(0)).alias("_area"))
    out = []
    for years in daily:
        a, c = RAIN_COEFFICIENTS[years][(minutes >= 40) + (minutes >= 120)]
        rain = F.col(f"_{years}") * (a * minutes ** (1 - c))
        out.append((F.when(F.col("_area") > largest, F.lit(-1.0)).otherwise(rain) if area and largest > 0 else rain).alias(f"rain_{years}"))
    return means.select(zone, *out)


def lake_temperature(first: Column, second: Column, coefficients: Sequence[float]) -> Column:
    """Temperature of a lake's surface from two brightness temperatures, with a sensor's three split-window coefficients."""
    c0, c1, c2 = coefficients
    return first + c1 * (first - second) + c2 * (first - second) * (first - second) + c0


def direction_counts(df: DataFrame, azimuth: str, step: int) -> DataFrame:
    """Number and share in percent of azimuths in each bin of ``step`` degrees that has any; 360 belongs to the last, others outside 0 to 360 don't count."""
    bins = 360 // step
    at = F.least(F.floor(F.col(azimuth) * bins / 360), F.lit(bins - 1))
    n = df.where(F.col(azimuth).between(0, 360)).groupBy((at * (360 / bins)).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("start", "n", (100 * F.col("n") / F.col("_all")).alias("percent"))  # one row


def topographic_index(accumulation: Column, slope: Column, side: float) -> Column:
    """The modified topographic index of cells of ``side`` metres; the slope is in degrees."""
    n = 0.016 * side**0.46
    return F.ln(F.pow((accumulation + 1) * side, F.lit(n)) / F.tan(F.radians(slope + 0.001)))


def flood_threshold(side: float) -> float:
    """The index above which cells of ``side`` metres are prone to floods."""
    return 10.89 * 0.016 * side**0.46 + 2.282


def flood_prone(cells: DataFrame, accumulation: str, slope: str, side: float, width: int) -> DataFrame:
    """Cells above the threshold, in connected areas of at least a square kilometre; areas of other cells don't count as prone."""
    from cellweave.operators.graph import clumps, keep_areas

    index = topographic_index(F.col(accumulation), F.col(slope), side)
    wet = cells.where(index > flood_threshold(side)).select("x", "y", F.lit(1).alias("flood"))
    return keep_areas(clumps(wet, "flood", width), least=int(1000000 / side**2)).select("x", "y", "flood")


def regression_residuals(values: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    """What a least-squares line of ``y`` on ``x`` over all rows (cells, or one for each patch) leaves, with the line and its correlation."""
    both = values.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    line = both.agg(F.regr_intercept(y, x).alias("offset"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("correlation"))
    return both.crossJoin(F.broadcast(line)).select(*key, "offset", "slope", "correlation", (F.col(y) - (F.col("offset") + F.col("slope") * F.col(x))).alias("residual"))  # one row


def rock_ratings(dip_direction: Column, dip: Column, aspect: Column, slope: Column, rating: Column, method: Column) -> tuple[Column, Column]:
    """Slope mass rating for planar sliding and for toppling; directions clockwise from north, all angles in degrees.

    An angle between joint and slope of 270 degrees counts with the larger ones.
    """
    arc = lambda v: F.degrees(F.atan(v))
    gap = F.abs(dip_direction - aspect)
    # fixed values of the continuous rating functions
    first = lambda a: 0.64 - 0.006 * arc(0.1 * (F.when(a >= 270, F.abs(a - 360)).otherwise(a) - 17))
    planar = first(gap) * (0.56 + 0.005 * arc(0.17 * F.abs(dip) - 5)) * (-30 + 0.33 * arc(dip - slope))
    toppling = first(F.abs(gap - 180)) * (-13 - 0.143 * arc(dip + slope - 120))
    return planar + rating + method, toppling + rating + method


COMPARE = {"<": operator.lt, "<=": operator.le, "=": operator.eq, ">=": operator.ge, ">": operator.gt}


def rule_classes(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Sequence[tuple[str, str, float]]]]) -> DataFrame:
    """Each class that a rule gives a row, once; a rule holds where all its conditions (column, comparison, number) do."""
    given = []
    for name, conditions in rules:
        holds = F.lit(True)
        for column, sign, number in conditions:
            holds = holds & COMPARE[sign](F.col(column), F.lit(number))
        given.append(F.when(holds, F.lit(name)))
    return df.select(*keys, F.explode(F.array_distinct(F.array_compact(F.array(*given)))).alias("class"))


def decision_examples(df: DataFrame, attributes: Sequence[str], decision: str) -> DataFrame:
    """The distinct complete rows of attributes and decision that rules are learned from."""
    return df.select(*attributes, decision).dropna().distinct()


def folds(df: DataFrame, key: str, count: int, seed: str = "") -> DataFrame:
    """A fold from 0 to ``count - 1`` for each row, from a digest of its key, so that reruns and any partitioning agree."""
    digest = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % count).cast("int"))


def boxes_holding(points: DataFrame, boxes: DataFrame, key: str, side: float, every: bool) -> DataFrame:
    """Boxes (``x1, x2, y1, y2``, with their edges) that hold every point, or else any, and how many distinct places they hold.

    Boxes are dealt to the squares that they touch, of ``side`` or of a larger size that fits them, four at most; places look into their square of each
    size in use, and those that meet a box there are counted before they leave it.
    """
    corners = ("x1", "x2", "y1", "y2")
    boxed = levelled(boxes, side, corners)
    places = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
    met = in_squares(places, side, levels_of(boxed) or [0]).join(squares(boxed, side, corners), ["_l", "_sx", "_sy"]).where("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
    held = met.groupBy(key).agg(F.count(F.lit(1)).alias("held"))
    if not every:
        return held
    return held.crossJoin(F.broadcast(places.agg(F.count(F.lit(1)).alias("_all")))).where("held = _all").select(key, "held")  # one row


def listed_sites(sites: DataFrame, entries: DataFrame, key: str, column: str, codes: Sequence[str]) -> DataFrame:
    """Sites beside each of their entries whose ``column`` is one of the codes."""
    return sites.join(entries.where(F.col(column).isin(*codes)), key)
