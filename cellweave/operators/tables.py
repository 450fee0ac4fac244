"""Attribute tables: lookup, renaming, filtering, recoding, ordering, sampling and set operations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.ordered import ranked

def lookup_join(left: DataFrame, right: DataFrame, on: str, right_on: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Adds ``columns`` of ``right``; rows without a match get nulls, of several matches the first by ``order`` (or by all columns) counts."""
    first = F.min_by(F.struct(*columns), F.col(order) if order else F.struct(*columns))
    once = right.groupBy(F.col(right_on).alias(on)).agg(first.alias("_found"))
    keep = [c for c in left.columns if c == on or c not in columns]
    return left.join(once, on, "left").select(*keep, *[F.col(f"_found.{c}").alias(c) for c in columns])


def rename_many(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames the columns that exist; two columns of one name are an error."""
    new = [names.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError("two columns would have the same name")
    return df.toDF(*new)


def in_categories(value: Column, spec: str) -> Column:
    """Whether an integer is in a list of numbers and inclusive ranges such as ``1,3,7-9``."""
    tests = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(-?\d+)\s*(?:-\s*(-?\d+))?\s*", part)
        if not m:
            raise ValueError(f"not a category or a range: {part!r}")
        low, high = int(m[1]), int(m[2] or m[1])
        tests.append(value.between(low, high))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def recode(value: Column, rules: Sequence[tuple[float, float, float]], default: float | None = None) -> Column:
    """The third number of the first rule whose inclusive range holds the value."""
    out = F.lit(default)
    for low, high, new in reversed(rules):
        out = F.when(value.between(low, high), F.lit(new)).otherwise(out)
    return out


def sort_points(df: DataFrame, column: str, key: str, ascending: bool = False) -> DataFrame:
    """All rows with their ``place`` by a numeric column, highest first unless ``ascending``; nulls last, ties by ``key``. Rows are ranked in ranges, not in one task."""
    if df.schema[column].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not df.schema[column].dataType.simpleString().startswith("decimal"):
        raise ValueError(f"{column} is not numeric")
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return ranked(df, [order, F.col(key)], "place")


def stratified_sample(df: DataFrame, category: str, n: Mapping[object, int] | int, key: str, seed: int = 0) -> DataFrame:
    """Up to ``n`` rows of each category, chosen by a hash of ``key``.

    Per category the rows that can't be chosen go before the exchange: only the ``n`` first of each task travel.
    """
    place = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"), *df.columns)
    most = max(n.values()) if isinstance(n, Mapping) else n
    want = F.create_map(*[F.lit(x) for kv in n.items() for x in kv])[F.col(category)] if isinstance(n, Mapping) else F.lit(n)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(category).orderBy(place)))
    return ranked.where((F.col("_rank") <= most) & (F.col("_rank") <= want)).drop("_rank")


def overlay(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Set algebra of two tables of equal columns: ``and``, ``or``, ``xor`` or ``not``; rows come out once."""
    if how == "and":
        return left.intersect(right)
    if how == "or":
        return left.unionByName(right).distinct()
    if how == "not":
        return left.subtract(right)
    if how == "xor":
        return left.subtract(right).unionByName(right.subtract(left))
    raise ValueError(how)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side`` and ``n``; none if the tables are equal."""
    columns = left.columns
    counted = left.withColumn("_n", F.lit(1)).unionByName(right.select(*columns).withColumn("_n", F.lit(-1))).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return counted.where("_n <> 0").select(*columns, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("n"))


def clean_names(names: Sequence[str | None], prefix: str = "v_") -> list[str]:
    """Column names that SQL accepts: blanks become ``column``, odd characters ``_``; repeats get a number."""
    out: list[str] = []
    for name in names:
        new = re.sub(r"\W", "_", (name or "").strip(), flags=re.ASCII) or "column"
        if not re.match(r"[A-Za-z]", new):
            new = prefix + new
        if new.lower() in ("and", "or", "not"):
            new += "_"
        base, k = new, 1
        while new in out:
            new, k = f"{base}_{k}", k + 1
        out.append(new)
    return out


def clean_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank runs in text cells become one space, ends are trimmed; rows with only empty cells go."""
    neat = df.withColumns({c: F.trim(F.regexp_replace(c, r"\s+", " ")) for c in columns})
    empty = F.lit(True)
    for c in columns:
        empty = empty & (F.coalesce(F.col(c), F.lit("")) == "")
    return neat.where(~empty)


#: Methods of the statistics matrix.
METHODS = {
    "sum": F.sum,
    "average": F.avg,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "minimum": F.min,
    "maximum": F.max,
    "range": lambda c: F.max(c) - F.min(c),
    "stddev": F.stddev_pop,
    "variance": F.var_pop,
    "diversity": F.countDistinct,
}


def statistics_matrix(points: DataFrame, area: str, columns: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """Statistics of each column by each method for the points of each area, named ``<column>_<method>``, and a count."""
    out = points.groupBy(area).agg(F.count(F.lit(1)).alias("count"), *[METHODS[m](c).alias(f"{c}_{m}") for c in columns for m in methods if m != "mode"])
    if "mode" in methods:
        for c in columns:
            out = out.join(mode(points, [area], c).select(area, F.col("mode").alias(f"{c}_mode")), area)
    return out


def mode(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent value for each key, ties to the smallest: two aggregations, no sort of a group."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("mode"), F.max("n").alias("occurrences"))


def update_where(df: DataFrame, column: str, condition: str, expression: str) -> DataFrame:
    """Sets a column by an SQL expression in the rows that meet a condition."""
    return df.withColumn(column, F.when(F.expr(condition), F.expr(expression)).otherwise(F.col(column) if column in df.columns else F.lit(None)))


def weights_by_area(df: DataFrame, area: str, value: str, weight: str) -> Column:
    """An area's value shared among its rows by weight; 0 where the weights are all 0, null where there is no value."""
    total = F.sum(weight).over(Window.partitionBy(area))
    return F.when(F.col(value).isNull(), None).when(total == 0, 0.0).otherwise(F.col(value) * F.col(weight) / total)
