"""Queries of dominance-based rough sets."""

from pyspark.sql import functions as F

from cellweave.operators import rough
from cellweave.plans.catalog import register, rounded, table

#: Grades of quantity and discount (more is better) and of tax (less is better); the class is the line's number of the order.
_CRITERIA = {"quantity": True, "discount": True, "tax": False}
_BOUNDS = """
    WITH cells AS (
        SELECT CAST(floor(l_quantity / 10) AS INT) AS quantity, CAST(floor(l_discount * 100 + 0.5) AS INT) AS discount,
               CAST(floor(l_tax * 100 + 0.5) AS INT) AS tax, l_linenumber AS line, count(*) AS n
        FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL),
    up AS (SELECT a.quantity, a.discount, a.tax, min(b.line) AS low FROM (SELECT DISTINCT quantity, discount, tax FROM cells) a JOIN cells b
           ON b.quantity >= a.quantity AND b.discount >= a.discount AND b.tax <= a.tax GROUP BY ALL),
    down AS (SELECT a.quantity, a.discount, a.tax, max(b.line) AS high FROM (SELECT DISTINCT quantity, discount, tax FROM cells) a JOIN cells b
           ON b.quantity <= a.quantity AND b.discount <= a.discount AND b.tax >= a.tax GROUP BY ALL),
    bounds AS (SELECT quantity, discount, tax, line, n, low, high FROM cells JOIN up USING (quantity, discount, tax) JOIN down USING (quantity, discount, tax))
"""


def _bounds(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    graded = line.select(
        F.floor(F.col("l_quantity") / 10).cast("int").alias("quantity"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("discount"),
        F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("tax"),
        F.col("l_linenumber").alias("line"),
    )
    return rough.class_bounds(graded, _CRITERIA, "line")


@register(f"{_BOUNDS} SELECT * FROM bounds")
def class_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir)


@register(
    _BOUNDS
    + """, unions AS (
        SELECT class, 'at_least' AS side, sum(n) FILTER (line >= class) AS size, sum(n) FILTER (low >= class) AS lower, sum(n) FILTER (high >= class) AS upper
        FROM bounds, (SELECT DISTINCT line AS class FROM bounds) GROUP BY 1
        UNION ALL SELECT class, 'at_most', sum(n) FILTER (line <= class), sum(n) FILTER (high <= class), sum(n) FILTER (low <= class)
        FROM bounds, (SELECT DISTINCT line AS class FROM bounds) GROUP BY 1)
    SELECT class, side, CAST(size AS BIGINT) AS size, CAST(coalesce(lower, 0) AS BIGINT) AS lower, CAST(upper AS BIGINT) AS upper,
           CAST(upper - coalesce(lower, 0) AS BIGINT) AS boundary, round(coalesce(lower, 0) / upper, 6) AS accuracy FROM unions
    """
)
def class_approximations(spark, sf_dir):
    return rounded(rough.approximations(_bounds(spark, sf_dir), "line"))
