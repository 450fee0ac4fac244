"""Queries over elevation grids."""

from cellweave.operators import terrain
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table

_SLOPE = """
    s AS (
        SELECT c.x, c.y, count(*) AS n,
               sum(b.value * CASE WHEN b.x = c.x THEN 0 ELSE (b.x - c.x) * (2 - abs(b.y - c.y)) END) / 8 AS east,
               sum(b.value * CASE WHEN b.y = c.y THEN 0 ELSE (c.y - b.y) * (2 - abs(b.x - c.x)) END) / 8 AS north
        FROM cells c JOIN cells b ON abs(b.x - c.x) <= 1 AND abs(b.y - c.y) <= 1 GROUP BY c.x, c.y
    ), a AS (
        SELECT x, y, east, north, degrees(atan(sqrt(east * east + north * north))) AS slope,
               CASE WHEN east = 0 AND north = 0 THEN NULL WHEN degrees(atan2(-east, -north)) < 0 THEN degrees(atan2(-east, -north)) + 360 ELSE degrees(atan2(-east, -north)) END AS aspect
        FROM s WHERE n = 9
    )"""


def _cells(spark, sf_dir):
    return views.cells(table(spark, sf_dir, "lineitem"))


@register(views.sql("WITH " + _SLOPE.strip() + " SELECT x, y, round(east, 4) AS east, round(north, 4) AS north, round(slope, 4) AS slope, round(aspect, 4) AS aspect FROM a"))
def slope_aspect(spark, sf_dir):
    return rounded(terrain.slope_aspect(_cells(spark, sf_dir), "value"), 4)


@register(views.sql("WITH " + _SLOPE.strip() + " SELECT x, y, round(coalesce(cos(radians(aspect)), 0), 4) AS northness, round(coalesce(sin(radians(aspect)), 0), 4) AS eastness, round(coalesce(cos(radians(aspect)) * sin(radians(slope)), 0), 4) AS northness_slope FROM a"))
def northness(spark, sf_dir):
    return rounded(terrain.northness(terrain.slope_aspect(_cells(spark, sf_dir), "value")), 4)


@register(
    views.sql(
        "WITH " + _SLOPE.strip() + """,
    u AS (SELECT x, y, sin(radians(slope)) * sin(radians(coalesce(aspect, 0))) AS u, sin(radians(slope)) * cos(radians(coalesce(aspect, 0))) AS v, cos(radians(slope)) AS w FROM a)
    SELECT c.x, c.y, round(1 - sqrt(sum(b.u)^2 + sum(b.v)^2 + sum(b.w)^2) / count(*), 5) AS vrm FROM u c JOIN u b ON abs(b.x - c.x) <= 1 AND abs(b.y - c.y) <= 1 GROUP BY c.x, c.y"""
    )
)
def vector_ruggedness(spark, sf_dir):
    return rounded(terrain.vector_ruggedness(terrain.slope_aspect(_cells(spark, sf_dir), "value"), 1), 5)


@register(views.sql("SELECT c.x, c.y, round(avg(b.value), 4) AS trend, round(c.value - avg(b.value), 4) AS relief FROM cells c JOIN cells b ON abs(b.x - c.x) <= 4 AND abs(b.y - c.y) <= 4 GROUP BY c.x, c.y, c.value"))
def local_relief(spark, sf_dir):
    return rounded(terrain.local_relief(_cells(spark, sf_dir), "value", 4), 4)


@register(views.sql("SELECT c.x, c.y, round(100 * avg((b.value < c.value)::INT), 4) AS prominence FROM cells c JOIN cells b ON (b.x - c.x)^2 + (b.y - c.y)^2 BETWEEN 1 AND 9 GROUP BY c.x, c.y"))
def prominence(spark, sf_dir):
    return rounded(terrain.prominence(_cells(spark, sf_dir), "value", 3), 4)


@register(views.sql("SELECT c.x, c.y, round(corr(b.a, b.b), 4) AS corr FROM bands c JOIN bands b ON abs(b.x - c.x) <= 1 AND abs(b.y - c.y) <= 1 GROUP BY c.x, c.y"))
def moving_correlation(spark, sf_dir):
    return rounded(terrain.moving_correlation(views.bands(table(spark, sf_dir, "lineitem")), "a", "b", 1), 4)


@register(
    views.sql("""
    SELECT f AS factor, count(*) AS blocks, round(var_pop(m), 5) AS variance FROM (SELECT f, avg(value) AS m FROM cells, (VALUES (1), (2), (4), (8)) t(f) GROUP BY f, x // f, y // f) GROUP BY f
    """)
)
def resolution_variance(spark, sf_dir):
    return rounded(terrain.resolution_variance(_cells(spark, sf_dir), "value", [1, 2, 4, 8]), 5)


@register(
    views.sql("""
    WITH b AS (SELECT floor(value / 2.5) * 2.5 AS elevation, count(*) AS n FROM cells GROUP BY 1)
    SELECT elevation, n, round(sum(n) OVER (ORDER BY elevation DESC) / sum(n) OVER (), 6) AS share_above FROM b
    """)
)
def hypsometry(spark, sf_dir):
    return rounded(terrain.hypsometry(_cells(spark, sf_dir), "value", 2.5))
