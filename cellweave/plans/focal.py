"""Queries over the neighbourhoods of cells."""

from pyspark.sql import functions as F

from cellweave.operators import focal
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


def _cells(spark, sf_dir):
    return views.cells(table(spark, sf_dir, "lineitem"))


def _zones(spark, sf_dir):
    return views.zones(table(spark, sf_dir, "lineitem"))


@register(
    views.sql("""
    SELECT a.x, a.y, round(sum(b.value), 4) AS sum, count(b.value)::BIGINT AS n, round(min(b.value), 4) AS min, round(max(b.value), 4) AS max, round(avg(b.value), 4) AS mean
    FROM cells a JOIN cells b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY a.x, a.y
    """)
)
def focal_square(spark, sf_dir):
    return rounded(focal.focal(_cells(spark, sf_dir), "value", 2), 4)


@register(
    views.sql("""
    SELECT a.x, a.y, round(sum(b.value), 4) AS sum, count(b.value) AS n, round(min(b.value), 4) AS min, round(max(b.value), 4) AS max, round(avg(b.value), 4) AS mean
    FROM cells a JOIN cells b ON b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 GROUP BY a.x, a.y
    """)
)
def focal_circle(spark, sf_dir):
    return rounded(focal.focal(_cells(spark, sf_dir), "value", 3, True), 4)


_PAIRS = "SELECT a.class AS a, b.class AS b, count(*) AS borders FROM classes a JOIN classes b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.class <> b.class GROUP BY 1, 2"


@register(views.sql(_PAIRS))
def class_adjacency(spark, sf_dir):
    return focal.adjacency(views.classes(table(spark, sf_dir, "lineitem")), "class")


@register(
    views.sql("""
    WITH m AS (SELECT zone, avg(value) AS m FROM zones GROUP BY zone),
    p AS (SELECT DISTINCT a.zone AS a, b.zone AS b FROM zones a JOIN zones b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.zone <> b.zone)
    SELECT a AS zone, round(avg(m), 6) AS neighbour_mean, round(stddev_pop(m), 6) AS neighbour_stddev, count(*) AS neighbours FROM p JOIN m ON p.b = m.zone GROUP BY a
    """)
)
def zone_neighbours(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return rounded(focal.zone_neighbours(z.groupBy("zone").agg(F.avg("value").alias("m")), focal.adjacency(z, "zone"), "zone", "m"))


@register(
    views.sql("""
    WITH m AS (SELECT zone, avg(value) AS m FROM zones GROUP BY zone), g AS (SELECT avg(value) AS g FROM zones),
    p AS (SELECT DISTINCT a.zone AS a, b.zone AS b FROM zones a JOIN zones b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.zone <> b.zone),
    s AS (SELECT count(*) AS n, sum((m - g)^2) AS s FROM m, g),
    q AS (SELECT count(*) AS w, sum((i.m - g) * (j.m - g)) AS p, sum((i.m - j.m)^2) AS q FROM p JOIN m i ON a = i.zone JOIN m j ON b = j.zone, g)
    SELECT round(n / w * p / s, 6) AS moran, round((n - 1) / (2 * w) * q / s, 6) AS geary FROM s, q
    """)
)
def spatial_autocorrelation(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return rounded(focal.autocorrelation(z, "zone", "value", focal.adjacency(z, "zone")))


@register(
    views.sql("""
    WITH p AS (SELECT a.x, a.y, abs(a.value - b.value) AS d, 1 / sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS w
               FROM cells a JOIN cells b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND (a.x <> b.x OR a.y <> b.y))
    SELECT x, y, round(sum(w * d) / sum(w), 6) AS tri FROM p GROUP BY x, y
    """)
)
def terrain_ruggedness(spark, sf_dir):
    return rounded(focal.ruggedness(_cells(spark, sf_dir), "value", 1, 1.0))


@register(
    views.sql("""
    WITH t AS (
        SELECT a.x, a.y, r, a.value - avg(b.value) AS t FROM cells a CROSS JOIN (VALUES (2), (5)) s(r) JOIN cells b ON b.x BETWEEN a.x - r AND a.x + r AND b.y BETWEEN a.y - r AND a.y + r GROUP BY a.x, a.y, a.value, r
    ), z AS (SELECT x, y, r, (t - avg(t) OVER (PARTITION BY r)) / stddev_pop(t) OVER (PARTITION BY r) AS z FROM t)
    SELECT x, y, round(CASE WHEN abs(max(z) FILTER (r = 2)) > abs(max(z) FILTER (r = 5)) THEN max(z) FILTER (r = 2) ELSE max(z) FILTER (r = 5) END, 4) AS tpi FROM z GROUP BY x, y
    """)
)
def terrain_position(spark, sf_dir):
    return rounded(focal.terrain_position(_cells(spark, sf_dir), "value", [2, 5]), 4)


@register(
    views.sql("""
    WITH f AS (SELECT x, y, CASE WHEN value > 24 THEN 1 ELSE 0 END AS f FROM cells),
    d AS (SELECT a.x, a.y, a.f, avg(b.f) AS pf FROM f a JOIN f b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY ALL),
    e AS (SELECT a.x, a.y, b.x AS x2, b.y AS y2, (a.f + b.f >= 1)::INT AS one, (a.f + b.f = 2)::INT AS two FROM f a JOIN f b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)),
    p AS (SELECT c.x, c.y, sum(one) AS one, sum(two) AS two FROM f c JOIN e ON e.x >= c.x - 1 AND e.x2 <= c.x + 1 AND e.y >= c.y - 1 AND e.y2 <= c.y + 1 GROUP BY ALL),
    g AS (SELECT d.x, d.y, f, pf, coalesce(two / nullif(one, 0), 0) AS pff FROM d LEFT JOIN p USING (x, y))
    SELECT x, y, round(pf, 6) AS pf, round(pff, 6) AS pff,
           CASE WHEN f = 0 THEN 0 WHEN pf < 0.4 THEN 1 WHEN pf < 0.6 THEN 2 WHEN pf = 1 THEN 5 WHEN round(pf - pff, 9) < 0 THEN 3 WHEN pf > 0.6 AND round(pf - pff, 9) > 0 THEN 4 WHEN pf > 0.6 THEN 6 ELSE 0 END AS class
    FROM g
    """)
)
def forest_fragmentation(spark, sf_dir):
    forest = _cells(spark, sf_dir).select("x", "y", (F.col("value") > 24).alias("forest"))
    return rounded(focal.forest_fragmentation(forest, "forest", 3))
