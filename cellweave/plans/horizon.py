"""Queries of visibility."""

import math

from pyspark.sql import functions as F

from cellweave.operators import horizon
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table

_OBSERVERS = "SELECT n_nationkey AS o, (n_nationkey * 11 + 5) % 64 AS x, (n_nationkey * 17 + 9) % 64 AS y FROM nation"


def _cells(spark, sf_dir):
    return views.cells(table(spark, sf_dir, "lineitem"))


def _observers(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("o"), ((k * 11 + 5) % 64).alias("x"), ((k * 17 + 9) % 64).alias("y"))


def _rise(reach):
    ways = [w for i, j in horizon.rays(reach) for w in ((i, j), (-i, -j))]
    return f"""
    w(dx, dy) AS (VALUES {", ".join(map(str, ways))}),
    k AS MATERIALIZED (SELECT x, y, value FROM cells),
    o AS MATERIALIZED (SELECT x, y, value, dx, dy, j, x + j * dx AS bx, y + j * dy AS by FROM k CROSS JOIN w CROSS JOIN range(1, 64) r(j) WHERE x + j * dx BETWEEN 0 AND 63 AND y + j * dy BETWEEN 0 AND 63),
    h AS (SELECT o.x, o.y, dx, dy, max((b.value - o.value) / (j * sqrt(dx * dx + dy * dy))) AS rise FROM o JOIN k b ON b.x = o.bx AND b.y = o.by GROUP BY ALL),
    g AS (SELECT x, y, dx, dy, rise FROM k CROSS JOIN w LEFT JOIN h USING (x, y, dx, dy))"""


@register(views.sql("WITH " + _rise(1) + " SELECT x, y, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, round(rise, 6) AS rise FROM g"))
def horizons(spark, sf_dir):
    return rounded(horizon.horizons(_cells(spark, sf_dir), "value", horizon.rays(1)))


@register(views.sql("WITH " + _rise(2) + ", s AS (SELECT x, y, coalesce(rise, 0) / sqrt(1 + coalesce(rise, 0)^2) AS s FROM g) SELECT x, y, round(1 - avg(greatest(s, 0)), 6) AS sky, round(1 - avg(s), 6) AS openness FROM s GROUP BY x, y"))
def sky_view(spark, sf_dir):
    return rounded(horizon.sky_view(_cells(spark, sf_dir), "value", horizon.rays(2)))


#: Every cell within 12 of an observer, held against all nearer ones: no sectors, no running maximum.
_SEEN = f"""
    o AS ({_OBSERVERS}),
    m AS (SELECT o.o, o.x AS ox, o.y AS oy, c.x, c.y, (c.x - o.x)::DOUBLE AS dx, (c.y - o.y)::DOUBLE AS dy, (c.x - o.x)^2 + (c.y - o.y)^2 AS d2, c.value - h.value - 2 AS z, c.value AS ground
          FROM o JOIN cells h ON h.x = o.x AND h.y = o.y JOIN cells c ON (c.x - o.x)^2 + (c.y - o.y)^2 <= 144),
    e AS (SELECT *, z / sqrt(nullif(d2, 0)) AS rise FROM m),
    v AS (SELECT t.o, t.ox, t.oy, t.x, t.y, sqrt(t.d2) AS distance, t.rise, t.ground FROM e t WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT e.*, list_transform([[-0.5, -0.5], [-0.5, 0.5], [0.5, -0.5], [0.5, 0.5]], lambda k: [dx + k[1], dy + k[2]]) AS corners FROM e WHERE d2 > 0) b
        WHERE b.o = t.o AND b.d2 < t.d2 AND b.rise >= t.rise AND b.dx * t.dx + b.dy * t.dy > 0
          AND list_min(list_transform(corners, lambda k: atan2(t.dx * k[2] - t.dy * k[1], t.dx * k[1] + t.dy * k[2]))) < -1e-9
          AND list_max(list_transform(corners, lambda k: atan2(t.dx * k[2] - t.dy * k[1], t.dx * k[1] + t.dy * k[2]))) > 1e-9))"""


def _views(spark, sf_dir):
    return horizon.viewsheds(_observers(spark, sf_dir), "o", _cells(spark, sf_dir), "value", 2.0, 12)


@register(views.sql("WITH " + _SEEN + " SELECT o, x, y, round(distance, 6) AS distance, round(rise, 6) AS rise FROM v"))
def viewsheds(spark, sf_dir):
    return rounded(_views(spark, sf_dir))


@register(views.sql("WITH " + _SEEN + " SELECT x, y, count(*) AS observers, round(min(distance), 6) AS nearest FROM v GROUP BY x, y"))
def visibility(spark, sf_dir):
    return rounded(horizon.visibility(_views(spark, sf_dir), "o"))


@register(views.sql("WITH " + _SEEN + " SELECT x, y, round(sum((1 + o % 3) * CASE WHEN distance <= 4 THEN 1 ELSE (4 / distance)^2 END), 6) AS exposure FROM v GROUP BY x, y"))
def visual_exposure(spark, sf_dir):
    weights = _observers(spark, sf_dir).select("o", (1 + F.col("o") % 3).alias("w"))
    return rounded(horizon.exposure(_views(spark, sf_dir), "o", weights, "w", 4.0))


@register(
    views.sql(
        "WITH "
        + _SEEN
        + f""", s AS (SELECT *, CAST(least(floor(((atan2(y - oy, x - ox) + 1e-9 + {2 * math.pi}) % {2 * math.pi}) / ({2 * math.pi} / 16)), 15) AS INT) AS sector FROM v WHERE distance > 0)
    SELECT o, sector, arg_max(x, (rise, -distance, x, y)) AS x, arg_max(y, (rise, -distance, x, y)) AS y, round(max(rise), 6) AS rise, round(arg_max(distance, (rise, -distance, x, y)), 6) AS distance, round(max(distance), 6) AS farthest FROM s GROUP BY o, sector"""
    )
)
def skylines(spark, sf_dir):
    return rounded(horizon.skyline(_views(spark, sf_dir), "o", 16, _observers(spark, sf_dir)))


@register(
    views.sql(
        "WITH "
        + _SEEN
        + """, n AS (SELECT c.x, c.y, c.value AS z, coalesce((e.value - w.value) / 2, e.value - c.value, c.value - w.value, 0) AS gx, coalesce((n.value - s.value) / 2, n.value - c.value, c.value - s.value, 0) AS gy
          FROM cells c LEFT JOIN cells e ON e.x = c.x + 1 AND e.y = c.y LEFT JOIN cells w ON w.x = c.x - 1 AND w.y = c.y LEFT JOIN cells n ON n.x = c.x AND n.y = c.y + 1 LEFT JOIN cells s ON s.x = c.x AND s.y = c.y - 1),
    a AS (SELECT v.x, v.y, gx, gy, (ox - v.x)::DOUBLE AS vx, (oy - v.y)::DOUBLE AS vy, h.value + 2 - n.z AS vz FROM v JOIN n ON n.x = v.x AND n.y = v.y JOIN cells h ON h.x = ox AND h.y = oy WHERE distance > 0)
    SELECT x, y, count(*) AS observers, round(min(degrees(acos((vz - gx * vx - gy * vy) / (sqrt(vx^2 + vy^2 + vz^2) * sqrt(1 + gx^2 + gy^2))))), 4) AS angle, round(min(sqrt(vx^2 + vy^2 + vz^2)), 4) AS distance FROM a GROUP BY x, y"""
    )
)
def survey(spark, sf_dir):
    return rounded(horizon.survey(_views(spark, sf_dir), "o", _observers(spark, sf_dir), _cells(spark, sf_dir), "value", 2.0), 4)
