"""Queries of edges and lines in images."""

import math

from cellweave.operators import edges
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table

_NEAR = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)"
_ANGLES = 36
_CANNY = f"""WITH RECURSIVE cells AS ({views.SQL["cells"]}),
    s AS MATERIALIZED (SELECT a.x, a.y, sum(b.value * exp(-((a.x - b.x)^2 + (a.y - b.y)^2) / 2.0)) / sum(exp(-((a.x - b.x)^2 + (a.y - b.y)^2) / 2.0)) AS v FROM cells a JOIN cells b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY ALL),
    d AS (SELECT c.x, c.y, (e.v - w.v) / 2 AS gx, (n.v - z.v) / 2 AS gy FROM s c JOIN s e ON e.x = c.x + 1 AND e.y = c.y JOIN s w ON w.x = c.x - 1 AND w.y = c.y JOIN s n ON n.x = c.x AND n.y = c.y + 1 JOIN s z ON z.x = c.x AND z.y = c.y - 1),
    g AS MATERIALIZED (SELECT x, y, round(sqrt(gx^2 + gy^2), 9) AS m, degrees(atan2(gy, gx)) AS angle FROM d),
    w AS (SELECT *, [1, 1, 0, -1][1 + way] AS i, [0, 1, 1, 1][1 + way] AS j FROM (SELECT *, CAST(floor(((round(angle, 9) + 180) % 180 + 22.5) / 45) AS INT) % 4 AS way FROM g WHERE m > 0)),
    r AS MATERIALIZED (SELECT w.x, w.y, w.m, w.angle, w.y * 64 + w.x AS id FROM w LEFT JOIN g a ON a.x = w.x + i AND a.y = w.y + j LEFT JOIN g b ON b.x = w.x - i AND b.y = w.y - j WHERE w.m > coalesce(a.m, 0) AND w.m >= coalesce(b.m, 0) AND w.m >= 0.05),
    k(x, y, root) USING KEY (x, y) AS (SELECT x, y, id FROM r UNION SELECT b.x, b.y, min(a.root) FROM k a JOIN r b ON {_NEAR} JOIN recurring.k o ON o.x = b.x AND o.y = b.y WHERE a.root < o.root GROUP BY b.x, b.y),
    c AS (SELECT r.*, root AS edge FROM r JOIN k USING (x, y) WHERE root IN (SELECT root FROM r JOIN k USING (x, y) WHERE m >= 0.15))"""


def _canny(spark, sf_dir):
    return edges.canny(views.cells(table(spark, sf_dir, "lineitem")), "value", 64, 1.0, 0.05, 0.15)


@register(_CANNY + " SELECT x, y, round(m, 4) AS magnitude, round(angle, 4) AS angle, edge FROM c")
def canny_edges(spark, sf_dir):
    return rounded(_canny(spark, sf_dir), 4)


_TURNS = ", ".join(f"({k}, {math.cos(math.pi * k / _ANGLES)!r}::DOUBLE, {math.sin(math.pi * k / _ANGLES)!r}::DOUBLE)" for k in range(_ANGLES))
_VOTES = _CANNY + f", t(angle, c, s) AS (VALUES {_TURNS}), v AS MATERIALIZED (SELECT t.angle, floor(x * t.c + y * t.s + 0.500000001::DOUBLE)::BIGINT AS rho, count(*) AS votes FROM (SELECT x, y FROM c) q CROSS JOIN t GROUP BY 1, 2)"


@register(_VOTES + " SELECT angle, rho, votes FROM v")
def hough_votes(spark, sf_dir):
    return edges.hough_votes(_canny(spark, sf_dir), _ANGLES)


@register(
    _VOTES
    + f""", o AS (SELECT a.angle, a.rho, a.votes, b.votes AS ov, b.angle AS oa, b.rho AS orho FROM v a JOIN v b ON
        (abs(a.angle - b.angle) <= 1 AND abs(a.rho - b.rho) <= 1 OR abs(a.angle - b.angle) = {_ANGLES - 1} AND abs(a.rho + b.rho) <= 1) AND (a.angle <> b.angle OR a.rho <> b.rho))
    SELECT angle, rho, votes FROM v WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.angle = v.angle AND o.rho = v.rho AND (ov, -oa, -orho) > (votes, -v.angle, -v.rho)) ORDER BY votes DESC, angle, rho LIMIT 12"""
)
def hough_lines(spark, sf_dir):
    return edges.hough_lines(_canny(spark, sf_dir), _ANGLES, 12)
