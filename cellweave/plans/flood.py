"""Queries of water over a grid."""

from pyspark.sql import functions as F

from cellweave.operators import flood
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table

_NEAR = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)"
_FLOOD = """
    d(x, y, level) USING KEY (x, y) AS (
        {start}
        UNION SELECT b.x, b.y, min(greatest(a.level, b.value)) AS found
        FROM d a JOIN cells b ON {near} LEFT JOIN recurring.d o ON o.x = b.x AND o.y = b.y GROUP BY b.x, b.y, o.level HAVING o.level IS NULL OR found < o.level)"""


def _cells(spark, sf_dir):
    return views.cells(table(spark, sf_dir, "lineitem"))


def _flood(start, *views_first):
    return f"WITH RECURSIVE cells AS ({views.SQL['cells']}), " + "".join(f"{v}, " for v in views_first) + _FLOOD.format(start=start, near=_NEAR)


_BORDER = f"n AS (SELECT a.x, a.y, count(*) AS n FROM cells a JOIN cells b ON {_NEAR} GROUP BY ALL)"
_FILLED = _flood("SELECT x, y, value FROM cells LEFT JOIN n USING (x, y) WHERE coalesce(n, 0) < 8", _BORDER) + f""",
    s AS (SELECT x, y, y * 64 + x AS id FROM d JOIN cells USING (x, y) WHERE level > value),
    r(x, y, root) USING KEY (x, y) AS (
        SELECT x, y, id FROM s
        UNION SELECT b.x, b.y, min(a.root) AS found FROM r a JOIN s b ON {_NEAR} JOIN recurring.r o ON o.x = b.x AND o.y = b.y WHERE a.root < o.root GROUP BY b.x, b.y)"""


@register(_FILLED + " SELECT x, y, value AS z, level AS filled, round(level - value, 6) AS depth, root AS depression FROM d JOIN cells USING (x, y) LEFT JOIN r USING (x, y)")
def filled_depressions(spark, sf_dir):
    return rounded(flood.fill_depressions(_cells(spark, sf_dir), "value", 64))


@register(
    _FILLED
    + """, k AS (SELECT root FROM r GROUP BY root HAVING count(*) <= 4)
    SELECT x, y, value AS z, CASE WHEN k.root IS NOT NULL THEN level ELSE value END AS filled, round(CASE WHEN k.root IS NOT NULL THEN level - value ELSE 0 END, 6) AS depth, r.root AS depression
    FROM d JOIN cells USING (x, y) LEFT JOIN r USING (x, y) LEFT JOIN k ON k.root = r.root"""
)
def small_depressions(spark, sf_dir):
    return rounded(flood.fill_depressions(_cells(spark, sf_dir), "value", 64, most_cells=4))


@register(
    _flood("SELECT x, y, value FROM cells WHERE x = 3 AND y = 5")
    + " SELECT x, y, w AS level, round(w - value, 6) AS depth FROM d JOIN cells USING (x, y) JOIN (VALUES (24.0::DOUBLE), (26.0), (28.0), (40.0)) v(w) ON d.level < w"
)
def lake_levels(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(flood.lake_series(c, "value", 64, c.where("x = 3 AND y = 5"), [24.0, 26.0, 28.0, 40.0]))


@register(
    views.sql("""
    SELECT x // 4 AS x, y // 4 AS y, round(coalesce(avg(value) FILTER (value < 15), avg(value)), 6) AS z, bool_or(value < 15) AS stream FROM cells GROUP BY 1, 2
    """)
)
def coarse_channels(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(flood.coarse_channels(c, "value", c.where("value < 15"), 4))


_POINTERS = f"""
    WITH RECURSIVE cells AS ({views.SQL["cells"]}),
    p AS (SELECT a.y * 64 + a.x AS id, a.value AS z, arg_min(b.y * 64 + b.x, (b.value, b.y * 64 + b.x)) AS n, min((b.value, b.y * 64 + b.x)) AS low FROM cells a JOIN cells b ON {_NEAR} GROUP BY ALL),
    f AS (SELECT c.y * 64 + c.x AS id, c.value AS z, CASE WHEN low < (c.value, c.y * 64 + c.x) THEN n END AS dest FROM cells c LEFT JOIN p ON p.id = c.y * 64 + c.x)"""


@register(
    _POINTERS
    + """, w(id, pos, steps) AS (SELECT id, id, 0 FROM f UNION ALL SELECT w.id, f.dest, steps + 1 FROM w JOIN f ON f.id = w.pos WHERE f.dest IS NOT NULL AND NOT f.z < 20),
    e AS (SELECT id, arg_max(pos, steps) AS pos, max(steps)::BIGINT AS steps FROM w GROUP BY id)
    SELECT e.id, CASE WHEN f.z < 20 THEN pos END AS basin, steps FROM e JOIN f ON f.id = pos"""
)
def stream_basins(spark, sf_dir):
    f = flood.flow_pointers(_cells(spark, sf_dir), "value", 64)
    return flood.stream_basins(f, "id", "to", f.where("z < 20").select("id", F.col("id").alias("outlet")))


@register(
    _POINTERS
    + """, w(id, pos, l, steps) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM f UNION ALL
        SELECT w.id, f.dest, l + sqrt((f.id % 64 - f.dest % 64)^2 + (f.id // 64 - f.dest // 64)^2), steps + 1 FROM w JOIN f ON f.id = w.pos WHERE f.dest IS NOT NULL AND NOT f.z < 18),
    e AS (SELECT id, arg_max(pos, steps) AS pos, max(l) AS l FROM w GROUP BY id)
    SELECT e.id, CASE WHEN f.z < 18 THEN pos END AS stream, round(CASE WHEN f.z < 18 THEN l END, 6) AS distance, round(CASE WHEN f.z < 18 THEN g.z - f.z END, 6) AS difference
    FROM e JOIN f ON f.id = pos JOIN f g ON g.id = e.id"""
)
def stream_distances(spark, sf_dir):
    f = flood.flow_pointers(_cells(spark, sf_dir), "value", 64)
    return rounded(flood.stream_distances(f, "id", "to", "length", "z", f.where("z < 18")))
