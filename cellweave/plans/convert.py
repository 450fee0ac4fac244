"""Queries of conversions and selections."""

from pyspark.sql import functions as F

from cellweave.operators import convert, focal, vector
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table
from cellweave.plans.vector import _SEGMENTS, _lines


def _cells(spark, sf_dir):
    return views.cells(table(spark, sf_dir, "lineitem"))


@register(views.sql("SELECT y, count(*)::INT AS vertices, round(sum(value), 4) AS total, min(x)::DOUBLE AS first FROM cells WHERE value > 22 GROUP BY y HAVING count(*) > 1"))
def rows_to_lines(spark, sf_dir):
    lines = convert.rows_to_lines(_cells(spark, sf_dir).where("value > 22"), "value")
    total = F.aggregate("vertices", F.lit(0.0), lambda a, v: a + v["z"])
    return rounded(lines.select("y", F.size("vertices").alias("vertices"), total.alias("total"), F.col("vertices")[0]["x"].alias("first")), 4)


@register(views.sql("SELECT event_id, round(2 * x - 0.5 * y + 3.0, 6) AS x, round(0.25 * x + y - 1.0, 6) AS y FROM points"))
def affine_points(spark, sf_dir):
    x, y = convert.affine(F.col("x"), F.col("y"), (2, -0.5, 3.0, 0.25, 1, -1.0))
    return rounded(views.points(table(spark, sf_dir, "events")).select("event_id", x.alias("x"), y.alias("y")))


@register(
    views.sql("""
    SELECT floor(cos(radians(30)) * (x - 32) - sin(radians(30)) * (y - 32) + 32.5)::BIGINT AS x, floor(sin(radians(30)) * (x - 32) + cos(radians(30)) * (y - 32) + 32.5)::BIGINT AS y, round(avg(value), 5) AS value
    FROM cells GROUP BY 1, 2
    """)
)
def rotate_grid(spark, sf_dir):
    return convert.rotate(_cells(spark, sf_dir), "value", 30, 32, 32).withColumn("value", F.round(F.col("value") + 1e-9, 5))


@register(
    f"""
    WITH {_SEGMENTS.strip()}
    SELECT id, part, round((x1 + x2) / 2 + 5 * (y2 - y1) / length, 5) AS x1, round((y1 + y2) / 2 - 5 * (x2 - x1) / length, 5) AS y1, round((x1 + x2) / 2 - 5 * (y2 - y1) / length, 5) AS x2, round((y1 + y2) / 2 + 5 * (x2 - x1) / length, 5) AS y2
    FROM h WHERE length > 0
    """
)
def transects(spark, sf_dir):
    return rounded(convert.transects(vector.segments(_lines(spark, sf_dir), "id", "v"), "id", 5), 5)


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount IN (0, 0.05) THEN -1 ELSE l_discount END AS l_discount FROM lineitem")
def null_values(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return convert.null_values(l, ["l_discount"], (0.0, 0.05), -1.0)


@register(views.sql("SELECT x, y, value FROM cells WHERE ('0x' || substr(md5('3:' || x || ':' || y), 1, 12))::BIGINT / 16.0::DOUBLE^12 < value / (SELECT max(value) FROM cells)"))
def weighted_selection(spark, sf_dir):
    return convert.weighted_selection(_cells(spark, sf_dir), "value", 3)


@register(
    views.sql("""
    WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 64)::BIGINT AS x, (s_nationkey * 5 % 64)::BIGINT AS y FROM supplier),
    d AS (SELECT p.id, c.x, c.y, (p.x - c.x)^2 + (p.y - c.y)^2 AS d FROM p JOIN cells c ON value >= 28 AND (p.x - c.x)^2 + (p.y - c.y)^2 <= 16),
    b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, x, y) = 1)
    SELECT p.id, coalesce(b.x, p.x) AS x, coalesce(b.y, p.y) AS y, round(sqrt(d), 6) AS moved FROM p LEFT JOIN b ON p.id = b.id
    """)
)
def snap_points(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 64).cast("long").alias("x"), (F.col("s_nationkey") * 5 % 64).cast("long").alias("y"))
    return rounded(convert.snap(p, _cells(spark, sf_dir), "id", "value", 28, 4))


@register(
    """
    WITH g AS (SELECT l_partkey % 16 AS x, l_suppkey % 16 AS y, l_linenumber AS z, round(avg(l_quantity), 5) AS v FROM lineitem GROUP BY ALL),
    p AS (SELECT event_id, (user_id % 20)::DOUBLE + 0.5 AS x, (event_id % 16)::DOUBLE + 0.25 AS y, (event_id % 8)::DOUBLE AS z FROM events)
    SELECT event_id, v FROM p LEFT JOIN g ON floor(p.x) = g.x AND floor(p.y) = g.y AND floor(p.z) = g.z
    """
)
def voxel_lookup(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("x"), (F.col("l_suppkey") % 16).alias("y"), F.col("l_linenumber").alias("z")).agg(F.round(F.avg("l_quantity") + 1e-9, 5).alias("v"))
    p = table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 20) + 0.5).cast("double").alias("x"), ((F.col("event_id") % 16) + 0.25).cast("double").alias("y"), (F.col("event_id") % 8).cast("double").alias("z"))
    return convert.voxels(p, g, "v").select("event_id", "v")


@register()
def neighbour_colours(spark, sf_dir):
    return convert.colour(focal.adjacency(views.zones(table(spark, sf_dir, "lineitem")), "zone").select("a", "b"))


@register(
    views.sql("""
    WITH a AS (SELECT *, (value > avg(value) OVER ())::INT AS c1 FROM cells), b AS (SELECT *, 2 * c1 + (value > avg(value) OVER (PARTITION BY c1))::INT AS c2 FROM a)
    SELECT x, y, c2::INT AS class FROM b
    """)
)
def nested_means(spark, sf_dir):
    return convert.nested_means(_cells(spark, sf_dir), "value", 2).select("x", "y", F.col("class").cast("int").alias("class"))
