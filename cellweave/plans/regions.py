"""Queries of segmentation and of zeros around pictures; no SQL grows regions, so tests hold them against plain versions."""

from pyspark.sql import functions as F

from cellweave.operators import regions
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


def _bands(spark, sf_dir):
    return views.bands(table(spark, sf_dir, "lineitem"))


@register()
def grown_regions(spark, sf_dir):
    return regions.grow_regions(_bands(spark, sf_dir), ["a", "b"], 64, [2.0, 5.0], least=3, follow=1.0)


@register()
def superpixels(spark, sf_dir):
    return rounded(regions.superpixels(_bands(spark, sf_dir), ["a", "b"], 8, 20.0))


_ZEROS = "SELECT x, y, CAST(floor(value / 3.0) AS INT) % 3 AS z FROM cells"


@register(
    views.sql(f"""
    WITH g AS ({_ZEROS}), box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g),
    o(x, y) AS (SELECT x, y FROM g, box WHERE z = 0 AND x IN (x0, x1) AND y IN (y0, y1) UNION SELECT g.x, g.y FROM o JOIN g ON z = 0 AND abs(g.x - o.x) + abs(g.y - o.y) = 1),
    n AS (SELECT a.x, a.y, b.z FROM (SELECT x, y FROM g WHERE z = 0 EXCEPT SELECT x, y FROM o) a, g b WHERE b.z <> 0
          QUALIFY row_number() OVER (PARTITION BY a.x, a.y ORDER BY (a.x - b.x)^2 + (a.y - b.y)^2, b.y * 64 + b.x) = 1)
    SELECT g.x, g.y, CASE WHEN g.z <> 0 THEN g.z ELSE n.z END AS z FROM g LEFT JOIN n ON g.x = n.x AND g.y = n.y
    """).replace("WITH ", "WITH RECURSIVE ", 1)
)
def zero_to_null(spark, sf_dir):
    cells = views.cells(table(spark, sf_dir, "lineitem")).select("x", "y", (F.floor(F.col("value") / 3).cast("int") % 3).alias("z"))
    return regions.zero_to_null(cells, "z", 64)
