"""Queries of learners and of regression over a grid."""

from pyspark.sql import functions as F

from cellweave.operators import graph, learning
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table
from cellweave.plans.graph import _classes, _sql


@register()
def classify_pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    names = [f"b{i}" for i in range(e.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0)]
    e = e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return learning.classify(learning.train_classifier(e.where("vec_id % 4 <> 0"), "label", names, "tree"), e).select("vec_id", "label", "predicted")


@register()
def cluster_pixels(spark, sf_dir):
    b = views.bands(table(spark, sf_dir, "lineitem"))
    return learning.cluster(b, ["a", "b", "c", "d"], 4).select("x", "y", "cluster")


@register(
    views.sql("""
    WITH n AS (SELECT c.x, c.y, 1 - ((c.x - b.x)^2 + (c.y - b.y)^2) / 25.0 AS w, b.a AS u, b.b AS v FROM bands c JOIN bands b ON (c.x - b.x)^2 + (c.y - b.y)^2 <= 16),
    s AS (SELECT x, y, count(*) AS n, sum(w) AS s, sum(w * u) AS u, sum(w * v) AS v, sum(w * u * u) AS uu, sum(w * u * v) AS uv FROM n GROUP BY ALL)
    SELECT x, y, n, round((v * uu - u * uv) / (s * uu - u * u), 3) AS intercept, round((s * uv - u * v) / (s * uu - u * u), 3) AS b_a FROM s
    """)
)
def varying_regression(spark, sf_dir):
    return rounded(learning.varying_regression(views.bands(table(spark, sf_dir, "lineitem")), ["a"], "b", 4), 3)


@register(
    _sql("""
    , c AS (SELECT x, y, clump FROM classes JOIN k ON k.a = y * 64 + x WHERE clump IN (SELECT clump FROM k GROUP BY clump HAVING count(*) >= 5)),
    ar AS (SELECT clump, count(*) AS area FROM c GROUP BY 1),
    d AS (SELECT a.clump, b.clump AS other, min(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) AS d FROM c a JOIN c b ON a.clump <> b.clump AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 GROUP BY ALL HAVING min(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) <= 6),
    p AS (SELECT d.clump, sum(ar.area / d) AS proximity, min(d) AS nearest, count(*) AS neighbours FROM d JOIN ar ON d.other = ar.clump GROUP BY d.clump)
    SELECT clump, area, round(coalesce(proximity, 0), 5) AS proximity, round(nearest, 5) AS nearest, coalesce(neighbours, 0) AS neighbours FROM ar LEFT JOIN p USING (clump)
    """)
)
def proximity_index(spark, sf_dir):
    c = graph.keep_areas(graph.clumps(_classes(spark, sf_dir), "class", 64), 5)
    return rounded(graph.proximity_index(c, 6), 5)


@register(
    f"""
    WITH RECURSIVE cells AS ({views.SQL["cells"]}),
    d(x, y, d) USING KEY (x, y) AS (
        SELECT x, y, 0.0::DOUBLE FROM cells WHERE x = 3 AND y = 5
        UNION SELECT g.x, g.y, min(d.d + sqrt((g.x - d.x)^2 + (g.y - d.y)^2) * (c.value + g.value) / 2) AS found
        FROM d JOIN cells c ON c.x = d.x AND c.y = d.y JOIN cells g ON g.x BETWEEN d.x - 1 AND d.x + 1 AND g.y BETWEEN d.y - 1 AND d.y + 1 AND (g.x <> d.x OR g.y <> d.y)
        LEFT JOIN recurring.d o ON o.x = g.x AND o.y = g.y GROUP BY g.x, g.y, o.d HAVING o.d IS NULL OR found < o.d - 1e-12)
    SELECT x, y, round(d, 4) AS d FROM d
    """
)
def cost_distance(spark, sf_dir):
    c = views.cells(table(spark, sf_dir, "lineitem"))
    return rounded(graph.cost_distance(c, "value", c.where("x = 3 AND y = 5")), 4)
