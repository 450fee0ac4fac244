"""Queries over graphs, patches, streams and points."""

from pyspark.sql import functions as F

from cellweave.operators import graph
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table

_CLUMPS = """
    WITH RECURSIVE e AS (SELECT a.y * 64 + a.x AS a, b.y * 64 + b.x AS b FROM classes a JOIN classes b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.class = b.class),
    r(a, b) AS (SELECT y * 64 + x, y * 64 + x FROM classes UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT a, min(b) AS clump FROM r GROUP BY a)"""


def _classes(spark, sf_dir):
    """Coarse classes, whose clumps stay small enough for a recursive check."""
    c = views.cells(table(spark, sf_dir, "lineitem"))
    return c.select("x", "y", F.floor(F.col("value") / 3).cast("int").alias("class"))


def _sql(body):
    base = views.SQL | {"classes": "SELECT x, y, CAST(floor(value / 3.0) AS INT) AS class FROM cells"}
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in base.items()) + ", " + _CLUMPS.strip().removeprefix("WITH RECURSIVE ") + body


@register(_sql(" SELECT x, y, class, clump FROM classes JOIN k ON k.a = y * 64 + x"))
def clumps(spark, sf_dir):
    return graph.clumps(_classes(spark, sf_dir), "class", 64)


@register(
    _sql("""
    , c AS (SELECT x, y, class, clump FROM classes JOIN k ON k.a = y * 64 + x),
    s AS (SELECT a.x, a.y, count(*) AS same FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.clump = b.clump GROUP BY ALL),
    p AS (SELECT clump, class, count(*) AS area, sum(4 - coalesce(same, 0))::BIGINT AS perimeter, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS mx, avg(y) AS my FROM c LEFT JOIN s USING (x, y) GROUP BY ALL)
    SELECT clump, class, area, perimeter, round(perimeter / (4 * sqrt(area)), 6) AS shape, round(perimeter / (2 * (w + h)), 6) AS border, round(w * h / area, 6) AS compactness,
           round(CASE WHEN area > 1 THEN 2 * ln(perimeter / 4) / ln(area) END, 6) AS fractal, round(mx, 6) AS mx, round(my, 6) AS my FROM p
    """)
)
def patch_indices(spark, sf_dir):
    return rounded(graph.patch_indices(graph.clumps(_classes(spark, sf_dir), "class", 64), "class"))


@register(_sql(" SELECT x, y, class, clump FROM classes JOIN k ON k.a = y * 64 + x WHERE clump IN (SELECT clump FROM k GROUP BY clump HAVING count(*) BETWEEN 5 AND 200)"))
def clump_areas(spark, sf_dir):
    return graph.keep_areas(graph.clumps(_classes(spark, sf_dir), "class", 64), 5, 200)


_POINTS = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@register(
    f"""
    WITH p AS ({_POINTS}), d AS (SELECT a.vec_id, b.vec_id AS nearest, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id)
    SELECT vec_id, nearest, round(distance, 9) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d.distance, nearest) = 1
    """
)
def nearest_neighbours(spark, sf_dir):
    return rounded(graph.nearest_neighbours(_points(spark, sf_dir), "vec_id"), 9)


@register(
    f"""
    WITH p AS ({_POINTS}), d AS (SELECT a.vec_id, min(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY 1), n AS (SELECT count(*) AS n, avg(d) AS o FROM d),
    e AS (SELECT n, o, 0.5 / sqrt(n / 1.0) AS e, sqrt((4 - pi()) / (4 * pi() * n * n)) AS s FROM n)
    SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round(o / e, 6) AS ratio, round((o - e) / s, 4) AS score FROM e
    """
)
def clark_evans(spark, sf_dir):
    return rounded(graph.clark_evans(_points(spark, sf_dir), "vec_id", 1.0).withColumn("score", F.round(F.col("score") + 1e-9, 4)))


def _tree(spark, sf_dir):
    """A binary network: parts flow into the part of half their number."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("to"), F.col("p_size").alias("size"))


_DOWN = """
    WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 AND p_partkey // 2 IN (SELECT p_partkey FROM part) THEN p_partkey // 2 END AS up, p_size FROM part),
    d(id, pos) AS (SELECT id, id FROM t UNION ALL SELECT d.id, t.up FROM d JOIN t ON d.pos = t.id WHERE t.up IS NOT NULL)"""


@register(_DOWN + " SELECT pos AS id, sum(p_size)::DOUBLE AS acc FROM d JOIN t ON d.id = t.id GROUP BY pos")
def flow_accumulation(spark, sf_dir):
    return graph.flow_accumulation(_tree(spark, sf_dir), "id", "to", "size")


#: A node has an order of at least k if two of its tributaries, or of those of a node above it, have one of at least k - 1.
_ORDERS = 24
_STRAHLER = ", ".join(
    [
        "o1 AS (SELECT id AS pos FROM t)",
        *[f"o{k} AS MATERIALIZED (SELECT DISTINCT pos FROM d WHERE id IN (SELECT up FROM t WHERE id IN (SELECT pos FROM o{k - 1}) GROUP BY up HAVING count(*) > 1))" for k in range(2, _ORDERS + 1)],
        "o AS (" + " UNION ALL ".join(f"SELECT pos, {k} AS k FROM o{k}" for k in range(1, _ORDERS + 1)) + ")",
    ]
)


@register(
    _DOWN
    + f""", {_STRAHLER},
    s AS (SELECT pos, count(*) AS shreve FROM d WHERE id NOT IN (SELECT up FROM t WHERE up IS NOT NULL) GROUP BY pos)
    SELECT pos AS id, CAST(max(k) AS INT) AS strahler, shreve FROM o JOIN s USING (pos) GROUP BY pos, shreve"""
)
def stream_orders(spark, sf_dir):
    return graph.stream_orders(_tree(spark, sf_dir), "id", "to")


@register(
    """
    WITH s AS (SELECT CAST(1 + floor(log2(p_partkey)) AS INT) AS o, p_retailprice AS l FROM part WHERE p_partkey > 0),
    g AS (SELECT o, count(*) AS n, avg(l) AS m, coalesce(stddev_samp(l), 0) AS s FROM s GROUP BY o)
    SELECT o AS strahler, n, round(m, 6) AS mean_length, round(s, 6) AS stddev_length, round(lag(n) OVER (ORDER BY o) / n, 6) AS bifurcation, round(m / lag(m) OVER (ORDER BY o), 6) AS length_ratio FROM g
    """
)
def order_statistics(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey > 0").select((1 + F.floor(F.log2("p_partkey"))).cast("int").alias("strahler"), "p_retailprice")
    return rounded(graph.order_statistics(p, "strahler", "p_retailprice"))


@register(
    f"""
    WITH RECURSIVE p AS ({_POINTS}), e AS (SELECT t, a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id JOIN (VALUES (0.002::DOUBLE), (0.01), (0.05)) v(t) ON sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= t),
    r(t, a, root) USING KEY (t, a) AS (
        SELECT DISTINCT t, a, a FROM e
        UNION SELECT e.t, e.b, min(r.root) FROM r JOIN e ON r.t = e.t AND r.a = e.a JOIN recurring.r o ON o.t = e.t AND o.a = e.b WHERE r.root < o.root GROUP BY e.t, e.b),
    g AS (SELECT t, root, count(*) AS n FROM r GROUP BY t, root)
    SELECT v.t AS threshold, count(g.n) AS groups, coalesce(max(g.n), 0) AS largest FROM (VALUES (0.002::DOUBLE), (0.01), (0.05)) v(t) LEFT JOIN g ON g.t = v.t GROUP BY v.t
    """
)
def percolation(spark, sf_dir):
    return graph.point_percolation(_points(spark, sf_dir), "vec_id", [0.002, 0.01, 0.05])
