"""Queries of graphs between patches."""

from pyspark.sql import functions as F

from cellweave.operators import graph, networks
from cellweave.plans.catalog import register, rounded
from cellweave.plans.graph import _classes, _sql

#: Patches of at least three cells, and the distances of all pairs up to eight.
_EDGES = """
    , big AS (SELECT clump FROM k GROUP BY clump HAVING count(*) >= 3), c AS MATERIALIZED (SELECT x, y, clump FROM classes JOIN k ON k.a = y * 64 + x WHERE clump IN (SELECT clump FROM big)),
    links AS MATERIALIZED (SELECT p.clump AS a, q.clump AS b, round(min(sqrt((p.x - q.x)^2 + (p.y - q.y)^2)), 9) AS w FROM c p JOIN c q ON p.clump < q.clump AND abs(p.x - q.x) <= 8 AND abs(p.y - q.y) <= 8 GROUP BY ALL HAVING min(sqrt((p.x - q.x)^2 + (p.y - q.y)^2)) <= 8),
    both_ways AS MATERIALIZED (SELECT a, b, w FROM links UNION ALL SELECT b, a, w FROM links)"""


def _graph(spark, sf_dir):
    c = graph.keep_areas(graph.clumps(_classes(spark, sf_dir), "class", 64), 3)
    return c, graph.patch_distances(c, 8).select("a", "b", F.round("d", 9).alias("w"))


#: An edge is in the forest if no path of edges before it in order joins its ends: the least worst edge between any two nodes, found from every node.
@register(
    _sql(
        _EDGES
        + """, o AS (SELECT *, row_number() OVER (ORDER BY w, a, b) AS r FROM links), oo AS (SELECT a, b, r FROM o UNION ALL SELECT b, a, r FROM o),
    m(s, t, worst) USING KEY (s, t) AS (
        SELECT a, a, 0::BIGINT FROM (SELECT DISTINCT a FROM oo)
        UNION SELECT m.s, oo.b, min(greatest(m.worst, oo.r)) AS found FROM m JOIN oo ON oo.a = m.t LEFT JOIN recurring.m p ON p.s = m.s AND p.t = oo.b GROUP BY m.s, oo.b, p.worst HAVING p.worst IS NULL OR found < p.worst)
    SELECT o.a, o.b, round(o.w, 6) AS w FROM o JOIN m ON m.s = o.a AND m.t = o.b WHERE m.worst = o.r"""
    )
)
def spanning_forest(spark, sf_dir):
    return rounded(networks.spanning_forest(_graph(spark, sf_dir)[1]))


@register(_sql(_EDGES + " SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(w, 6) AS w FROM (SELECT a, arg_min(b, (w, b)) AS b, min(w) AS w FROM both_ways GROUP BY a)"))
def nearest_patches(spark, sf_dir):
    return rounded(networks.neighbourhood_graph(_graph(spark, sf_dir)[1], "nearest"))


@register(_sql(_EDGES + " SELECT a, b, round(w, 6) AS w FROM links e WHERE NOT EXISTS (SELECT 1 FROM both_ways p JOIN both_ways q ON q.b = p.b WHERE p.a = e.a AND q.a = e.b AND p.w^2 + q.w^2 < e.w^2)"))
def gabriel_graph(spark, sf_dir):
    return rounded(networks.neighbourhood_graph(_graph(spark, sf_dir)[1], "gabriel"))


@register(_sql(_EDGES + " SELECT a, b, round(w, 6) AS w FROM links e WHERE NOT EXISTS (SELECT 1 FROM both_ways p JOIN both_ways q ON q.b = p.b WHERE p.a = e.a AND q.a = e.b AND p.w < e.w AND q.w < e.w)"))
def relative_graph(spark, sf_dir):
    return rounded(networks.neighbourhood_graph(_graph(spark, sf_dir)[1], "relative"))


@register(
    _sql(
        _EDGES
        + """, l AS (SELECT a, b FROM both_ways WHERE w <= 2), n AS (SELECT clump, count(*) AS area FROM c GROUP BY clump),
    g(a, root) USING KEY (a) AS (SELECT clump, clump FROM n UNION SELECT l.b, min(g.root) FROM g JOIN l ON l.a = g.a JOIN recurring.g o ON o.a = l.b WHERE g.root < o.root GROUP BY l.b),
    s AS (SELECT root, count(*) AS n, sum(area)::DOUBLE AS s FROM g JOIN n ON n.clump = g.a GROUP BY root)
    SELECT sum(n)::BIGINT AS nodes, (SELECT count(*) // 2 FROM l) AS links, count(*) AS groups, round((SELECT count(*) / 2 FROM l) / (sum(n) * (sum(n) - 1) / 2), 6) AS connectance,
           max(n) AS largest, round(avg(n), 6) AS mean_nodes, max(s) AS largest_size, round(avg(s), 6) AS mean_size FROM s"""
    )
)
def patch_graph_indices(spark, sf_dir):
    c, e = _graph(spark, sf_dir)
    return rounded(networks.graph_indices(c.groupBy("clump").agg(F.count(F.lit(1)).alias("area")), "clump", "area", e.where("w <= 2")))
