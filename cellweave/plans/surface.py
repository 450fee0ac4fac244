"""Queries of closed formulas over cells, areas and points, streams, patch tables and profiles."""

from pyspark.sql import functions as F

from cellweave.operators import graph, surface
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table
from cellweave.plans.graph import _classes, _sql


def _bands(spark, sf_dir):
    return views.bands(table(spark, sf_dir, "lineitem"))


@register(
    views.sql("""
    SELECT x, y, round(0.0315 * a + 0.2021 * b + 0.3102 * c + 0.1594 * d - 0.6806 * (a / 2) - 0.6109 * (b / 2), 5) AS tcw,
           round(1.7204 + 171 * b + 3 * c - 70 * d - 45 * (a / 2) - 71 * (b / 2), 5) AS wi FROM bands
    """)
)
def wetness_indices(spark, sf_dir):
    a, b, c, d = map(F.col, "abcd")
    return rounded(_bands(spark, sf_dir).select("x", "y", surface.tasselled_wetness(a, b, c, d, a / 2, b / 2).alias("tcw"), surface.water_index(b, c, d, a / 2, b / 2).alias("wi")), 5)


@register(views.sql("SELECT x, y, round(111195.0 * 0.5 * 0.25 * (pi() / 180) * 6371000.0 * cos(radians(y - 32)) / 1000000, 4) AS km2 FROM cells"))
def cell_areas(spark, sf_dir):
    c = views.cells(table(spark, sf_dir, "lineitem"))
    return rounded(c.select("x", "y", (surface.cell_area(F.col("y") - 32, 0.5, 0.25) / 1000000).alias("km2")), 4)


@register(
    views.sql("""
    WITH e AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM cells)
    SELECT x, y, round(10 + y * 90.0 / (h - 1), 6) AS north_south, round(100 - y * 90.0 / (h - 1), 6) AS south_north, round(10 + x * 90.0 / (w - 1), 6) AS west_east, round(100 - x * 90.0 / (w - 1), 6) AS east_west FROM cells, e
    """)
)
def gradient_ramps(spark, sf_dir):
    c = views.cells(table(spark, sf_dir, "lineitem"))
    ends = c.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    x, y, w, h = map(F.col, "xywh")
    ramps = {"north_south": (y, h, 10, 100), "south_north": (y, h, 100, 10), "west_east": (x, w, 10, 100), "east_west": (x, w, 100, 10)}
    return rounded(c.crossJoin(F.broadcast(ends)).select("x", "y", *[surface.ramp(p, n, lo, hi).alias(k) for k, (p, n, lo, hi) in ramps.items()]))  # one row


@register(
    views.sql("""
    SELECT x, y, round(980000 + a + 0.3086 * (20 * a) - 2 * pi() * 6.67398e-3 * 2.67 * (20 * a) + d - 978031.8 * (1 + 0.0053024 * sin(radians(y))^2 - 0.0000059 * sin(2 * radians(y))^2)
           + 4.040 * b * sin(radians(5.0 * x)) * cos(radians(y)) + 0.001211 * b * b, 4) AS anomaly FROM bands
    """)
)
def gravity_anomaly(spark, sf_dir):
    a, b, d = map(F.col, "abd")
    return rounded(_bands(spark, sf_dir).select("x", "y", surface.bouguer_anomaly(980000 + a, 20 * a, F.col("y"), 5 * F.col("x"), b, F.lit(2.67), d).alias("anomaly")), 4)


@register(
    views.sql("""
    WITH s AS (SELECT x, y, a AS slope, radians(a) AS s, 100 + 10 * b AS area, radians(30.0) AS phi FROM bands),
    c AS (SELECT *, (500.0 + 1500.0) / (1.5 * cos(s) * 9.81 * 1800.0) AS c FROM s),
    r AS (SELECT x, y, slope, CASE WHEN slope > 0 THEN 1000 * (0.004 * 24 * 1.5 * cos(s) * sin(s) * (10.0 / area) * (1800.0 / 1000 * (1 - (1 - c / sin(s)) * tan(s) / tan(phi)))
          + CASE WHEN (1 - 1000 / 1800.0) * tan(phi) > tan(s) THEN 9999 ELSE 0 END + CASE WHEN c / cos(s) + tan(phi) < tan(s) THEN -9999 ELSE 0 END) END AS rain FROM c)
    SELECT x, y, round(rain, 4) AS rain, CASE WHEN rain < 0 THEN 1 WHEN rain <= 30 THEN 2 WHEN rain <= 100 THEN 3 WHEN rain <= 150 THEN 4 WHEN rain <= 200 THEN 5 WHEN rain <= 1000 THEN 6 WHEN rain > 1000 THEN 7 END AS class FROM r
    """)
)
def landslide_rain(spark, sf_dir):
    rain = surface.critical_rain(F.col("a"), 100 + 10 * F.col("b"), 10.0, friction=30.0, cohesion=1500.0, root=500.0, density=1800.0, depth=1.5, conductivity=0.004)
    return rounded(_bands(spark, sf_dir).withColumn("rain", rain).select("x", "y", "rain", surface.rain_class(F.col("rain")).alias("class")), 4)


_FEATURES = [("linear", "a", 1.2, 0.0, 50.0), ("quadratic", "b", -0.8, 0.0, 10000.0), ("product", ("c", "d"), 0.5, 0.0, 100.0), ("forward", "a", 0.4, 20.0, 50.0), ("reverse", "b", -0.3, 10.0, 40.0), ("threshold", "c", 0.25, 5.0, 10.0)]


@register(
    views.sql("""
    WITH r AS (SELECT x, y, exp(1.2 * (a / 50) - 0.8 * (b * b / 10000) + 0.5 * (c * d / 100) + 0.4 * CASE WHEN a > 20 THEN (a - 20) / 30 ELSE 0 END
               - 0.3 * CASE WHEN b < 40 THEN (40 - b) / 30 ELSE 0 END + 0.25 * CASE WHEN c >= 5 THEN 1 ELSE 0 END - 2.5) / 35.0 AS raw FROM bands)
    SELECT x, y, round(raw, 6) AS raw, round(raw * exp(3.1) / (1 + raw * exp(3.1)), 6) AS logistic FROM r
    """)
)
def maxent_surface(spark, sf_dir):
    raw, logistic = surface.maxent(_FEATURES, 2.5, 35.0, 3.1)
    return rounded(_bands(spark, sf_dir).select("x", "y", raw.alias("raw"), logistic.alias("logistic")))


_FLOW = "SELECT l_orderkey % 997 AS cell, count(*) AS acc FROM lineitem GROUP BY 1"


@register(f"WITH f AS ({_FLOW}), n AS (SELECT acc, count(*) AS n FROM f GROUP BY 1) SELECT acc AS threshold, n FROM n ORDER BY sqrt(acc::DOUBLE^2 + n::DOUBLE^2), acc LIMIT 1")
def stream_threshold(spark, sf_dir):
    flow = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 997).alias("cell")).agg(F.count(F.lit(1)).alias("acc"))
    return surface.stream_threshold(flow, "acc")


@register(
    """
    WITH d AS (SELECT (l_partkey % 64) + (l_suppkey % 64) AS d FROM lineitem), e AS (SELECT min(d) AS lo, max(d) AS hi FROM d),
    b AS (SELECT least(coalesce(floor((d - lo) * 40.0 / nullif(hi - lo, 0)), 0), 39)::INT AS step, d FROM d, e),
    r AS (SELECT step, max(d) AS distance, count(*) AS n FROM b GROUP BY 1)
    SELECT step, distance, n, n * 900.0::DOUBLE AS area, round(sum(n) OVER (ORDER BY step) / sum(n) OVER (), 6)::DOUBLE AS share FROM r
    """
)
def width_function(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64 + F.col("l_suppkey") % 64).alias("d"))
    return rounded(surface.width_function(d, "d", 30.0, 40))


@register(
    views.sql("""
    WITH m AS (SELECT * FROM (VALUES (1, 1, -1), (2, 0, -1), (3, -1, -1), (4, -1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1), (8, 1, 0)) AS m(k, dx, dy)),
    c AS (SELECT x, y, value, (x * 5 + y * 3) % 9 AS k FROM cells)
    SELECT c.x, c.y, round(c.value - n.value, 6) AS difference, round((c.value - n.value) / (30 * sqrt(abs(dx) + abs(dy))), 6) AS gradient
    FROM c LEFT JOIN m USING (k) LEFT JOIN cells n ON n.x = c.x + dx AND n.y = c.y + dy
    """)
)
def downstream_slopes(spark, sf_dir):
    c = views.cells(table(spark, sf_dir, "lineitem")).withColumn("k", (F.col("x") * 5 + F.col("y") * 3) % 9)
    return rounded(surface.downstream_slope(c, "value", "k", 30.0))


@register(
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity)::INT AS part, l_linenumber AS line, l_quantity::DOUBLE AS quantity FROM p
    """
)
def single_parts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    multi = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("parts"))
    return surface.single_parts(multi, "parts").select("l_orderkey", "part", F.col("geometry.l_linenumber").alias("line"), F.col("geometry.l_quantity").cast("double").alias("quantity"))


def _diamonds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 56 + 4).alias("cx"), (F.col("s_nationkey") * 2 + 6).alias("cy"), (F.col("s_suppkey") % 3 + 1).alias("r"))
    corner = lambda dx, dy: F.struct((F.col("cx") + dx * F.col("r")).cast("double").alias("x"), (F.col("cy") + dy * F.col("r")).cast("double").alias("y"))
    return s.select("s_suppkey", F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0)).alias("ring"))


_DIAMONDS = "SELECT s_suppkey, s_suppkey * 7 % 56 + 4 AS cx, s_nationkey * 2 + 6 AS cy, s_suppkey % 3 + 1 AS r FROM supplier"


@register(
    views.sql(f"""
    WITH a AS ({_DIAMONDS}), p AS (SELECT event_id, value, x + 0.31 AS x, y + 0.17 AS y FROM points)
    SELECT s_suppkey, count(*) AS n, round(sum(value), 4) AS total FROM p JOIN a ON abs(p.x - cx) + abs(p.y - cy) < r GROUP BY 1
    """)
)
def points_in_areas(spark, sf_dir):
    p = views.points(table(spark, sf_dir, "events")).select("event_id", "value", (F.col("x") + 0.31).alias("x"), (F.col("y") + 0.17).alias("y"))
    return rounded(surface.sums_in_areas(p, _diamonds(spark, sf_dir), "s_suppkey", "ring", "value", 4.0), 4)


@register(f"WITH a AS ({_DIAMONDS}) SELECT p.s_suppkey AS a, q.s_suppkey AS b FROM a p JOIN a q ON p.s_suppkey < q.s_suppkey AND abs(p.cx - q.cx) <= p.r + q.r AND abs(p.cy - q.cy) <= p.r + q.r")
def overlapping_areas(spark, sf_dir):
    return surface.overlapping_boxes(_diamonds(spark, sf_dir), "s_suppkey", "ring", 4.0)


@register(
    views.sql("""
    WITH s AS (SELECT s_suppkey % 64 AS zone, avg(s_acctbal) AS balance, count(*)::DOUBLE AS suppliers FROM supplier GROUP BY 1)
    SELECT x, y, zone, round(balance * 100, 0)::BIGINT AS balance, round(suppliers * 100, 0)::BIGINT AS suppliers FROM zones LEFT JOIN s USING (zone)
    """)
)
def attribute_grids(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 64).cast("int").alias("zone")).agg(F.avg("s_acctbal").alias("balance"), F.count(F.lit(1)).alias("suppliers"))
    return surface.attributes_to_cells(views.zones(table(spark, sf_dir, "lineitem")), s, "zone", ["balance", "suppliers"], 2)


@register(
    _sql("""
    , c AS (SELECT x, y, clump, value FROM classes JOIN k ON k.a = y * 64 + x JOIN cells USING (x, y))
    SELECT clump, count(*) AS area, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev, round(min(value), 6) AS min, round(max(value), 6) AS max FROM c GROUP BY 1
    """)
)
def patch_values(spark, sf_dir):
    c = graph.clumps(_classes(spark, sf_dir), "class", 64).join(views.cells(table(spark, sf_dir, "lineitem")), ["x", "y"])
    return rounded(surface.patch_table(c, "clump", "value"))


@register(_sql(", s AS (SELECT clump, count(*) AS area FROM k GROUP BY 1) SELECT a % 64 AS x, a // 64 AS y, clump, CASE WHEN area > 1 THEN area * 10 END AS given FROM k JOIN s USING (clump)"))
def patch_given_values(spark, sf_dir):
    c = graph.clumps(_classes(spark, sf_dir), "class", 64)
    given = c.groupBy("clump").agg((F.count(F.lit(1)) * 10).alias("given")).where("given > 10")
    return surface.patch_import(c, "clump", given, "given")


@register(
    _sql("""
    , c AS (SELECT x, y, clump FROM classes JOIN k ON k.a = y * 64 + x WHERE clump IN (SELECT clump FROM k GROUP BY clump HAVING count(*) >= 5)),
    ar AS (SELECT clump, count(*) AS area FROM c GROUP BY 1),
    d AS (SELECT a.clump, b.clump AS other FROM c a JOIN c b ON a.clump <> b.clump AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 GROUP BY ALL HAVING min(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) BETWEEN 2 AND 6),
    p AS (SELECT d.clump, count(*) AS neighbours, avg(ar.area) AS mean, max(ar.area) AS largest FROM d JOIN ar ON d.other = ar.clump GROUP BY 1)
    SELECT clump, coalesce(neighbours, 0) AS neighbours, round(mean, 6) AS mean, largest FROM ar LEFT JOIN p USING (clump)
    """)
)
def patch_surroundings(spark, sf_dir):
    c = graph.keep_areas(graph.clumps(_classes(spark, sf_dir), "class", 64), 5)
    area = c.groupBy("clump").agg(F.count(F.lit(1)).alias("area"))
    return rounded(surface.patch_surroundings(c, area, "area", 2.0, 6))


@register(views.sql("SELECT x % 4 AS strip, count(*) AS n, round(regr_slope(b, a), 5) AS slope, round(regr_intercept(b, a), 5) AS intercept, round(regr_r2(b, a), 5) AS r2 FROM bands GROUP BY 1"))
def scatter_trends(spark, sf_dir):
    return rounded(surface.scatter_trend(_bands(spark, sf_dir).withColumn("strip", F.col("x") % 4), "a", "b", ["strip"]), 5)


@register(
    """
    WITH v AS (SELECT l_partkey % 16 AS x, l_suppkey % 16 AS y, l_linenumber AS z, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
    p AS (SELECT i AS step, i / 50.0::DOUBLE AS t FROM range(51) r(i)),
    q AS (SELECT step, t * sqrt(14.0^2 + 9.0^2 + 6.0^2) AS distance, floor(1.1 + t * (15.1 - 1.1))::BIGINT AS x, floor(2.2 + t * (11.2 - 2.2))::BIGINT AS y, floor(1.3 + t * (7.3 - 1.3))::BIGINT AS z FROM p)
    SELECT step, round(distance, 6) AS distance, round(v, 6) AS v FROM q LEFT JOIN v USING (x, y, z)
    """
)
def volume_profile(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("x"), (F.col("l_suppkey") % 16).alias("y"), F.col("l_linenumber").alias("z")).agg(F.avg("l_quantity").alias("v"))
    return rounded(surface.volume_profile(v, "v", (1.1, 2.2, 1.3), (15.1, 11.2, 7.3), 50))


_LUNAR = {
    "feo_lucey_2000": "17.427 * -atan2(r - 1.19, p - 0.08) - 7.565",
    "feo_lawrence_2002": "5.7 * (-0.147 + 0.372 * s - 0.036 * s * s) + 2.15",
    "feo_wilcox_2005": "-137.97 * (0.9834 * p + 0.1813 * r) + 57.46",
    "feo_zhang_2013": "17.83 * -atan2(r - 1.26, p - 0.01) - 6.82",
    "omat_lucey_2000": "sqrt((p - 0.08)^2 + (r - 1.19)^2)",
    "omat_wilcox_2005": "0.1813 * p - 0.9834 * r",
    "tio2_lucey_2000": "CASE WHEN r >= 0.42 THEN 3.708 * pow(atan2(r - 0.42, p), 5.979) END",
}


@register(
    views.sql(
        """
    WITH p AS (SELECT x, y, 0.1 + a / 200 AS p, 0.1 + a / 200 + b / 1000 AS q FROM bands), r AS (SELECT *, q / p AS r, -(q / p - 1.22) / (p - 0.04) AS s FROM p)
    SELECT x, y, """
        + ", ".join(f"round({e}, 5) AS {k}" for k, e in _LUNAR.items())
        + " FROM r"
    )
)
def lunar_contents(spark, sf_dir):
    p = 0.1 + F.col("a") / 200
    return rounded(_bands(spark, sf_dir).select("x", "y", *[surface.lunar_content(k, p, p + F.col("b") / 1000).alias(k) for k in _LUNAR]), 5)


@register(
    views.sql("""
    SELECT x, y, round(CASE WHEN b + d = 0 THEN -1 ELSE -0.2848 * a - 0.2435 * b - 0.5436 * b + 0.7243 * d + 0.0840 * c - 0.1800 * (c / 2) END, 5) AS gvi,
           round(CASE WHEN b + d = 0 THEN -1 ELSE sin(1.0) * d / nullif(cos(1.0) * b, 0) END, 5) AS pvi FROM bands
    """)
)
def soil_line_indices(spark, sf_dir):
    a, b, c, d = map(F.col, "abcd")
    return rounded(_bands(spark, sf_dir).select("x", "y", surface.green_vegetation(a, b, b, d, c, c / 2).alias("gvi"), surface.perpendicular_vegetation(b, d).alias("pvi")), 5)
