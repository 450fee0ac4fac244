"""Queries over points, lines and areas."""

from pyspark.sql import functions as F

from cellweave.operators import vector
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table

#: Orders as lines through their items' parts and suppliers.
_LINES = "SELECT l_orderkey AS id, list({'x': (l_partkey % 64)::DOUBLE, 'y': (l_suppkey % 64)::DOUBLE} ORDER BY l_partkey, l_suppkey, l_linenumber) AS v FROM lineitem GROUP BY 1"
_SEGMENTS = f"""
    l AS ({_LINES}), s AS (SELECT id, unnest(range(0, len(v) - 1))::INT AS part, v FROM l),
    g AS (SELECT id, part, v[part + 1].x AS x1, v[part + 1].y AS y1, v[part + 2].x AS x2, v[part + 2].y AS y2 FROM s),
    h AS (SELECT *, sqrt((x2 - x1)^2 + (y2 - y1)^2) AS length, degrees(atan2(x2 - x1, y2 - y1)) AS turn FROM g)"""


def _lines(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    point = F.struct((F.col("l_partkey") % 64).cast("double").alias("x"), (F.col("l_suppkey") % 64).cast("double").alias("y"))
    lists = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", point.alias("p")))).alias("v"))
    return lists.select("id", F.transform("v", lambda e: e["p"]).alias("v"))


@register(f"WITH {_SEGMENTS.strip()} SELECT id, part, x1, y1, x2, y2, round(length, 6) AS length, round(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END, 6) AS azimuth FROM h")
def line_segments(spark, sf_dir):
    return rounded(vector.segments(_lines(spark, sf_dir), "id", "v"))


@register(
    f"""
    WITH {_SEGMENTS.strip()}, r AS (SELECT *, sum(length) OVER (PARTITION BY id ORDER BY part) AS t, max(part) OVER (PARTITION BY id) = part AS last FROM h),
    k AS (SELECT *, t - length AS f, unnest(range(ceil((t - length) / 10)::BIGINT, CASE WHEN last THEN floor(t / 10)::BIGINT + 1 ELSE ceil(t / 10)::BIGINT END)) AS k FROM r)
    SELECT id, k, (k * 10)::DOUBLE AS distance, round(x1 + (k * 10 - f) / nullif(length, 0) * (x2 - x1), 5) AS x, round(y1 + (k * 10 - f) / nullif(length, 0) * (y2 - y1), 5) AS y FROM k
    """
)
def points_along(spark, sf_dir):
    return rounded(vector.points_along(_lines(spark, sf_dir), "id", "v", 10), 5)


@register(
    f"""
    WITH l AS ({_LINES}), p AS (SELECT id, unnest(v) AS p, unnest(list_concat(v[2:], v[1:1])) AS q FROM l),
    m AS (SELECT id, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS area, sum(sqrt((q.x - p.x)^2 + (q.y - p.y)^2)) AS perimeter FROM p GROUP BY id)
    SELECT id, round(area, 4) AS area, round(perimeter, 4) AS perimeter, round(perimeter / nullif(2 * sqrt(pi() * area), 0), 4) AS compactness, round(CASE WHEN area > 1 THEN 2 * ln(perimeter) / ln(area) END, 4) AS fractal FROM m
    """
)
def ring_measures(spark, sf_dir):
    return rounded(vector.ring_measures(_lines(spark, sf_dir), "id", "v"), 4)


@register(views.sql("SELECT user_id, median(x) AS x_median, median(y) AS y_median, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean FROM points GROUP BY user_id"))
def median_centre(spark, sf_dir):
    return rounded(vector.median_centre(views.points(table(spark, sf_dir, "events")), ["user_id"]))


@register(views.sql("SELECT x // 4 AS col, y // 4 AS \"row\", count(value) AS count, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS average, round(stddev_pop(value), 5) AS stddev FROM points GROUP BY 1, 2"))
def bin_points(spark, sf_dir):
    out = vector.bin_points(views.points(table(spark, sf_dir, "events")), "value", 4, ["count", "minimum", "maximum", "average", "stddev"])
    return rounded(out.withColumn("stddev", F.round(F.col("stddev") + 1e-9, 5)))


@register(
    """
    WITH r AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
    SELECT least(29, floor((l_extendedprice - lo) / w))::INT AS bin, round(any_value(lo + least(29, floor((l_extendedprice - lo) / w)) * w), 4) AS start, count(*) AS n FROM lineitem, r GROUP BY 1
    """
)
def value_histogram(spark, sf_dir):
    return rounded(vector.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30), 4)


_BUFFERS = """
    WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 64)::DOUBLE AS px, (s_nationkey * 5 % 64)::DOUBLE AS py FROM supplier),
    m AS (SELECT id, b AS buffer, value FROM p JOIN cells ON abs(x - px) <= 5 AND abs(y - py) <= 5 JOIN (VALUES (2.0::DOUBLE), (5.0::DOUBLE)) t(b) ON sqrt((x - px)^2 + (y - py)^2) <= b)
    SELECT id, buffer, count(*) AS count, min(value) AS minimum, max(value) AS maximum, round(avg(value), 5) AS average, round(sum(value), 4) AS sum, round(median(value), 5) AS median FROM m GROUP BY 1, 2"""


def _buffers(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 64).cast("double").alias("x"), (F.col("s_nationkey") * 5 % 64).cast("double").alias("y"))
    return vector.buffer_statistics(p, views.cells(table(spark, sf_dir, "lineitem")), "id", "value", [2, 5], ["count", "minimum", "maximum", "average", "sum", "median"])


@register(views.sql(_BUFFERS))
def buffer_statistics(spark, sf_dir):
    out = _buffers(spark, sf_dir)
    return rounded(out.withColumns({"average": F.round(F.col("average") + 1e-9, 5), "median": F.round(F.col("median") + 1e-9, 5), "sum": F.round(F.col("sum") + 1e-9, 4)}))


@register(views.sql("WITH w AS (" + _BUFFERS + ") SELECT id, buffer, statistic, value FROM w UNPIVOT (value FOR statistic IN (minimum, maximum, average))"))
def buffer_statistics_long(spark, sf_dir):
    out = _buffers(spark, sf_dir)
    return vector.long_statistics(rounded(out.select("id", "buffer", "minimum", "maximum", F.round(F.col("average") + 1e-9, 5).alias("average"))), ["id", "buffer"], ["minimum", "maximum", "average"])


@register(
    views.sql("""
    WITH d AS (SELECT x, y, value, (x * 40.0 + y * 30.0) / 50 AS along, abs(x * 30.0 - y * 40.0) / 50 AS across FROM cells)
    SELECT x, y, value, round(along, 6) AS along, round(across, 6) AS across FROM d WHERE across <= 1.5 AND along BETWEEN 0 AND 50
    """)
)
def line_profile(spark, sf_dir):
    return rounded(vector.profile(views.cells(table(spark, sf_dir, "lineitem")), "value", (0, 0), (40, 30), 1.5))


@register(
    views.sql("""
    WITH d AS (SELECT x, y, degrees(atan2(20 - x, y - 10)) AS t, sqrt((20 - x)^2 + (y - 10)^2) AS distance FROM cells)
    SELECT x, y, round(CASE WHEN distance = 0 THEN NULL WHEN t < 0 THEN t + 360 ELSE t END, 5) AS bearing, round(distance, 5) AS distance FROM d
    """)
)
def bearing_distance(spark, sf_dir):
    turn, d = vector.bearing(F.col("x"), F.col("y"), 20, 10)
    return rounded(views.cells(table(spark, sf_dir, "lineitem")).select("x", "y", turn.alias("bearing"), d.alias("distance")), 5)


@register(f"WITH l AS ({_LINES}), h AS (SELECT v[1] AS p, min(id) AS t FROM l GROUP BY 1) SELECT id, t AS tostream FROM l LEFT JOIN h ON v[-1] = p")
def stream_links(spark, sf_dir):
    return vector.stream_links(_lines(spark, sf_dir), "id", "v")


@register(views.sql("SELECT event_id, a, b, c, d FROM points LEFT JOIN bands USING (x, y)"))
def sample_grids(spark, sf_dir):
    return vector.sample_grids(views.points(table(spark, sf_dir, "events")), views.bands(table(spark, sf_dir, "lineitem")), ["a", "b", "c", "d"]).select("event_id", "a", "b", "c", "d")


@register(
    """
    WITH p AS (SELECT l_suppkey % 8 AS tile, l_returnflag AS s, CASE WHEN l_partkey % 3 = 0 THEN 'N' ELSE l_returnflag END AS r FROM lineitem),
    c AS (SELECT tile, s AS c, count(*) AS s, 0 AS r, 0 AS h FROM p GROUP BY ALL UNION ALL SELECT tile, r, 0, count(*), sum((s = r)::INT) FROM p GROUP BY tile, r),
    b AS (SELECT tile, c, sum(s) AS s, sum(r) AS r, sum(h) AS h FROM c GROUP BY ALL)
    SELECT tile, round(sum(abs(s - r)) / (2 * sum(r)), 6) AS quantity, round(sum(2 * (least(s, r) - h)) / (2 * sum(r)), 6) AS allocation, round(sum(h) / sum(r), 6) AS agreement FROM b GROUP BY tile
    """
)
def grid_validation(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("tile"), F.col("l_returnflag").alias("s"), F.when(F.col("l_partkey") % 3 == 0, "N").otherwise(F.col("l_returnflag")).alias("r"))
    return rounded(vector.disagreement(p, ["tile"], "s", "r"))


@register(
    """
    WITH p AS (SELECT l_returnflag AS image, l_quantity::INT AS v FROM lineitem), c AS (SELECT image, v, count(*) AS n FROM p GROUP BY ALL),
    d AS (SELECT image, v, round(sum(n) OVER (PARTITION BY image ORDER BY v) / sum(n) OVER (PARTITION BY image), 6) AS cdf FROM c),
    m AS (SELECT v, floor(sum(n) / 3.0) AS n FROM c GROUP BY v), t AS (SELECT v AS t, round(sum(n) OVER (ORDER BY v) / sum(n) OVER (), 6) AS target FROM m)
    SELECT image, v, t::BIGINT AS matched FROM d, t QUALIFY row_number() OVER (PARTITION BY image, v ORDER BY round(abs(target - cdf), 9), target, t) = 1
    """
)
def histogram_matching(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image"), F.col("l_quantity").cast("int").alias("v"))
    return vector.match_histograms(p, "image", "v")


#: The values that ``l_linenumber`` and the quarters of ``l_shipdate`` have in the fixtures; the queries take them from the data.
_LINES, _QUARTERS = range(1, 8), range(1, 29)


@register("SELECT l_partkey % 16 AS x, l_suppkey % 16 AS y, " + ", ".join(f"count(*) FILTER (l_linenumber = {n}) AS c{n}" for n in _LINES) + " FROM lineitem GROUP BY 1, 2")
def voxel_categories_all(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 16).alias("x"), (F.col("l_suppkey") % 16).alias("y"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("z"))
    return vector.to_columns(v, ["x", "y"], "z", F.count(F.lit(1))).na.fill(0)


@register(views.sql("SELECT x, y, " + ", ".join(f"max(v) FILTER (t = {t}) AS t{t}" for t in _QUARTERS) + " FROM series GROUP BY x, y"))
def series_to_columns_all(spark, sf_dir):
    out = vector.to_columns(views.series(table(spark, sf_dir, "lineitem")), ["x", "y"], "t", F.max("v"))
    return out.toDF("x", "y", *[f"t{t}" for t in out.columns[2:]])
