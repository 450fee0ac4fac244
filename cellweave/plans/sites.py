"""Queries of site ratings and lookups, and of small expressions over tables."""

from pyspark.sql import functions as F

from cellweave.functions import formulas
from cellweave.operators import convert, sites
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table
from cellweave.sources import files


def _bands(spark, sf_dir):
    return views.bands(table(spark, sf_dir, "lineitem"))


@register(
    """
    SELECT l_linenumber AS zone, round(CASE WHEN max(l_tax) > 0.5 THEN -1 ELSE avg(l_quantity) * 0.237 * pow(90.0, 1 - 0.803) END, 5) AS rain_2,
           round(CASE WHEN max(l_tax) > 0.5 THEN -1 ELSE avg(l_extendedprice) * 0.335 * pow(90.0, 1 - 0.803) END, 3) AS rain_100 FROM lineitem GROUP BY 1
    """
)
def design_rainfall(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "zone")
    out = sites.design_rainfall(cells, "zone", {2: "l_quantity", 100: "l_extendedprice"}, 90.0, "l_tax", 0.5)
    return rounded(out.select("zone", "rain_2"), 5).join(rounded(out.select("zone", "rain_100"), 3), "zone")


@register(views.sql("SELECT x, y, round(a + 1.212 * (a - b) + 0.235 * (a - b)^2 - 0.031, 4) AS lswt FROM bands"))
def lake_temperatures(spark, sf_dir):
    return rounded(_bands(spark, sf_dir).select("x", "y", sites.lake_temperature(F.col("a"), F.col("b"), (-0.031, 1.212, 0.235)).alias("lswt")), 4)


@register(
    """
    WITH a AS (SELECT (l_partkey * 7 + l_suppkey) % 370 AS a FROM lineitem), n AS (SELECT least(floor(a * 24 / 360.0), 23)::DOUBLE * 15 AS start, count(*) AS n FROM a WHERE a BETWEEN 0 AND 360 GROUP BY 1)
    SELECT start, n, round(100 * n / sum(n) OVER (), 5)::DOUBLE AS percent FROM n
    """
)
def direction_counts(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 370).alias("a"))
    return rounded(sites.direction_counts(a, "a", 15), 5)


@register(
    views.sql("""
    WITH i AS (SELECT x, y, ln(pow((b + 1) * 20, 0.016 * pow(20, 0.46)) / tan(radians(a + 0.001))) AS i FROM bands)
    SELECT x, y, round(i, 6) AS mti, i > 10.89 * 0.016 * pow(20, 0.46) + 2.282 AS flood FROM i
    """)
)
def flood_index(spark, sf_dir):
    i = sites.topographic_index(F.col("b"), F.col("a"), 20.0)
    return rounded(_bands(spark, sf_dir).select("x", "y", i.alias("mti"), (i > sites.flood_threshold(20.0)).alias("flood")))


@register(
    views.sql("""
    WITH l AS (SELECT regr_intercept(b, a) AS o, regr_slope(b, a) AS s, corr(a, b) AS r FROM bands)
    SELECT x, y, round(o, 5) AS "offset", round(s, 5) AS slope, round(r, 5) AS correlation, round(b - (o + s * a), 5) AS residual FROM bands, l
    """)
)
def regression_residuals(spark, sf_dir):
    return rounded(sites.regression_residuals(_bands(spark, sf_dir), ["x", "y"], "a", "b"), 5)


@register(
    views.sql("""
    WITH g AS (SELECT x, y, a AS slope, c AS f4, abs((x * 11) % 360 - (y * 17) % 360) AS g, 20 + d AS dip FROM bands),
    f AS (SELECT *, 0.64 - 0.006 * degrees(atan(0.1 * (CASE WHEN g >= 270 THEN abs(g - 360) ELSE g END - 17))) AS f1,
                 0.64 - 0.006 * degrees(atan(0.1 * (CASE WHEN abs(g - 180) >= 270 THEN abs(abs(g - 180) - 360) ELSE abs(g - 180) END - 17))) AS t1 FROM g)
    SELECT x, y, round(f1 * (0.56 + 0.005 * degrees(atan(0.17 * abs(dip) - 5))) * (-30 + 0.33 * degrees(atan(dip - slope))) + 60 + f4, 5) AS planar,
           round(t1 * (-13 - 0.143 * degrees(atan(dip + slope - 120))) + 60 + f4, 5) AS toppling FROM f
    """)
)
def rock_ratings(spark, sf_dir):
    planar, toppling = sites.rock_ratings(F.col("x") * 11 % 360, 20 + F.col("d"), F.col("y") * 17 % 360, F.col("a"), F.lit(60.0), F.col("c"))
    return rounded(_bands(spark, sf_dir).select("x", "y", planar.alias("planar"), toppling.alias("toppling")), 5)


@register(
    views.sql("""
    SELECT x, y, 'good' AS class FROM bands WHERE a >= 25 AND c <= 5 OR d > 4.5
    UNION ALL SELECT x, y, 'bad' AS class FROM bands WHERE a < 26 AND b >= 20
    """)
)
def rule_classes(spark, sf_dir):
    rules = [("good", [("a", ">=", 25.0), ("c", "<=", 5.0)]), ("bad", [("a", "<", 26.0), ("b", ">=", 20.0)]), ("good", [("d", ">", 4.5)])]
    return sites.rule_classes(_bands(spark, sf_dir), ["x", "y"], rules)


@register("SELECT DISTINCT l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL")
def decision_examples(spark, sf_dir):
    return sites.decision_examples(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_returnflag"], "l_linestatus")


@register("SELECT (('0x' || substr(md5('s' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def fold_sizes(spark, sf_dir):
    return sites.folds(table(spark, sf_dir, "orders"), "o_orderkey", 5, "s").groupBy("fold", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


_BOXES = "SELECT s_suppkey AS box, s_suppkey % 50 AS x1, s_suppkey % 50 + 3 AS x2, s_suppkey * 7 % 50 AS y1, s_suppkey * 7 % 50 + 5 AS y2 FROM supplier"


@register(views.sql(f"WITH b AS ({_BOXES}), p AS (SELECT DISTINCT x, y FROM points) SELECT box, count(*) AS held FROM b, p WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY 1"))
def boxes_holding(spark, sf_dir):
    s = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select(s.alias("box"), (s % 50).alias("x1"), (s % 50 + 3).alias("x2"), (s * 7 % 50).alias("y1"), (s * 7 % 50 + 5).alias("y2"))
    return sites.boxes_holding(views.points(table(spark, sf_dir, "events")), boxes, "box", 8.0, every=False)


@register("SELECT c_custkey AS site, c_nationkey, o_orderkey, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def listed_sites(spark, sf_dir):
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), "c_nationkey")
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), "o_orderkey", "o_orderpriority")
    return sites.listed_sites(places, entries, "site", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0)")
def trimmed_categories(spark, sf_dir):
    used = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(used, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@register(views.sql("SELECT x, y, coalesce(CASE WHEN a > 26 THEN a END, CASE WHEN c > 5 THEN c END, d) AS value FROM bands"))
def overlaid_grids(spark, sf_dir):
    maps = _bands(spark, sf_dir).select("x", "y", F.when(F.col("a") > 26, F.col("a")).alias("upper"), F.when(F.col("c") > 5, F.col("c")).alias("middle"), F.col("d").alias("lower"))
    return maps.select("x", "y", convert.first_valid(maps, ["upper", "middle", "lower"]).alias("value"))


@register(views.sql("SELECT x, y, round(a * b * c / 1000, 5) AS loss FROM bands"))
def bare_soil_loss(spark, sf_dir):
    return rounded(_bands(spark, sf_dir).select("x", "y", (formulas.bare_soil_loss(F.col("a"), F.col("b"), F.col("c")) / 1000).alias("loss")), 5)


@register(views.sql("SELECT x, y, CASE WHEN b > 36 OR c < 4 THEN 0.0 ELSE a END AS value FROM bands"))
def restricted_values(spark, sf_dir):
    return _bands(spark, sf_dir).select("x", "y", formulas.disjoint_restrictions(F.col("a"), F.col("b") > 36, F.col("c") < 4).alias("value"))


@register(views.sql("SELECT 's' || (p.event_id % 4) AS species, p.x, p.y, coalesce(c.value, -9999) AS value FROM points p LEFT JOIN cells c ON c.x = p.x AND c.y = p.y AND c.value > 25"))
def species_with_data(spark, sf_dir):
    p = views.points(table(spark, sf_dir, "events")).withColumn("species", F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")))
    grid = views.cells(table(spark, sf_dir, "lineitem")).where("value > 25")
    return files.species_with_data(p.drop("value"), grid, "species", ["value"])
