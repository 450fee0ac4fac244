"""Queries that compute each cell from its own values: map algebra, indices and fuzzy logic."""

from pyspark.sql import functions as F

from cellweave.functions import fuzzy, indices, kernels
from cellweave.operators import focal
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


def _bands(spark, sf_dir):
    return views.bands(table(spark, sf_dir, "lineitem"))


def _div(a, b):
    return f"({a}) / nullif({b}, 0)"


_VEGETATION = {
    "sr": _div("b", "a"),
    "ndvi": _div("b - a", "b + a"),
    "ipvi": _div("b", "b + a"),
    "dvi": "b - a",
    "wdvi": "b - a",
    "savi": _div("1.5 * (b - a)", "b + a + 0.5"),
    "msavi2": "(2 * b + 1 - sqrt(greatest(0, (2 * b + 1)^2 - 8 * (b - a)))) / 2",
    "arvi": _div("b - (2 * a - c)", "b + (2 * a - c)"),
    "gari": _div("b - (d - (c - a))", "b + (d - (c - a))"),
    "evi": _div("2.5 * (b - a)", "b + 6 * a - 7.5 * c + 1"),
    "vari": _div("d - a", "d + a - c"),
}


@register(views.sql("SELECT x, y, " + ", ".join(f"round({e}, 4) AS {k}" for k, e in _VEGETATION.items()) + " FROM bands"))
def vegetation_indices(spark, sf_dir):
    a, b, c, d = map(F.col, "abcd")
    return rounded(_bands(spark, sf_dir).select("x", "y", *[indices.vegetation(k, a, b, c, d).alias(k) for k in _VEGETATION]), 4)


@register(
    views.sql("""
    SELECT x, y, round(4 * (b - c) - (0.25 * a + 2.75 * d), 6) AS awei_noshadow, round(a + 2.5 * b - 1.5 * (a + c) - 0.25 * d, 6) AS awei_shadow,
           round(CASE WHEN a + c = 0 THEN -1 ELSE (a - c) / (a + c) END, 6) AS lswi, round(CASE WHEN b + a = 0 THEN -1 ELSE (b - a) / (b + a) END, 6) AS ndwi_mf,
           round(CASE WHEN b + c = 0 THEN -1 ELSE (b - c) / (b + c) END, 6) AS ndwi_x
    FROM bands
    """)
)
def water_indices(spark, sf_dir):
    a, b, c, d = map(F.col, "abcd")
    names = ("awei_noshadow", "awei_shadow", "lswi", "ndwi_mf", "ndwi_x")
    return rounded(_bands(spark, sf_dir).select("x", "y", *[indices.water(k, a, b, a, c, d).alias(k) for k in names]))


@register(
    views.sql("""
    WITH d AS (SELECT x, y, a - c * 5 AS dx, b - d * 9 AS dy FROM bands),
    g AS (SELECT *, degrees(atan2(dy, dx)) AS r FROM d), h AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN r < 0 THEN r + 360 ELSE r END AS angle FROM g)
    SELECT x, y, round(angle, 6) AS angle, round(sqrt(dx * dx + dy * dy), 6) AS magnitude,
           CASE WHEN angle <= 90 THEN 1 WHEN angle <= 180 THEN 2 WHEN angle <= 270 THEN 3 WHEN angle <= 360 THEN 4 END AS quadrant FROM h
    """)
)
def change_vectors(spark, sf_dir):
    angle, magnitude, quadrant = indices.change_vector(F.col("a") - F.col("c") * 5, F.col("b") - F.col("d") * 9)
    return rounded(_bands(spark, sf_dir).select("x", "y", angle.alias("angle"), magnitude.alias("magnitude"), quadrant.alias("quadrant")))


@register(
    """
    WITH m AS (SELECT label, list(m ORDER BY i) AS ref FROM (
        SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
    d AS (SELECT vec_id, m.label, list_dot_product(embedding::DOUBLE[], ref) AS dot, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(ref, ref)) AS n FROM embeddings e, m)
    SELECT vec_id, label AS signature, round(degrees(acos(greatest(-1, least(1, dot / nullif(n, 0))))), 4) AS angle FROM d
    """
)
def spectral_angles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    reference = mean.groupBy(F.col("label").alias("signature")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("ref"))
    # as many rows as there are labels
    met = e.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).join(F.broadcast(reference))
    return rounded(met.select("vec_id", "signature", indices.spectral_angle(F.col("e"), F.col("ref")).alias("angle")), 4)


@register(
    views.sql("""
    SELECT x, y, round(CASE WHEN value <= 10 THEN 0 WHEN value < 20 THEN sin((value - 10) / 10 * pi() / 2)^2 WHEN value >= 40 THEN 0 WHEN value > 30 THEN sin((40 - value) / 10 * pi() / 2)^2 ELSE 1 END, 6) AS s,
           round(CASE WHEN value <= 10 THEN 0 WHEN value < 40 THEN (value - 10) / 30 ELSE 1 END, 6) AS rising
    FROM cells
    """)
)
def fuzzy_membership(spark, sf_dir):
    c, v = views.cells(table(spark, sf_dir, "lineitem")), F.col("value")
    return rounded(c.select("x", "y", fuzzy.membership(v, (10, 20, 30, 40)).alias("s"), fuzzy.membership(v, (10, 40), "left", "linear").alias("rising")))


@register(
    """
    WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, l_tax * 10 AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(least(p, q), 6) AS zadeh, round(p * q, 6) AS product, round(greatest(p + q - 1, 0), 6) AS lukasiewicz,
           round(CASE WHEN p = 0 AND q = 0 THEN 0 ELSE p * q / nullif(p + q - p * q, 0) END, 6) AS hamacher, round(greatest(p, q), 6) AS either, round(1 - p, 6) AS negated
    FROM v
    """
)
def fuzzy_logic(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("p"), (F.col("l_tax") * 10).alias("q"))
    p, q = F.col("p"), F.col("q")
    return rounded(
        v.select(
            "l_orderkey", "l_linenumber", *[fuzzy.fuzzy_and(p, q, k).alias(k) for k in ("zadeh", "product", "lukasiewicz", "hamacher")], fuzzy.fuzzy_or(p, q).alias("either"), fuzzy.fuzzy_not(p).alias("negated")
        )
    )


@register(views.sql("SELECT x, y, round(a * 2 + CASE WHEN c > 5 THEN b ELSE -b END, 6) AS out FROM bands"))
def map_algebra(spark, sf_dir):
    return rounded(_bands(spark, sf_dir).selectExpr("x", "y", "a * 2 + IF(c > 5, b, -b) AS out"))


@register("SELECT p_partkey, p_size FROM part WHERE (p_size & 5) = 4")
def bit_pattern(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size").bitwiseAND(5) == 4).select("p_partkey", "p_size")


@register(views.sql("SELECT 63 - x AS x, 63 - y AS y, value FROM cells"))
def flip_grid(spark, sf_dir):
    return focal.flip(views.cells(table(spark, sf_dir, "lineitem")), 64, 64, True, True)


@register(views.sql("SELECT x, y, value FROM cells WHERE x BETWEEN 8 AND 23 AND y BETWEEN 4 AND 11"))
def clip_region(spark, sf_dir):
    return views.cells(table(spark, sf_dir, "lineitem").where("l_partkey % 64 BETWEEN 8 AND 23 AND l_suppkey % 64 BETWEEN 4 AND 11"))


@register(
    """
    WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity / 40.0 AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN u >= 1 THEN 0 ELSE 1 - u * u END, 6) AS epanechnikov, round(CASE WHEN u >= 1 THEN 0 ELSE (1 - u * u)^2 END, 6) AS bisquare,
           round(CASE WHEN u >= 1 THEN 0 ELSE (1 - u^3)^3 END, 6) AS tricube, round(CASE WHEN u >= 1 THEN 0 ELSE cos(pi() * u / 2) END, 6) AS cosine
    FROM u
    """
)
def time_kernels(spark, sf_dir):
    names = ("epanechnikov", "bisquare", "tricube", "cosine")
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[kernels.time_kernel(F.col("l_quantity") / 40, k).alias(k) for k in names]))


@register(
    """
    WITH c(seg, icept, k1, k2) AS (VALUES ('BUILDING', -1.0, 0.0002, 0.01), ('MACHINERY', 0.5, -0.0001, 0.02))
    SELECT c_custkey, round(1 / (1 + exp(-(icept + k1 * c_acctbal + k2 * c_nationkey))), 6) AS potential FROM customer LEFT JOIN c ON seg = c_mktsegment
    """
)
def logistic_surface(spark, sf_dir):
    k = spark.createDataFrame([("BUILDING", -1.0, 0.0002, 0.01), ("MACHINERY", 0.5, -0.0001, 0.02)], "seg string, icept double, k1 double, k2 double")
    c = table(spark, sf_dir, "customer").join(F.broadcast(k), F.col("seg") == F.col("c_mktsegment"), "left")  # a row per region
    return rounded(c.select("c_custkey", (1 / (1 + F.exp(-(F.col("icept") + F.col("k1") * F.col("c_acctbal") + F.col("k2") * F.col("c_nationkey"))))).alias("potential")))
