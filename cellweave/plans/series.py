"""Queries over series of values per cell."""

from pyspark.sql import functions as F

from cellweave.operators import series
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


def _series(spark, sf_dir):
    return views.series(table(spark, sf_dir, "lineitem"))


@register(
    """
    WITH s AS (
        SELECT l_suppkey, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS icept, corr(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY 1
    )
    SELECT l_suppkey, n, round(CASE WHEN n >= 2 THEN slope END, 4) AS slope, round(CASE WHEN n >= 2 THEN icept END, 4) AS "offset", round(r, 6) AS corr, round(r * r, 6) AS r2
    FROM s
    """
)
def series_regression(spark, sf_dir):
    out = series.regression(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(out.select("l_suppkey", "n", F.round(F.col("slope") + 1e-9, 4).alias("slope"), F.round(F.col("offset") + 1e-9, 4).alias("offset"), "corr", "r2"))


@register(
    """
    WITH s AS (SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) AS bb,
                      sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS by_ FROM lineitem GROUP BY 1)
    SELECT k AS l_suppkey, n, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 2) AS b_l_quantity, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 2) AS b_l_discount FROM s
    """
)
def series_multiple_regression(spark, sf_dir):
    return rounded(series.multiple_regression(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"], "l_extendedprice"), 2)


@register(
    views.sql("""
    SELECT x, y, round(greatest(0, least(40, greatest(10, avg(CASE WHEN v * 0.9 + 2 BETWEEN 5 AND 45 THEN v * 0.9 + 2 END))) - 10), 6) AS gdd FROM series GROUP BY x, y
    """)
)
def growing_degree_days(spark, sf_dir):
    return rounded(series.growing_degree_days(_series(spark, sf_dir), ["x", "y"], "v", baseline=10, cutoff=40, scale=0.9, shift=2, low=5, high=45))


@register(
    """
    WITH r AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS refs, any_value(o_orderkey % 50) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
    s AS (SELECT *, len(refs) AS n, len(list_filter(refs, lambda q: q < v)) AS below, len(list_filter(refs, lambda q: q = v)) AS equal FROM r)
    SELECT l_orderkey, round(CASE WHEN below + equal = 0 THEN -1 WHEN below = n THEN 2 WHEN n = 1 THEN 0.5 WHEN equal > 0 THEN (below + (equal - 1) / 2) / (n - 1)
        ELSE (below - 1 + (v - refs[below]) / (refs[below + 1] - refs[below])) / (n - 1) END, 6) AS q
    FROM s
    """
)
def reference_quantiles(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    refs = l.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("refs")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "refs", (F.col("o_orderkey") % 50).cast("double").alias("v"))
    return rounded(refs.select("l_orderkey", series.reference_quantile(F.col("v"), F.col("refs")).alias("q")))


@register(
    views.sql("""
    WITH p AS (SELECT a.x, a.y, (b.v - a.v) / (b.t - a.t) AS m, sign(b.v - a.v) AS k FROM series a JOIN series b ON a.x = b.x AND a.y = b.y AND b.t > a.t),
    n AS (SELECT x, y, count(*) AS n FROM series GROUP BY ALL),
    s AS (SELECT x, y, list_sort(list(m)) AS m, sum(k) AS k FROM p GROUP BY x, y)
    SELECT x, y, n::INT AS n, round(m[len(m) // 2 + 1], 6) AS slope, k::BIGINT AS mann_kendall FROM s JOIN n USING (x, y)
    """)
)
def theil_sen(spark, sf_dir):
    return rounded(series.theil_sen(_series(spark, sf_dir), ["x", "y"], "t", "v"))


@register(views.sql("SELECT x, y, arg_max(v, t) AS v FROM series WHERE v < 30 GROUP BY x, y"))
def temporal_patch(spark, sf_dir):
    return series.newest(_series(spark, sf_dir).where("v < 30"), ["x", "y"], "t", "v")


@register(
    views.sql("""
    SELECT x, y, t, v, round(avg(v) OVER w, 6) AS moving_mean, round(quantile_cont(v, 0.5) OVER w, 6) AS moving_median
    FROM series WINDOW w AS (PARTITION BY x, y ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
    """)
)
def series_filter(spark, sf_dir):
    return rounded(series.moving(_series(spark, sf_dir), ["x", "y"], "t", "v", 5))


@register(
    views.sql("""
    WITH o AS (SELECT x, y, t, t - lag(t) OVER (PARTITION BY x, y ORDER BY t) AS step FROM series WHERE v >= 25),
    r AS (SELECT *, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER w AS run, sum(CASE WHEN step <= 2 THEN 0 ELSE 1 END) OVER w AS season FROM o WINDOW w AS (PARTITION BY x, y ORDER BY t)),
    c AS (SELECT x, y, season, run, min(t) AS a, max(t) AS b FROM r GROUP BY ALL)
    SELECT x, y, min(a) AS start, max(b) AS "end", max(b - a + 1) AS core FROM c GROUP BY x, y, season HAVING max(b - a + 1) >= 2
    """)
)
def seasons(spark, sf_dir):
    return series.islands(_series(spark, sf_dir), ["x", "y"], "t", "v", 25, max_gap=1, min_length=2)


@register(
    views.sql("SELECT t, round(avg(v), 6) AS mean, round(avg(v) - 2 * coalesce(stddev_samp(v), 0), 6) AS low, round(avg(v) + 2 * coalesce(stddev_samp(v), 0), 6) AS high FROM series GROUP BY t")
)
def line_bands(spark, sf_dir):
    return rounded(series.line_bands(_series(spark, sf_dir), ["t"], "v", 2))


_MONTHLY = """
    WITH m AS (SELECT l_suppkey % 16 AS k, CAST(month(l_shipdate) AS INT) AS month, round(min(l_quantity) - 10, 6) AS tmin, round(max(l_quantity) + avg(l_tax) * 100, 4) AS tmax, round(sum(l_quantity), 2) AS prec FROM lineitem GROUP BY 1, 2),
    a AS (SELECT *, (tmin + tmax) / 2 AS tavg FROM m),
    q AS (SELECT k, (month - 1 - o + 12) % 12 AS q, avg(tavg) AS qt, sum(prec) AS qp FROM a, range(3) r(o) GROUP BY ALL),
    s AS (SELECT k, max(qt) AS bio10, min(qt) AS bio11, max(qp) AS bio16, min(qp) AS bio17 FROM q GROUP BY k),
    y AS (SELECT k, avg(tavg) AS bio1, avg(tmax - tmin) AS bio2, 100 * stddev_samp(tavg) AS bio4, max(tmax) AS bio5, min(tmin) AS bio6, sum(prec) AS bio12, max(prec) AS bio13, min(prec) AS bio14, 100 * stddev_samp(prec) / (1 + avg(prec)) AS bio15 FROM a GROUP BY k)
    SELECT k, """ + ", ".join(f"round(bio{i}, 4) AS bio{i}" for i in (1, 2, 4, 5, 6, 10, 11, 12, 13, 14, 15, 16, 17)) + ", round(bio5 - bio6, 4) AS bio7 FROM y JOIN s USING (k)"


@register(_MONTHLY)
def bioclim(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("k"), F.month("l_shipdate").alias("month")).agg(
        F.round(F.min("l_quantity") - 10 + 1e-9, 6).alias("tmin"), F.round(F.max("l_quantity") + F.avg("l_tax") * 100 + 1e-9, 4).alias("tmax"), F.round(F.sum("l_quantity") + 1e-9, 2).alias("prec")
    )
    return rounded(series.bioclim(m, ["k"]).select("k", *[f"bio{i}" for i in (1, 2, 4, 5, 6, 7, 10, 11, 12, 13, 14, 15, 16, 17)]), 4)
