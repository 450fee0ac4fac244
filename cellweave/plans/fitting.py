"""Queries of fitted curves and class statistics."""

from pyspark.sql import functions as F

from cellweave.operators import fitting
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


@register(
    """
    WITH l AS (SELECT l_suppkey % 10 AS region, CAST(year(l_shipdate) AS INT) AS year, l_quantity FROM lineitem),
    o AS (SELECT region, year, sum(l_quantity) AS pop, (count(*) + 20 * (year - 1994))::DOUBLE AS dev FROM l WHERE year <= 1999 GROUP BY region, year),
    p AS (SELECT region, year, sum(l_quantity) AS pop FROM l WHERE year >= 1999 GROUP BY region, year),
    f AS (SELECT region, count(*) AS n, arg_max(dev / pop, year) AS density, regr_slope(dev, pop) AS ls, regr_intercept(dev, pop) AS lb, regr_slope(dev, ln(pop)) AS gs, regr_intercept(dev, ln(pop)) AS gb,
                 regr_slope(ln(dev), pop) AS es, regr_intercept(ln(dev), pop) AS eb FROM o GROUP BY 1),
    e AS (SELECT region, sqrt(sum((dev - (lb + ls * pop))^2) / (max(n) - 2)) AS lr, sqrt(sum((dev - greatest(0, gb + gs * ln(pop)))^2) / (max(n) - 2)) AS gr, sqrt(sum((dev - exp(eb + es * pop))^2) / (max(n) - 2)) AS er FROM o JOIN f USING (region) GROUP BY 1),
    c AS (SELECT *, CASE least(lr, gr, er) WHEN er THEN 'exponential' WHEN lr THEN 'linear' ELSE 'logarithmic' END AS m FROM f JOIN e USING (region)),
    v AS (SELECT region, year, CASE WHEN CASE m WHEN 'linear' THEN ls WHEN 'logarithmic' THEN gs ELSE es END >= 0 THEN m ELSE 'density' END AS method, pop, c.* EXCLUDE (region) FROM p JOIN c USING (region)),
    x AS (SELECT region, year, method, CASE method WHEN 'linear' THEN lb + ls * pop WHEN 'logarithmic' THEN greatest(0, gb + gs * ln(pop)) WHEN 'exponential' THEN exp(eb + es * pop) ELSE density * pop END AS projected FROM v)
    SELECT region, year, method, round(projected, 3) AS projected, round(greatest(0, projected - lag(projected) OVER (PARTITION BY region ORDER BY year)), 3) AS demand FROM x
    """
)
def demand_projection(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumns({"region": F.col("l_suppkey") % 10, "year": F.year("l_shipdate")})
    observed = l.where("year <= 1999").groupBy("region", "year").agg(F.sum("l_quantity").alias("pop"), (F.count(F.lit(1)) + 20 * (F.col("year") - 1994)).cast("double").alias("dev"))
    projected = l.where("year >= 1999").groupBy("region", "year").agg(F.sum("l_quantity").alias("pop"))
    out = fitting.project_demand(observed, projected, "region", "year", "pop", "dev")
    # the first year has no growth: the larger of nothing and 0 is 0 in either engine
    return rounded(out, 3)


@register()
def harmonic_series(spark, sf_dir):
    return rounded(fitting.harmonics(views.series(table(spark, sf_dir, "lineitem")), ["x", "y"], "t", "v", 4, 2), 4)


@register(
    views.sql("""
    SELECT x, y, t, v, round(coalesce((-3 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 17 * v + 12 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w) / 35, v), 5) AS smooth
    FROM series WINDOW w AS (PARTITION BY x, y ORDER BY t)
    """)
)
def polynomial_smoothing(spark, sf_dir):
    out = fitting.polynomial_smoothing(views.series(table(spark, sf_dir, "lineitem")), ["x", "y"], "t", "v", 5, 2)
    return out.withColumn("smooth", F.round(F.col("smooth") + 1e-9, 5))


@register(
    views.sql("""
    WITH p AS (SELECT a.x, a.y, a.t, a.v, (b.t - a.t)::DOUBLE AS d, (1 - (abs(b.t - a.t) / 4)^3)^3 AS w, b.v AS z FROM series a JOIN series b ON a.x = b.x AND a.y = b.y AND abs(a.t - b.t) <= 3),
    s AS (SELECT x, y, t, v, sum(w) AS w, sum(w * d) AS sx, sum(w * z) AS sy, sum(w * d * d) AS xx, sum(w * d * z) AS xy FROM p GROUP BY ALL)
    SELECT x, y, t, v, round(CASE WHEN abs(w * xx - sx * sx) > 1e-9 THEN (sy * xx - sx * xy) / (w * xx - sx * sx) ELSE sy / w END, 5) AS smooth FROM s
    """)
)
def local_regression(spark, sf_dir):
    out = fitting.local_regression(views.series(table(spark, sf_dir, "lineitem")), ["x", "y"], "t", "v", 3)
    return out.withColumn("smooth", F.round(F.col("smooth") + 1e-9, 5))


@register(
    """
    WITH l AS (UNPIVOT (SELECT l_returnflag = 'A' AS first, l_quantity, l_tax FROM lineitem WHERE l_returnflag IN ('A', 'N')) ON l_quantity, l_tax INTO NAME feature VALUE v),
    m AS (SELECT feature, count(v) FILTER (first) AS n_a, avg(v) FILTER (first) AS mean_a, stddev_samp(v) FILTER (first) AS stddev_a, count(v) FILTER (NOT first) AS n_b, avg(v) FILTER (NOT first) AS mean_b, stddev_samp(v) FILTER (NOT first) AS stddev_b FROM l GROUP BY 1),
    h AS (SELECT feature, v, count(*) FILTER (first) AS na, count(*) FILTER (NOT first) AS nb FROM l GROUP BY 1, 2),
    k AS (SELECT feature, abs(sum(na) OVER w / sum(na) OVER t - sum(nb) OVER w / sum(nb) OVER t) AS g FROM h WINDOW w AS (PARTITION BY feature ORDER BY v), t AS (PARTITION BY feature))
    SELECT feature, n_a, round(mean_a, 5) AS mean_a, round(stddev_a, 5) AS stddev_a, n_b, round(mean_b, 5) AS mean_b, round(stddev_b, 5) AS stddev_b, round(max(g), 6) AS ks,
           round((mean_a - mean_b) / sqrt(stddev_a^2 / n_a + stddev_b^2 / n_b), 4) AS t
    FROM m JOIN k USING (feature) GROUP BY ALL
    """
)
def class_statistics(spark, sf_dir):
    out = fitting.class_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "N", ["l_quantity", "l_tax"])
    digits = {"mean_a": 5, "stddev_a": 5, "mean_b": 5, "stddev_b": 5, "ks": 6, "t": 4}
    return out.withColumns({c: F.round(F.col(c) + 1e-9, n) for c, n in digits.items()})


@register(
    f"""
    WITH RECURSIVE cells AS ({views.SQL["cells"]}), classes AS ({views.SQL["classes"]}),
    f(x, y, class) USING KEY (x, y) AS (
        SELECT x, y, class FROM classes WHERE class <> 2
        UNION SELECT x, y, class FROM (
            SELECT c.x, c.y, n.class, count(*) AS votes FROM classes c JOIN recurring.f n ON n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1
            WHERE c.class = 2 AND NOT EXISTS (SELECT 1 FROM recurring.f o WHERE o.x = c.x AND o.y = c.y) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY votes DESC, class) = 1)
    SELECT c.x, c.y, coalesce(f.class, 2) AS class FROM classes c LEFT JOIN f ON f.x = c.x AND f.y = c.y
    """
)
def fill_category(spark, sf_dir):
    return fitting.fill_category(views.classes(table(spark, sf_dir, "lineitem")), "class", 2)
