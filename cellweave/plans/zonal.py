"""Queries of zonal statistics and cross tables."""

from pyspark.sql import functions as F

from cellweave.operators import zonal
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


@register(
    """
    SELECT l_suppkey AS zone, count(l_quantity) AS n, count(*) - count(l_quantity) AS null_cells, count(*) AS cells,
           min(l_quantity) AS min, max(l_quantity) AS max, max(l_quantity) - min(l_quantity) AS range,
           round(avg(l_quantity), 6) AS mean, round(avg(abs(l_quantity)), 6) AS mean_of_abs, round(sum(l_quantity), 6) AS sum, round(sum(abs(l_quantity)), 6) AS sum_abs
    FROM lineitem GROUP BY l_suppkey
    """
)
def zonal_univar(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), F.col("l_quantity").alias("value"))
    return rounded(zonal.univar(cells, ["zone"], "value"))


@register(
    """
    WITH s AS (
        SELECT l_suppkey AS zone, count(v) AS n, sum(v) AS s1, sum(v^2) AS s2, sum(v^3) AS s3, sum(v^4) AS s4
        FROM (SELECT l_suppkey, nullif(l_quantity, 1) AS v FROM lineitem) GROUP BY 1
    ), m AS (
        SELECT *, s1 / n AS mean, CASE WHEN n > 1 THEN greatest((s2 - s1 * s1 / n) / nullif(n - 1, 0), 0) END AS var FROM s WHERE n > 0
    )
    SELECT zone, n, round(var, 6) AS variance, round(sqrt(var), 6) AS stddev, round(100 * sqrt(var) / nullif(mean, 0), 6) AS coeff_var,
           round((s3 / n - 3 * s1 * s2 / (n * n) + 2 * mean^3) / nullif(var^1.5, 0), 6) AS skewness,
           round((s4 / n - 4 * s1 * s3 / (n * n) + 6 * s1 * s1 * s2 / (n^3) - 3 * mean^4) / nullif(var * var, 0) - 3, 6) AS kurtosis
    FROM m
    """
)
def zonal_moments(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), F.nullif("l_quantity", F.lit(1)).alias("value"))
    return rounded(zonal.moments(cells, ["zone"], "value"))


@register(
    """
    SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) AS perc_25, round(quantile_cont(l_extendedprice, 0.5), 6) AS perc_50,
           round(quantile_cont(l_extendedprice, 0.75), 6) AS perc_75, round(quantile_cont(l_extendedprice, 0.9), 6) AS perc_90
    FROM lineitem GROUP BY ALL
    """
)
def zonal_quartiles(spark, sf_dir):
    return rounded(zonal.quartiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", (25, 50, 75, 90)))


@register(
    views.sql("""
    WITH q AS (
        SELECT zone, count(value) AS n, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM zones GROUP BY zone
    ), w AS (SELECT *, greatest(min, q1 - 1.5 * (q3 - q1)) AS lower, least(max, q3 + 1.5 * (q3 - q1)) AS upper FROM q)
    SELECT w.zone, n, round(min, 6) AS min, round(max, 6) AS max, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper,
           round(q2 - 1.57 * (q3 - q1) / sqrt(n), 6) AS notch_low, round(q2 + 1.57 * (q3 - q1) / sqrt(n), 6) AS notch_high,
           (SELECT count(*) FROM zones z WHERE z.zone = w.zone AND (value < lower OR value > upper)) AS outliers
    FROM w
    """)
)
def zonal_boxplot(spark, sf_dir):
    return rounded(zonal.boxplot(views.zones(table(spark, sf_dir, "lineitem")), ["zone"], "value"))


@register(
    """
    WITH c AS (SELECT l_suppkey % 16 AS zone, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1, 2),
    f AS (
        SELECT z.zone, k.class, coalesce(n, 0) AS n FROM (SELECT DISTINCT zone FROM c) z CROSS JOIN (SELECT DISTINCT class FROM c) k LEFT JOIN c ON c.zone = z.zone AND c.class = k.class
    )
    SELECT zone, class, n, round(n / sum(n) OVER (PARTITION BY zone), 4) AS proportion, row_number() OVER (PARTITION BY zone ORDER BY n DESC, class) = 1 AS is_mode FROM f
    """
)
def class_proportions(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("zone"), F.col("l_returnflag").alias("class"))
    return zonal.class_proportions(cells, "zone", "class")


@register(
    """
    WITH c AS (SELECT o_orderpriority AS a, CASE WHEN o_totalprice > 150000 THEN '1-URGENT' ELSE o_orderpriority END AS b FROM orders),
    k AS (SELECT a AS c FROM c UNION SELECT b FROM c),
    m AS (SELECT p.c AS a, q.c AS b, (SELECT count(*) FROM c WHERE c.a = p.c AND c.b = q.c) AS n FROM k p CROSS JOIN k q),
    r AS (SELECT a, sum(n) AS row, sum(CASE WHEN a = b THEN n ELSE 0 END) AS hit FROM m GROUP BY a),
    l AS (SELECT b, sum(n) AS col FROM m GROUP BY b),
    t AS (SELECT sum(hit) AS hits, sum(row) AS total FROM r),
    p AS (SELECT sum(row * col) AS chance FROM r JOIN l ON a = b)
    SELECT a AS class, round(100.0 * hit / nullif(row, 0), 2) AS user_accuracy, round(100 - 100.0 * hit / nullif(row, 0), 2) AS commission,
           round(100.0 * hit / nullif(col, 0), 2) AS producer_accuracy, round(100 - 100.0 * hit / nullif(col, 0), 2) AS omission,
           round(100.0 * hits / total, 2) AS overall_accuracy, round((hits / total - chance / (total * total)) / (1 - chance / (total * total)), 2) AS kappa
    FROM r JOIN l ON a = b, t, p
    """
)
def confusion_accuracies(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("a"), F.when(F.col("o_totalprice") > 150000, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("b"))
    return zonal.accuracies(zonal.confusion(o, "a", "b"))


@register(
    """
    WITH c AS (SELECT CAST(l_linenumber AS INT) AS a, CAST(1 + l_partkey % 7 AS INT) AS b FROM lineitem),
    m AS (SELECT a, b, count(*) AS n FROM c GROUP BY 1, 2),
    r AS (SELECT a, sum(n) AS r FROM m GROUP BY 1), k AS (SELECT b, sum(n) AS k FROM m GROUP BY 1),
    e AS (SELECT sum(abs(a - b)^2 * r * k) AS e FROM r CROSS JOIN k),
    o AS (SELECT sum(abs(a - b)^2 * n) AS o, sum(n) AS t FROM m)
    SELECT round(1 - o * t / e, 6) AS kappa FROM o, e
    """
)
def quadratic_kappa(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("a"), (1 + F.col("l_partkey") % 7).cast("int").alias("b"))
    return rounded(zonal.weighted_kappa(zonal.confusion(c, "a", "b"), 2))


@register(
    """
    WITH b AS (
        SELECT l_returnflag,
               CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity > 45 THEN 9 ELSE greatest(1, CAST(ceil((l_quantity - 5) / 5.0) AS INT)) END AS bin1,
               CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount > 0.08 THEN 4 ELSE greatest(1, CAST(ceil((l_discount - 0.02) / ((0.08 - 0.02) / 3)) AS INT)) END AS bin2
        FROM lineitem
    ), c AS (SELECT l_returnflag, bin1, bin2, count(*) AS n FROM b GROUP BY ALL)
    SELECT l_returnflag, bin1, bin2, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS density FROM c
    """
)
def joint_histogram(spark, sf_dir):
    return rounded(zonal.joint_histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ("l_quantity", 5, 45, 8), ("l_discount", 0.02, 0.08, 3)))


@register(
    """
    WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2),
    p AS (SELECT user_id, v / sum(v) OVER (PARTITION BY user_id) AS p FROM c),
    d AS (SELECT user_id, count(*) AS richness, -sum(p * ln(p)) AS h, sum(p * p) AS s FROM p GROUP BY 1)
    SELECT user_id, richness, round(h, 6) AS shannon, round(exp(h), 6) AS effective_number, round(CASE WHEN richness > 1 THEN h / ln(richness) END, 6) AS evenness,
           round(1 / s, 6) AS inverse_simpson, round(1 - s, 6) AS gini_simpson, round(-ln(s), 6) AS renyi_2
    FROM d
    """
)
def diversity_indices(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("v"))
    return rounded(zonal.diversity(counts, ["user_id"], "v"))


@register(
    views.sql("""
    WITH p AS (SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b, a AS ra, b AS rb FROM bands)
    SELECT round(1 - sum(abs(a - b)) / 2, 6) AS niche_d, round(1 - sum((sqrt(a) - sqrt(b))^2) / 2, 6) AS niche_i, round(corr(ra, rb), 6) AS pearson FROM p
    """)
)
def niche_similarity(spark, sf_dir):
    return rounded(zonal.niche_similarity(views.bands(table(spark, sf_dir, "lineitem")), "a", "b"))


@register(
    """
    WITH m AS (SELECT median(l_quantity) AS a, median(l_quantity) FILTER (l_returnflag = 'A') AS p FROM lineitem),
    d AS (SELECT any_value(a) AS a, any_value(p) AS p, median(abs(l_quantity - a)) AS mad FROM lineitem, m)
    SELECT a AS median_all, p AS median_sample, mad, round(abs(a - p) / nullif(mad, 0), 6) AS bias FROM d
    """
)
def environmental_bias(spark, sf_dir):
    return rounded(zonal.environmental_bias(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_returnflag") == "A"))


@register(
    """
    WITH c AS (SELECT l_suppkey % 10 AS zone, year(l_shipdate) AS d, l_returnflag AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
    e AS (SELECT *, sum(n) OVER (PARTITION BY zone, d) AS nd, sum(n) OVER (PARTITION BY zone, c) AS nc, sum(n) OVER (PARTITION BY zone) AS t FROM c),
    a AS (SELECT zone, max(t) AS t, count(DISTINCT d) AS dates, -sum(n / t * log2(n / nd)) AS h_in, sum(n * n / (nd * nc)) AS q FROM e GROUP BY zone),
    b AS (SELECT zone, -sum(nc / t * log2(nc / t)) AS h_all FROM (SELECT DISTINCT zone, c, nc, t FROM e) GROUP BY zone)
    SELECT zone, dates, round(greatest(0, h_all - h_in), 6) AS gain, round(1 - h_in / nullif(h_all, 0), 6) AS ratio, round(t * (q - 1), 6) AS chi_square FROM a JOIN b USING (zone)
    """
)
def change_information(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("zone"), F.year("l_shipdate").alias("d"), F.col("l_returnflag").alias("c"))
    return rounded(zonal.shift_information(cells, ["zone"], "d", "c"))
