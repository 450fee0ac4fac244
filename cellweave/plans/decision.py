"""Queries of decision methods, similarity and evaluation."""

from pyspark.sql import functions as F

from cellweave.operators import decision
from cellweave.plans.catalog import register, rounded, table

_P = {"p_size": 2.0, "p_retailprice": 1.0}


@register(
    """
    WITH n AS (SELECT sqrt(sum(p_size::DOUBLE^2)) AS a, sqrt(sum(p_retailprice^2)) AS b FROM part),
    v AS (SELECT p_partkey, p_size / a * 2 / 3 AS s, p_retailprice / b / 3 AS p FROM part, n),
    m AS (SELECT *, max(s) OVER () AS sb, min(s) OVER () AS sw, min(p) OVER () AS pb, max(p) OVER () AS pw FROM v)
    SELECT p_partkey, round(sqrt((s - sw)^2 + (p - pw)^2) / (sqrt((s - sw)^2 + (p - pw)^2) + sqrt((s - sb)^2 + (p - pb)^2)), 6) AS closeness FROM m
    """
)
def topsis(spark, sf_dir):
    return rounded(decision.topsis(table(spark, sf_dir, "part"), "p_partkey", _P, ["p_retailprice"]))


@register(
    """
    WITH p AS (SELECT a.p_partkey, sum(greatest(a.p_size - b.p_size, 0) * 2 / 3.0 + greatest(a.p_retailprice - b.p_retailprice, 0) / 3.0) / 2 AS up,
                      sum(greatest(b.p_size - a.p_size, 0) * 2 / 3.0 + greatest(b.p_retailprice - a.p_retailprice, 0) / 3.0) / 2 AS down FROM part a CROSS JOIN part b GROUP BY 1)
    SELECT p_partkey, round(up, 2) AS positive, round(down, 2) AS negative, round(up - down, 2) AS net FROM p
    """
)
def promethee(spark, sf_dir):
    return rounded(decision.promethee(table(spark, sf_dir, "part"), "p_partkey", _P), 2)


@register(
    """
    WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN a.s_acctbal >= b.s_acctbal THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN a.s_nationkey >= b.s_nationkey THEN 0.25::DOUBLE ELSE 0 END AS c,
                      greatest(b.s_acctbal - a.s_acctbal, b.s_nationkey - a.s_nationkey, 0) AS d FROM supplier a CROSS JOIN supplier b)
    SELECT k AS s_suppkey, round(sum(c), 4) AS concordance, round(sum(d), 2) AS discordance FROM (SELECT a AS k, c, -d AS d FROM p UNION ALL SELECT b, -c, d FROM p) GROUP BY k
    """
)
def electre(spark, sf_dir):
    out = decision.electre(table(spark, sf_dir, "supplier"), "s_suppkey", {"s_acctbal": 3.0, "s_nationkey": 1.0})
    return rounded(out.select("s_suppkey", F.round(F.col("concordance") + 1e-9, 4).alias("concordance"), F.round(F.col("discordance") + 1e-9, 2).alias("discordance")))


@register("SELECT p_partkey, round((p_size * 2 + p_retailprice) / 3, 6) AS score FROM part")
def weighted_sum(spark, sf_dir):
    return rounded(decision.weighted_sum(table(spark, sf_dir, "part"), "p_partkey", _P))


@register(
    """
    WITH RECURSIVE r(k, a, b, c, s) AS (
        SELECT 0, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 3.0::DOUBLE
        UNION ALL SELECT k + 1, u / (u + v + w), v / (u + v + w), w / (u + v + w), u + v + w
        FROM (SELECT k, a + 3 * b + 5 * c AS u, a / 3 + b + 2 * c AS v, a / 5 + b / 2 + c AS w FROM r WHERE k < 60)),
    e AS (SELECT * FROM r WHERE k = 60), n AS (SELECT unnest(['c0', 'c1', 'c2']) AS criterion, unnest([a, b, c]) AS w, (s - 3) / 2 / 0.58 AS ratio FROM e)
    SELECT criterion, round(w, 6) AS weight, round(ratio, 6) AS consistency_ratio FROM n
    """
)
def hierarchy_weights(spark, sf_dir):
    weights, ratio = decision.comparison_weights([[1, 3, 5], [1 / 3, 1, 2], [1 / 5, 1 / 2, 1]])
    return rounded(spark.createDataFrame([(f"c{i}", w, ratio) for i, w in enumerate(weights)], "criterion string, weight double, consistency_ratio double"))


@register(
    """
    WITH r AS (SELECT p_size AS q, p_retailprice AS d FROM part WHERE p_partkey % 3 = 0),
    v AS (SELECT p_partkey AS id, p_size + 1 AS q, p_retailprice AS d FROM part),
    t AS (SELECT count(*) AS n, min(q) AS ql, max(q) AS qh, min(d) AS dl, max(d) AS dh FROM r),
    f AS (SELECT v.*, t.*, 100.0 * (SELECT count(*) FROM r WHERE r.q < v.q) / n AS fq, 100.0 * (SELECT count(*) FROM r WHERE r.d < v.d) / n AS fd FROM v, t),
    s AS (SELECT id,
        CASE WHEN fq = 0 THEN 100 * (q - ql) / (qh - ql) WHEN fq <= 50 THEN 2 * fq WHEN fq < 100 THEN 2 * (100 - fq) ELSE 100 * (qh - q) / (qh - ql) END AS a,
        CASE WHEN fd = 0 THEN 100 * (d - dl) / (dh - dl) WHEN fd <= 50 THEN 2 * fd WHEN fd < 100 THEN 2 * (100 - fd) ELSE 100 * (dh - d) / (dh - dl) END AS b FROM f)
    SELECT id, round(a, 4) AS mess_q, round(b, 4) AS mess_d, round(least(a, b), 4) AS mess FROM s
    """
)
def environmental_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ref = p.where("p_partkey % 3 = 0").select(F.col("p_size").alias("q"), F.col("p_retailprice").alias("d"))
    new = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).alias("q"), F.col("p_retailprice").alias("d"))
    return rounded(decision.environmental_similarity(ref, new, "id", ["q", "d"]), 4)


@register(
    """
    WITH r AS (SELECT l_quantity AS q, l_tax AS t FROM lineitem WHERE l_returnflag = 'A'),
    s AS (SELECT avg(q) AS mq, avg(t) AS mt, min(q) AS ql, max(q) AS qh, min(t) AS tl, max(t) AS th, covar_samp(q, q) AS qq, covar_samp(q, t) AS qt, covar_samp(t, t) AS tt FROM r),
    m AS (SELECT max(((q - mq)^2 * tt - 2 * (q - mq) * (t - mt) * qt + (t - mt)^2 * qq) / (qq * tt - qt * qt)) AS m FROM r, s),
    n AS (SELECT l_orderkey * 10 + l_linenumber AS id, least(l_quantity * 1.1 - ql, qh - l_quantity * 1.1, 0) / (qh - ql) + least(l_tax - tl, th - l_tax, 0) / (th - tl) AS nt1,
          sqrt(((l_quantity * 1.1 - mq)^2 * tt - 2 * (l_quantity * 1.1 - mq) * (l_tax - mt) * qt + (l_tax - mt)^2 * qq) / (qq * tt - qt * qt) / m) AS nt2 FROM lineitem, s, m)
    SELECT id, round(nt1, 5) AS nt1, round(nt2, 5) AS nt2, round(CASE WHEN nt1 < 0 THEN nt1 ELSE nt2 END, 5) AS novelty FROM n
    """
)
def environmental_novelty(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    ref = l.where("l_returnflag = 'A'").select(F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    new = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 1.1).alias("q"), F.col("l_tax").alias("t"))
    return rounded(decision.novelty(ref, new, "id", ["q", "t"]), 5)


@register("SELECT 'l_quantity' AS variable, round(1 / (1 - corr(l_quantity, l_extendedprice)^2), 4) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', round(1 / (1 - corr(l_quantity, l_extendedprice)^2), 4) FROM lineitem")
def variance_inflation(spark, sf_dir):
    got = decision.variance_inflation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(spark.createDataFrame(sorted(got.items()), "variable string, vif double"), 4)


@register(
    """
    WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, l_extendedprice AS s FROM lineitem), r AS (SELECT min(s) AS lo, max(s) AS hi FROM d),
    b AS (SELECT least(19, floor((hi - s) * 20 / (hi - lo)))::INT AS bin, any_value(lo) AS lo, any_value(hi) AS hi, sum(t) AS p, sum(1 - t) AS q FROM d, r GROUP BY 1),
    c AS (SELECT bin, hi - (bin + 1) * (hi - lo) / 20 AS threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM b WINDOW w AS (ORDER BY bin)),
    e AS (SELECT *, tp / np AS tpr, fp / nn AS fpr, nn - fp AS tn, np - tp AS fn FROM c)
    SELECT bin, round(threshold, 4) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) AS tss,
           round(2.0 * (tp * tn - fn * fp) / nullif((tp + fp) * nn + np * (tn + fn), 0), 6) AS kappa, round(sqrt((1 - tpr)^2 + fpr^2), 6) AS distance,
           round(sum((fpr - coalesce(lagf, 0)) * (tpr + coalesce(lagt, 0)) / 2) OVER (ORDER BY bin), 6) AS auc_to_here
    FROM (SELECT *, lag(fpr) OVER (ORDER BY bin) AS lagf, lag(tpr) OVER (ORDER BY bin) AS lagt FROM e)
    """
)
def evaluation_curve(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t"), F.col("l_extendedprice").alias("s"))
    out = decision.evaluation_curve(l, "t", "s", 20)
    return rounded(out.withColumn("threshold", F.round(F.col("threshold") + 1e-9, 4)))
