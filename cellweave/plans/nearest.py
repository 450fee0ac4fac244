"""Queries of nearest points and interpolation from them."""

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import nearest
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table

#: A place for each customer, spread over 64 by 64 by 64, with a value.
_STATIONS = "SELECT c_custkey AS id, (c_custkey * 7919 % 6400) / 100.0::DOUBLE AS x, (c_custkey * 6007 % 6397) / 100.0::DOUBLE AS y, (c_custkey * 31 % 6389) / 100.0::DOUBLE AS z, c_acctbal::DOUBLE AS value FROM customer"


def _stations(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (k * 7919 % 6400 / 100).alias("x"), (k * 6007 % 6397 / 100).alias("y"), (k * 31 % 6389 / 100).alias("z"), F.col("c_acctbal").cast("double").alias("value")
    )


def _cells(spark, sf_dir):
    return views.cells(table(spark, sf_dir, "lineitem"))


def _brute(targets, keys, k, apart):
    return f"""
    WITH p AS ({_STATIONS}), cells AS ({views.SQL["cells"]}), t AS ({targets}),
    m AS (SELECT {keys}, p.id, p.value, {apart} AS d2, row_number() OVER (PARTITION BY {keys} ORDER BY sqrt({apart}), p.id) AS k FROM t CROSS JOIN p QUALIFY k <= {k})"""


_FLAT = "(t.x - p.x)^2 + (t.y - p.y)^2"


@register(_brute("SELECT x, y FROM cells", "t.x, t.y", 6, _FLAT) + " SELECT x, y, CAST(k AS INT) AS rank, id, round(sqrt(d2), 6) AS distance, round(value, 4) AS value FROM m")
def k_nearest(spark, sf_dir):
    return rounded(nearest.k_nearest(_cells(spark, sf_dir).select("x", "y"), _stations(spark, sf_dir), 6, ["x", "y"], "id", columns=["value"]))


@register(
    _brute("SELECT x, y FROM cells", "t.x, t.y", 6, _FLAT)
    + " SELECT x, y, round(coalesce(avg(value) FILTER (d2 = 0), sum(value / nullif(d2, 0)) / sum(1 / nullif(d2, 0))), 4) AS value FROM m GROUP BY x, y"
)
def inverse_distance(spark, sf_dir):
    return rounded(nearest.inverse_distance(_cells(spark, sf_dir).select("x", "y"), _stations(spark, sf_dir), "value", 6), 4)


@register(
    _brute("SELECT x, y, z FROM cells, (VALUES (8), (24), (40), (56)) v(z)", "t.x, t.y, t.z", 4, _FLAT + " + (t.z - p.z)^2")
    + " SELECT x, y, z, round(coalesce(avg(value) FILTER (d2 = 0), sum(value / nullif(d2, 0)) / sum(1 / nullif(d2, 0))), 4) AS value FROM m GROUP BY x, y, z"
)
def volume_inverse_distance(spark, sf_dir):
    t = _cells(spark, sf_dir).select("x", "y", F.explode(F.array(*map(F.lit, (8, 24, 40, 56)))).alias("z"))
    return rounded(nearest.inverse_distance(t, _stations(spark, sf_dir), "value", 4, ("x", "y", "z"), at=("x", "y", "z")), 4)


@register(
    f"""
    WITH p AS ({_STATIONS}), s AS (SELECT floor(x / 0.5)::BIGINT AS u, floor(y / 0.5)::BIGINT AS v, value FROM p),
    m AS (SELECT 0.5 * sqrt((a.u - b.u)^2 + (a.v - b.v)^2) AS d, (a.value - b.value)^2 / 2 AS g FROM (SELECT *, row_number() OVER () AS r FROM s) a JOIN (SELECT *, row_number() OVER () AS r FROM s) b ON a.r < b.r)
    SELECT CAST(floor(d / 1.5) AS INT) AS bin, count(*)::BIGINT AS pairs, round(sum(d) / count(*), 6) AS distance, round(sum(g) / count(*) / 1e6, 4) AS gamma FROM m WHERE d < 15 GROUP BY 1
    """
)
def variogram(spark, sf_dir):
    return rounded(nearest.variogram(_stations(spark, sf_dir), "value", 0.5, 1.5, 10).withColumn("gamma", F.round(F.col("gamma") / 1e6 + 1e-9, 4)))


@register()
def kriging(spark, sf_dir):
    p = _stations(spark, sf_dir)
    bins = [(r["pairs"], r["distance"], r["gamma"]) for r in nearest.variogram(p, "value", 0.5, 1.5, 10).orderBy("bin").collect()]  # ten rows
    model = nearest.fit_spherical(bins, np.linspace(2.0, 30.0, 57).tolist())
    return rounded(nearest.krige(_cells(spark, sf_dir).select("x", "y"), p, "value", model, 8), 3)
