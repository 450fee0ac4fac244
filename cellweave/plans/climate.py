"""Queries of radiation, evaporation, humidity and growth."""

from pyspark.sql import functions as F

from cellweave.functions import climate, formulas
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


def _bands(spark, sf_dir):
    return views.bands(table(spark, sf_dir, "lineitem"))


@register(
    views.sql("""
    WITH r AS (SELECT x, y, x::DOUBLE AS lat, (1 + y * 5) AS doy, 273.15 + a AS k, d / 10 AS tsw, c / 20 AS albedo FROM bands),
    g AS (SELECT *, 0.4093 * sin(2 * pi() * doy / 365 - 1.39) AS tilt, 1 + 0.01672 * sin(2 * pi() * (doy - 93.5) / 365) AS reach FROM r),
    w AS (SELECT *, acos(CASE WHEN -tan(radians(lat)) * tan(tilt) BETWEEN -1 AND 1 THEN -tan(radians(lat)) * tan(tilt) END) AS ws FROM g),
    s AS (SELECT *, (ws * sin(tilt) * sin(radians(lat)) + cos(tilt) * cos(radians(lat)) * sin(ws)) * 1367 * tsw / (pi() * reach * reach) AS solar FROM w)
    SELECT x, y, round(solar, 4) AS solar, round((1 - albedo) * solar - 110 * tsw, 4) AS net,
           round(((1 - albedo) * solar - 110 * tsw) * 86400000 / ((2.501 - 0.002361 * (k - 273.15)) * 1e9), 5) AS evaporation FROM s
    """)
)
def potential_evaporation(spark, sf_dir):
    b = _bands(spark, sf_dir).select("x", "y", F.col("x").cast("double").alias("lat"), (1 + F.col("y") * 5).alias("doy"), (273.15 + F.col("a")).alias("k"), (F.col("d") / 10).alias("tsw"), (F.col("c") / 20).alias("albedo"))
    b = b.withColumn("solar", climate.daily_solar(F.col("lat"), F.col("doy"), F.col("tsw"))).withColumn("net", climate.net_radiation(F.col("albedo"), F.col("solar"), F.col("tsw")))
    out = b.select("x", "y", "solar", "net", climate.potential_evaporation(F.col("net"), F.col("k")).alias("evaporation"))
    return rounded(out.withColumns({"solar": F.round(F.col("solar") + 1e-9, 4), "net": F.round(F.col("net") + 1e-9, 4)}), 5)


@register(
    views.sql("""
    SELECT x, y, round(0.61078 * exp(17.2694 * a / (a + 237.3)), 6) AS saturation, round(exp(ln(0.002) + (ln(3.0 / 7) - ln(0.002)) / (0.8 - 0.02) * (c / 10 - 0.02)), 6) AS roughness,
           round(greatest(1, least(13, -321.147 + 1.095 * (273.15 + a))), 6) AS gap, round(greatest(0, least(1, (310 - (273.15 + a)) / (310 - 280))), 6) AS fraction,
           CASE WHEN c / 60 < 0.1 AND d / 40 < 0.1 THEN 1 ELSE 0 END AS water
    FROM bands
    """)
)
def surface_exchange(spark, sf_dir):
    a, c, d = F.col("a"), F.col("c"), F.col("d")
    return rounded(
        _bands(spark, sf_dir).select(
            "x",
            "y",
            climate.saturation_pressure(a).alias("saturation"),
            climate.roughness(c / 10, 0.8, 3.0).alias("roughness"),
            climate.temperature_gap(273.15 + a).alias("gap"),
            climate.evaporative_fraction(273.15 + a, 310, 280).alias("fraction"),
            climate.open_water(c / 60, d / 40).alias("water"),
        )
    )


@register("SELECT p_partkey FROM part WHERE (p_size >> 2) & 3 IN (1, 2)")
def quality_bits(spark, sf_dir):
    return table(spark, sf_dir, "part").where(climate.quality_bits(F.col("p_size"), 2, 2, [1, 2])).select("p_partkey")


@register(
    """
    WITH RECURSIVE g(s_suppkey, n, t) AS (SELECT s_suppkey, (1 + s_suppkey % 50)::DOUBLE, 0 FROM supplier UNION ALL SELECT s_suppkey, n * exp(0.3 * (1 - n / 40)), t + 1 FROM g WHERE t < 5)
    SELECT s_suppkey, round((1 + s_suppkey % 50) * exp(0.1 * 5), 5) AS unlimited, round(n, 5) AS crowded FROM g WHERE t = 5
    """
)
def population_growth(spark, sf_dir):
    n = 1 + F.col("s_suppkey") % 50
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", formulas.exponential_growth(n, 0.1, 5).alias("unlimited"), formulas.ricker_growth(n, 0.3, 40, 5).alias("crowded")), 5)


@register("SELECT p_partkey, round(p_size * ((1 - power(1.04, -20)) / 0.04) - p_retailprice, 4) AS value, round(1 + 2 * p_size + 0.5 * p_size * p_size, 4) AS calibrated FROM part")
def present_value(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return rounded(p.select("p_partkey", formulas.net_present_value(F.col("p_retailprice"), F.col("p_size"), 0.04, 20).alias("value"), formulas.polynomial(F.col("p_size"), (1, 2, 0.5)).alias("calibrated")), 4)
