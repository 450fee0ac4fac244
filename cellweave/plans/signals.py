"""Queries of wavelets, fuzzy systems, surfaces from areas and spatial SQL."""

import math

from pyspark.sql import functions as F

from cellweave.functions import fuzzy, wavelets
from cellweave.functions.spatial import register_spatial
from cellweave.operators import areal
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table


def _series(spark, sf_dir):
    """The values of each cell's series, in order of time."""
    s = views.series(table(spark, sf_dir, "lineitem"))
    return s.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s")).select("x", "y", F.transform("s", lambda r: r["v"]).alias("s"))


def _taps(taps):
    return " + ".join(f"{f!r} * e[1 + (2 * i + {k}) % len(e)]" for k, f in enumerate(taps))


_LOW = wavelets.low_pass("d4")


@register(
    views.sql(f"""
    WITH l AS (SELECT x, y, list(v ORDER BY t) AS s FROM series GROUP BY x, y), e AS (SELECT x, y, CASE WHEN len(s) % 2 = 1 THEN list_append(s, s[-1]) ELSE s END AS e FROM l),
    i AS (SELECT x, y, e, unnest(range(0, len(e) // 2)) AS i FROM e)
    SELECT x, y, CAST(i AS INT) AS i, round({_taps(_LOW)}, 6) AS approximation, round({_taps(wavelets.high_pass(_LOW))}, 6) AS detail FROM i
    """)
)
def wavelet_level(spark, sf_dir):
    parts = _series(spark, sf_dir).select("x", "y", wavelets.decomposed(F.col("s"), "d4", 1).alias("w"))
    both = parts.select("x", "y", F.posexplode(F.arrays_zip(F.col("w.approximation").alias("a"), F.col("w.details")[0].alias("d"))).alias("i", "p"))
    return rounded(both.select("x", "y", "i", F.col("p.a").alias("approximation"), F.col("p.d").alias("detail")))


#: Through three levels and back, nothing is lost, whatever the lengths.
@register(views.sql("SELECT x, y, t::INT AS t, round(v, 6) AS v FROM (SELECT x, y, row_number() OVER (PARTITION BY x, y ORDER BY t) AS t, v FROM series)"))
def wavelet_round_trip(spark, sf_dir):
    back = _series(spark, sf_dir).select("x", "y", wavelets.recomposed(wavelets.decomposed(F.col("s"), "d6", 3), "d6", 3).alias("s"))
    return rounded(back.select("x", "y", F.posexplode("s").alias("t", "v")).withColumn("t", F.col("t") + 1))


_RULES = [(("and", ("a", "high"), ("not", ("b", "high"))), "good"), (("or", ("a", "low"), ("b", "high")), "poor"), (("b", "low"), "good")]
_OUTPUT = {"good": ((40.0, 80.0), "left", "linear"), "poor": ((20.0, 60.0), "right", "linear")}


def _ramp(v, a, b):
    return f"least(greatest(({v} - {a}) / ({b} - {a}), 0), 1)"


@register(
    views.sql(f"""
    WITH m AS (SELECT x, y, {_ramp("a", 20.0, 30.0)} AS a_high, 1 - {_ramp("a", 18.0, 26.0)} AS a_low, {_ramp("b", 30.0, 50.0)} AS b_high, 1 - {_ramp("b", 28.0, 40.0)} AS b_low FROM bands),
    r AS (SELECT x, y, greatest(least(a_high, 1 - b_high), b_low) AS good, greatest(a_low, b_high) AS poor FROM m),
    p AS (SELECT x, y, i * 5.0::DOUBLE AS v, greatest(least(good, {_ramp("i * 5.0::DOUBLE", 40.0, 80.0)}), least(poor, 1 - {_ramp("i * 5.0::DOUBLE", 20.0, 60.0)})) AS h FROM r, range(0, 21) k(i))
    SELECT x, y, round(sum(v * h) / nullif(sum(h), 0), 6) AS suitability FROM p GROUP BY x, y
    """)
)
def fuzzy_system(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    sets = {
        "a": {"high": fuzzy.membership(a, (20.0, 30.0), "left", "linear"), "low": fuzzy.membership(a, (18.0, 26.0), "right", "linear")},
        "b": {"high": fuzzy.membership(b, (30.0, 50.0), "left", "linear"), "low": fuzzy.membership(b, (28.0, 40.0), "right", "linear")},
    }
    return rounded(views.bands(table(spark, sf_dir, "lineitem")).select("x", "y", fuzzy.fuzzy_system(_RULES, sets, _OUTPUT, 0.0, 100.0, 20).alias("suitability")))


_ROUNDS = 4
_MASS = "".join(
    f""",
    m{k} AS MATERIALIZED (SELECT c.x, c.y, c.zone, greatest(coalesce(avg(n.value), any_value(c.value)), 0) AS m FROM s{k} c LEFT JOIN s{k} n ON abs(c.x - n.x) + abs(c.y - n.y) = 1 GROUP BY ALL),
    f{k} AS (SELECT zone, sum(m) AS s FROM m{k} GROUP BY zone),
    s{k + 1} AS MATERIALIZED (SELECT x, y, m{k}.zone, CASE WHEN s <> 0 AND t / nullif(s, 0) >= 0 THEN m * (t / nullif(s, 0)) ELSE t / n END AS value FROM m{k} JOIN f{k} ON f{k}.zone = m{k}.zone JOIN a ON a.zone = m{k}.zone)"""
    for k in range(_ROUNDS)
)


@register(
    views.sql(
        """
    WITH t AS (SELECT CAST(c_custkey % 64 AS INT) AS zone, sum(c_acctbal)::DOUBLE AS t FROM customer GROUP BY 1),
    a AS MATERIALIZED (SELECT zone, any_value(t) AS t, count(*) AS n FROM zones JOIN t USING (zone) GROUP BY zone),
    s0 AS MATERIALIZED (SELECT x, y, zone, t / n AS value FROM zones JOIN a USING (zone))"""
        + _MASS
        + f" SELECT x, y, zone, round(value, 4) AS value FROM s{_ROUNDS}"
    )
)
def mass_surface(spark, sf_dir):
    totals = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 64).cast("int").alias("zone")).agg(F.sum(F.col("c_acctbal").cast("decimal(38,2)")).cast("double").alias("t"))
    return rounded(areal.mass_preserving(views.zones(table(spark, sf_dir, "lineitem")).select("x", "y", "zone"), "zone", totals, "t", _ROUNDS), 4)


_DIAMONDS = """
    SELECT s_suppkey, cx, cy, r, array(ST_Point(cx + r, cy), ST_Point(cx, cy + r), ST_Point(cx - r, cy), ST_Point(cx, cy - r), ST_Point(cx + r, cy)) AS g
    FROM (SELECT s_suppkey, CAST(s_suppkey * 7 % 56 + 4 AS DOUBLE) AS cx, CAST(s_nationkey * 2 + 6 AS DOUBLE) AS cy, CAST(s_suppkey % 3 + 1 AS DOUBLE) AS r FROM {supplier})"""


def _sql(spark, sf_dir, text, **tables):
    register_spatial(spark)
    return spark.sql(text, **{k: table(spark, sf_dir, k) for k in tables.pop("of")}, **tables)


@register(
    f"""
    WITH d AS (SELECT s_suppkey, (s_suppkey * 7 % 56 + 4)::DOUBLE AS cx, (s_nationkey * 2 + 6)::DOUBLE AS cy, (s_suppkey % 3 + 1)::DOUBLE AS r FROM supplier)
    SELECT s_suppkey, round(2 * r * r, 6) AS area, round(4 * r * {math.sqrt(2)!r}, 6) AS length, round(cx, 6) AS mx, round(cy, 6) AS my, round(4 * r * r, 6) AS envelope, round(sqrt(cx * cx + cy * cy), 6) AS away, true AS closed, 5 AS points FROM d
    """
)
def spatial_measures(spark, sf_dir):
    text = f"""
    SELECT s_suppkey, ST_Area(g) AS area, ST_Length(g) AS length, ST_Centroid(g).x AS mx, ST_Y(ST_Centroid(g)) AS my, ST_Area(ST_Envelope(ST_LineFromText(ST_AsText(g)))) AS envelope,
           ST_Distance(ST_Centroid(g), ST_Point(0D, 0D)) AS away, ST_IsClosed(g) AS closed, ST_NumPoints(g) AS points FROM ({_DIAMONDS})"""
    return rounded(_sql(spark, sf_dir, text, of=["supplier"]))


@register(
    views.sql("""
    WITH d AS (SELECT s_suppkey, s_suppkey * 7 % 56 + 4 AS cx, s_nationkey * 2 + 6 AS cy, s_suppkey % 3 + 1 AS r FROM supplier), p AS (SELECT event_id, value, x + 0.31 AS x, y + 0.17 AS y FROM points)
    SELECT s_suppkey, count(*) AS n, round(sum(value), 4) AS total FROM p JOIN d ON abs(p.x - cx) + abs(p.y - cy) < r GROUP BY 1
    """)
)
def spatial_join(spark, sf_dir):
    """Squares of eight bring places and shapes together, each with all its points and areas; the rest is one SQL text."""
    text = f"""
    WITH d AS ({_DIAMONDS}),
    e AS (SELECT g, ST_Cell(ST_Point(ST_MinX(g), ST_MinY(g)), 8D) AS low, ST_Cell(ST_Point(ST_MaxX(g), ST_MaxY(g)), 8D) AS high FROM (SELECT DISTINCT g FROM d)),
    a AS (SELECT *, explode(sequence(low.u, high.u)) AS u FROM e), b AS (SELECT *, explode(sequence(low.v, high.v)) AS v FROM a),
    q AS (SELECT q, count(*) AS n, sum(value) AS total FROM (SELECT value, ST_Point(user_id % 64 + 0.31D, event_id % 64 + 0.17D) AS q FROM {{events}}) GROUP BY q),
    p AS (SELECT *, ST_Cell(q, 8D) AS c FROM q),
    s AS (SELECT g, sum(n) AS n, sum(total) AS total FROM p JOIN b ON b.u = c.u AND b.v = c.v WHERE ST_Contains(g, q) GROUP BY g)
    SELECT s_suppkey, sum(n) AS n, sum(total) AS total FROM d JOIN s USING (g) GROUP BY s_suppkey"""
    return rounded(_sql(spark, sf_dir, text, of=["supplier", "events"]), 4)
