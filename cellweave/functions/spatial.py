"""Spatial SQL functions: SQL bodies that the planner inlines, so that queries in text stay in generated code.

A point is ``STRUCT<x DOUBLE, y DOUBLE>``; a line is an array of points, a polygon a closed one (its outer ring).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_P, _L = "STRUCT<x: DOUBLE, y: DOUBLE>", "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_EACH = "sequence(1, greatest(size(g), 2) - 1)"
#: Name, arguments, result and body of each function.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "ST_Point": ("px DOUBLE, py DOUBLE", _P, "named_struct('x', px, 'y', py)"),
    "ST_X": (f"p {_P}", "DOUBLE", "p.x"),
    "ST_Y": (f"p {_P}", "DOUBLE", "p.y"),
    "ST_Distance": (f"p {_P}, q {_P}", "DOUBLE", "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"),
    "ST_NumPoints": (f"g {_L}", "INT", "size(g)"),
    "ST_StartPoint": (f"g {_L}", _P, "try_element_at(g, 1)"),
    "ST_EndPoint": (f"g {_L}", _P, "try_element_at(g, -1)"),
    "ST_IsClosed": (f"g {_L}", "BOOLEAN", "try_element_at(g, 1) = try_element_at(g, -1)"),
    "ST_MinX": (f"g {_L}", "DOUBLE", "array_min(transform(g, p -> p.x))"),
    "ST_MaxX": (f"g {_L}", "DOUBLE", "array_max(transform(g, p -> p.x))"),
    "ST_MinY": (f"g {_L}", "DOUBLE", "array_min(transform(g, p -> p.y))"),
    "ST_MaxY": (f"g {_L}", "DOUBLE", "array_max(transform(g, p -> p.y))"),
    "ST_Envelope": (
        f"g {_L}",
        _L,
        "array(named_struct('x', array_min(transform(g, p -> p.x)), 'y', array_min(transform(g, p -> p.y))), named_struct('x', array_max(transform(g, p -> p.x)), 'y', array_min(transform(g, p -> p.y))), "
        "named_struct('x', array_max(transform(g, p -> p.x)), 'y', array_max(transform(g, p -> p.y))), named_struct('x', array_min(transform(g, p -> p.x)), 'y', array_max(transform(g, p -> p.y))), "
        "named_struct('x', array_min(transform(g, p -> p.x)), 'y', array_min(transform(g, p -> p.y))))",
    ),
    "ST_Length": (f"g {_L}", "DOUBLE", f"CASE WHEN size(g) > 1 THEN aggregate({_EACH}, 0D, (s, i) -> s + sqrt(pow(g[i].x - g[i - 1].x, 2) + pow(g[i].y - g[i - 1].y, 2))) ELSE 0D END"),
    "ST_Area": (f"g {_L}", "DOUBLE", f"CASE WHEN size(g) > 3 THEN abs(aggregate({_EACH}, 0D, (s, i) -> s + (g[i - 1].x - g[0].x) * (g[i].y - g[0].y) - (g[i].x - g[0].x) * (g[i - 1].y - g[0].y))) / 2 ELSE 0D END"),
    "ST_Centroid": (
        f"g {_L}",
        _P,
        "CASE WHEN size(g) > 3 THEN transform(array("
        f"aggregate({_EACH}, named_struct('a', 0D, 'x', 0D, 'y', 0D), (s, i) -> named_struct('a', s.a + (g[i - 1].x - g[0].x) * (g[i].y - g[0].y) - (g[i].x - g[0].x) * (g[i - 1].y - g[0].y), "
        "'x', s.x + ((g[i - 1].x - g[0].x) * (g[i].y - g[0].y) - (g[i].x - g[0].x) * (g[i - 1].y - g[0].y)) * (g[i - 1].x + g[i].x - 2 * g[0].x), "
        "'y', s.y + ((g[i - 1].x - g[0].x) * (g[i].y - g[0].y) - (g[i].x - g[0].x) * (g[i - 1].y - g[0].y)) * (g[i - 1].y + g[i].y - 2 * g[0].y)))"
        "), s -> named_struct('x', g[0].x + try_divide(s.x, 3 * s.a), 'y', g[0].y + try_divide(s.y, 3 * s.a)))[0] END",
    ),
    "ST_Contains": (
        f"g {_L}, p {_P}",
        "BOOLEAN",
        f"CASE WHEN g IS NULL OR p IS NULL THEN NULL WHEN size(g) < 4 THEN false ELSE size(filter({_EACH}, i -> (g[i - 1].y > p.y) <> (g[i].y > p.y) "
        "AND p.x < (g[i].x - g[i - 1].x) * (p.y - g[i - 1].y) / CASE WHEN g[i].y = g[i - 1].y THEN 1D ELSE g[i].y - g[i - 1].y END + g[i - 1].x)) % 2 = 1 END",
    ),
    "ST_DWithin": (f"p {_P}, q {_P}, d DOUBLE", "BOOLEAN", "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= d"),
    "ST_EnvIntersects": (
        f"g {_L}, h {_L}",
        "BOOLEAN",
        " AND ".join(f"array_min(transform({a}, p -> p.{c})) <= array_max(transform({b}, p -> p.{c}))" for a, b in (("g", "h"), ("h", "g")) for c in "xy"),
    ),
    "ST_AsText": (
        f"g {_L}",
        "STRING",
        "CASE WHEN g IS NULL THEN NULL WHEN size(g) > 3 AND try_element_at(g, 1) = try_element_at(g, -1) THEN concat('POLYGON ((', array_join(transform(g, p -> concat(CAST(p.x AS STRING), ' ', CAST(p.y AS STRING))), ', '), '))') "
        "ELSE concat('LINESTRING (', array_join(transform(g, p -> concat(CAST(p.x AS STRING), ' ', CAST(p.y AS STRING))), ', '), ')') END",
    ),
    "ST_LineFromText": (
        "t STRING",
        _L,
        "CASE WHEN t IS NULL THEN NULL ELSE transform(split(regexp_extract(upper(t), '^ *(?:LINESTRING|POLYGON) *[(]+([^()]*)[)]+ *$', 1), ' *, *'), s -> "
        "named_struct('x', try_cast(split(trim(s), ' +')[0] AS DOUBLE), 'y', try_cast(get(split(trim(s), ' +'), 1) AS DOUBLE))) END",
    ),
    "ST_Cell": (f"p {_P}, side DOUBLE", "STRUCT<u: BIGINT, v: BIGINT>", "named_struct('u', CAST(floor(p.x / side) AS BIGINT), 'v', CAST(floor(p.y / side) AS BIGINT))"),
}


def register_spatial(spark: SparkSession) -> list[str]:
    """Adds the functions to the session, for use in SQL text and ``expr``; their names. Nulls in give nulls out."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
