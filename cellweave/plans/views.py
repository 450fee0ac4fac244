"""Grids, series and points derived from the tables, each in Spark and, by the same name, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQL = {
    "cells": "SELECT l_partkey % 64 AS x, l_suppkey % 64 AS y, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2",
    "bands": "SELECT l_partkey % 64 AS x, l_suppkey % 64 AS y, round(avg(l_quantity), 6) AS a, round(avg(l_extendedprice) / 1000, 6) AS b, round(avg(l_discount) * 100, 6) AS c, round(avg(l_tax) * 100, 6) AS d FROM lineitem GROUP BY 1, 2",
    "zones": "SELECT x, y, value, CAST(floor(x / 8.0) * 8 + floor(y / 8.0) AS INT) AS zone FROM cells",
    "classes": "SELECT x, y, CAST(floor(value / 10.0) AS INT) AS class FROM cells",
    "series": "SELECT l_partkey % 8 AS x, l_suppkey % 8 AS y, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS t, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2, 3",
    "points": "SELECT event_id, user_id, ts, value, user_id % 64 AS x, event_id % 64 AS y FROM events",
}


def sql(body: str) -> str:
    """``body`` behind the views that it may name."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in SQL.items()) + (",\n" + body.strip()[5:] if body.strip()[:5].upper() == "WITH " else "\n" + body)


def cells(lineitem: DataFrame) -> DataFrame:
    """One value for each cell of a 64 x 64 grid."""
    return lineitem.groupBy((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).agg(F.round(F.avg("l_quantity") + 1e-9, 6).alias("value"))


def bands(lineitem: DataFrame) -> DataFrame:
    """Four co-registered values for each cell."""
    mean = lambda c, k, n: F.round((F.avg(c) * k if k > 1 else F.avg(c)) + 1e-9, 6).alias(n)
    return lineitem.groupBy((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).agg(
        mean("l_quantity", 1, "a"), F.round(F.avg("l_extendedprice") / 1000 + 1e-9, 6).alias("b"), mean("l_discount", 100, "c"), mean("l_tax", 100, "d")
    )


def zones(lineitem: DataFrame) -> DataFrame:
    """Cells with their 8 x 8 block as zone."""
    return cells(lineitem).withColumn("zone", (F.floor(F.col("x") / 8) * 8 + F.floor(F.col("y") / 8)).cast("int"))


def classes(lineitem: DataFrame) -> DataFrame:
    """Cells with a class instead of a value."""
    return cells(lineitem).select("x", "y", F.floor(F.col("value") / 10).cast("int").alias("class"))


def series(lineitem: DataFrame) -> DataFrame:
    """A value per quarter for each cell of an 8 x 8 grid."""
    return lineitem.groupBy(
        (F.col("l_partkey") % 8).alias("x"), (F.col("l_suppkey") % 8).alias("y"), ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")).alias("t")
    ).agg(F.round(F.avg("l_quantity") + 1e-9, 6).alias("v"))


def points(events: DataFrame) -> DataFrame:
    """Observations with a time and a place."""
    return events.select("event_id", "user_id", "ts", "value", (F.col("user_id") % 64).alias("x"), (F.col("event_id") % 64).alias("y"))
