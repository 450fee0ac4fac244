"""The registered queries: ``QUERIES[name](spark, sf_dir)`` and, by the same name, ``ORACLE_SQL``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Added before rounding, as engines differ on which way a decimal tie in binary goes.
NUDGE = 1e-9
#: Digits to which values are rounded to be compared, where the nudge would decide.
COMPARED = 9


def nudged(sql: str) -> str:
    """``round(x, n)`` becomes ``round(x + NUDGE, n)``, but not where it rounds to ``COMPARED`` digits, which only comparisons do."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, k = 1, None, start + 6
        while depth:
            c = sql[k]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = k
            k += 1
        inner = nudged(sql[start + 6 : comma])
        digits = sql[comma + 1 : k - 1].strip()
        out += f"{sql[at:start]}round({inner}, {digits})" if int(digits) >= COMPARED else f"{sql[at:start]}round(({inner}) + {NUDGE}, {digits})"
        at = k
    return out + sql[at:]


def register(sql: str | None = None):
    """Put the decorated ``(spark, sf_dir)`` function into the catalog under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = nudged(sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as the last bits of a sum depend on the order of rows; minus zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{c}`") + NUDGE, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


for _part in ("zonal", "tables", "cellwise", "series", "temporal", "focal", "decision", "graph", "terrain", "vector", "climate", "fitting", "learning", "convert", "surface", "sites", "flood", "nearest", "horizon", "regions", "networks", "edges", "signals", "rough"):
    importlib.import_module(f"cellweave.plans.{_part}")
