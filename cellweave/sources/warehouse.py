"""Tables in the session's warehouse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def _name(x: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in x.split("."))


def create_table(spark: SparkSession, table: str, columns: Mapping[str, str], *, using: str = "parquet", partitioned: Sequence[str] = (), location: str | None = None, options: Mapping[str, str] | None = None) -> None:
    """Creates a table of the given columns, external if it has a location."""
    body = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    sql = f"CREATE TABLE {_name(table)} ({body}) USING {using}"
    if options:
        sql += " OPTIONS (" + ", ".join(f"'{k}' '{v}'" for k, v in options.items()) + ")"
    if partitioned:
        sql += " PARTITIONED BY (" + ", ".join(f"`{c}`" for c in partitioned) + ")"
    if location:
        sql += f" LOCATION '{location}'"
    spark.sql(sql)


def load(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """Appends rows to a table, or replaces its rows, matching columns by position as an insert does."""
    target = df.sparkSession.table(table)
    df.select(*target.columns).write.insertInto(table, overwrite=overwrite)


def describe(spark: SparkSession, table: str) -> DataFrame:
    """Columns, types and storage of a table."""
    return spark.sql(f"DESCRIBE FORMATTED {_name(table)}")


def find(spark: SparkSession, pattern: str = "*") -> list[str]:
    """Names of the tables that match a pattern."""
    return sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES LIKE '{pattern}'").collect())


def copy_matching(spark: SparkSession, pattern: str, suffix: str) -> list[str]:
    """Copies the tables that match a pattern under new names."""
    done = []
    for t in find(spark, pattern):
        spark.table(t).write.saveAsTable(t + suffix)
        done.append(t + suffix)
    return done
