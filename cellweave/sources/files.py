"""Text files in and out: CSV with cleaned names, JSON lines, GeoJSON features, and species-with-data tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.tables import clean_cells, clean_names

POINT = "struct<x:double,y:double>"
#: The parts of a GeoJSON feature that are read; properties stay a map of strings.
FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", ints: Sequence[str] = (), reals: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """A CSV file with a header: names are cleaned, cells trimmed, empty rows dropped; columns are text unless they are listed.

    Nothing is inferred, so the file is read once. Cells that are no number become null.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", False).csv(path)
    df = raw.toDF(*clean_names(raw.columns))
    df = clean_cells(df, df.columns)
    df = df.withColumns({c: F.col(c).try_cast("bigint") for c in ints} | {c: F.col(c).try_cast("double") for c in reals})
    return df if limit is None else df.limit(limit)


def write_csv(df: DataFrame, path: str, *, sep: str = ",", null: str = "") -> None:
    """CSV files with a header; lists and structs are written as JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.option("header", True).option("sep", sep).option("nullValue", null).mode("errorifexists").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; broken lines become rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_point_features(spark: SparkSession, path: str) -> DataFrame:
    """Point features, one in a line: ``properties, x, y``. Features of other geometries are left out."""
    f = spark.read.schema(FEATURE).json(path).where("geometry.type = 'Point'")
    xy = F.from_json("geometry.coordinates", "array<double>")
    return f.select("properties", xy[0].alias("x"), xy[1].alias("y"))


def write_point_features(df: DataFrame, path: str, properties: Sequence[str]) -> None:
    """One point feature in a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    df.select(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")).write.mode("errorifexists").json(path)


def esri_to_points(df: DataFrame, column: str) -> DataFrame:
    """Adds the vertices of an Esri geometry's rings or paths, all parts in order, or its point, as an array ``vertices``, and each one's part as ``parts``."""
    g = F.from_json(column, "x double, y double, rings array<array<array<double>>>, paths array<array<array<double>>>")
    every = F.coalesce(g["rings"], g["paths"])
    pairs = F.transform(F.flatten(every), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    part = F.flatten(F.transform(every, lambda p, k: F.transform(p, lambda _: k)))
    point = g["x"].isNotNull()
    return df.withColumns({"vertices": F.coalesce(pairs, F.when(point, F.array(F.struct(g["x"].alias("x"), g["y"].alias("y"))))), "parts": F.coalesce(part, F.when(point, F.array(F.lit(0))))})


def split_by_code(df: DataFrame, code: str, path: str) -> None:
    """One folder of rows per code."""
    df.write.partitionBy(code).mode("errorifexists").parquet(path)


def species_with_data(points: DataFrame, grids: DataFrame, species: str, columns: Sequence[str], missing: float = -9999) -> DataFrame:
    """Species, coordinates and the value of each grid there, nulls as ``missing``."""
    at = points.select(F.col(species).alias("species"), F.floor("x").cast("long").alias("x"), F.floor("y").cast("long").alias("y"))
    g = grids.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *columns)
    return at.join(g, ["x", "y"], "left").select("species", "x", "y", *[F.coalesce(F.col(c).cast("double"), F.lit(float(missing))).alias(c) for c in columns])
