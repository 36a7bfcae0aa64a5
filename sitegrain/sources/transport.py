"""Public-transport points from CSV and GeoJSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.sources.feature_lines import read_feature_lines

POINT_SCHEMA = "kind string, source string, lat double, lon double, name string"

# Lower-cased header names accepted per field, best first.
LAT_NAMES = ("latitude", "lat", "y")
LON_NAMES = ("longitude", "lon", "long", "x")
ENTRANCE_NAME_NAMES = ("station", "stationname", "station_name", "name")
FACILITY_NAME_NAMES = ("location", "locationname", "stop_name", "name")
FACILITY_KIND_NAMES = ("modename", "mode", "transportmode", "locationtype")


def _pick(df: DataFrame, names: tuple[str, ...]) -> str | None:
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[n] for n in names if n in by_lower), None)


def _text(df: DataFrame, names: tuple[str, ...], default: str | None = None) -> Column:
    hit = _pick(df, names)
    return (F.col(f"`{hit}`") if hit else F.lit(default)).cast("string")


def points_from_table(
    df: DataFrame,
    source: str,
    kind: str | None = None,
    name_names: tuple[str, ...] = ENTRANCE_NAME_NAMES,
    kind_names: tuple[str, ...] = FACILITY_KIND_NAMES,
) -> DataFrame:
    """Points from a table whose header is only roughly known. Unusable coordinates drop out."""
    lat, lon = _pick(df, LAT_NAMES), _pick(df, LON_NAMES)
    if lat is None or lon is None:
        raise ValueError(f"no coordinate columns among {df.columns}")
    rows = df.select(
        (F.lit(kind) if kind else _text(df, kind_names, "facility")).alias("kind"),
        F.lit(source).alias("source"),
        F.col(f"`{lat}`").cast("string").try_cast("double").alias("lat"),
        F.col(f"`{lon}`").cast("string").try_cast("double").alias("lon"),
        _text(df, name_names).alias("name"),
    )
    return rows.dropna(subset=["lat", "lon"])


def read_points_csv(spark: SparkSession, path: str, source: str, kind: str | None = None, **names) -> DataFrame:
    """CSV points; every column is read as text, so odd cells only cost their own row."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    return points_from_table(df, source, kind, **names)


FEATURES = (
    "features array<struct<geometry:struct<coordinates:string>,properties:map<string,string>>>"
)


def points_from_features(df: DataFrame, source: str, kind: str) -> DataFrame:
    """Points of GeoJSON features; malformed geometries drop out."""
    return points_of(df.select(F.explode("features").alias("f")), source, kind)


def points_of(each: DataFrame, source: str, kind: str) -> DataFrame:
    """The same for a table of single features ``f``."""
    pair = F.from_json(F.col("f.geometry.coordinates"), "array<string>")
    rows = each.select(
        F.lit(kind).alias("kind"),
        F.lit(source).alias("source"),
        F.try_element_at(pair, F.lit(2)).try_cast("double").alias("lat"),
        F.try_element_at(pair, F.lit(1)).try_cast("double").alias("lon"),
        # Properties that may hold a name, best first.
        F.coalesce(
            *[F.nullif(F.col("f.properties")[c], F.lit("")) for c in ("LOCATION", "Name", "name")]
        ).alias("name"),
    )
    return rows.dropna(subset=["lat", "lon"])


def read_points_geojson(spark: SparkSession, path: str, source: str, kind: str = "bus_shelter") -> DataFrame:
    """Point features of GeoJSON files (each file is one document, so files are the unit of work)."""
    raw = (
        spark.read.schema(FEATURES)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .json(path)
    )
    return points_from_features(raw, source, kind)


def read_point_lines(spark: SparkSession, path: str, source: str, kind: str = "bus_shelter") -> tuple[DataFrame, DataFrame]:
    """(points, rejected lines) of newline-delimited features: a file is split over many tasks."""
    good, rejects = read_feature_lines(spark, path)
    return points_of(good, source, kind), rejects


def combine_points(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns a source lacks become nulls."""
    if not frames:
        raise ValueError("no point tables; use empty_points(spark)")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.dropna(subset=["lat", "lon"])


def empty_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POINT_SCHEMA)
