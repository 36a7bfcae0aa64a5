"""Region polygons: GeoJSON or Parquet in, ``(code, name, region_order, edges, box)`` out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.geometry import all_edges
from sitegrain.sources.feature_lines import read_feature_lines

RINGS = "array<array<struct<x:double,y:double>>>"
_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def regions_from_features(df: DataFrame, code_field: str, name_field: str, numeric_code: bool = True) -> DataFrame:
    """Polygon and multipolygon features as ``code, name, region_order, rings, ring_parts``.

    Features without a shape, and codes that should be numbers but are not, drop out.
    ``region_order`` is the position in the file: the first polygon wins where two overlap.
    """
    each = df.select(F.posexplode("features").alias("region_order", "f"))
    return regions_of(each, code_field, name_field, numeric_code)


def regions_of(each: DataFrame, code_field: str, name_field: str, numeric_code: bool = True) -> DataFrame:
    """The same for a table of single features, ``region_order, f``.

    ``rings`` lists the rings of all parts, ``ring_parts`` the part of each, from 0. A part's
    first ring is its outline, the others its holes.
    """
    shape = F.col("f.geometry.type")
    text = F.col("f.geometry.coordinates")
    polygon = F.array(F.from_json(F.when(shape == "Polygon", text), "array<array<array<double>>>"))
    multi = F.from_json(F.when(shape == "MultiPolygon", text), "array<array<array<array<double>>>>")
    parts = F.when(shape == "Polygon", F.when(polygon[0].isNotNull(), polygon)).when(shape == "MultiPolygon", multi)
    code = F.col("f.properties")[code_field]
    rows = each.select(
        (F.trim(code).try_cast("bigint") if numeric_code else code).alias("code"),
        F.col("f.properties")[name_field].alias("name"),
        F.col("region_order").cast("bigint").alias("region_order"),
        parts.alias("parts"),
    )
    known = rows.filter(F.col("code").isNotNull() & F.col("parts").isNotNull())
    ring = F.transform(F.flatten("parts"), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    part = F.flatten(F.transform("parts", lambda p, i: F.transform(p, lambda _: i)))
    return known.select("code", "name", "region_order", ring.alias("rings"), part.alias("ring_parts"))


def read_region_lines(
    spark: SparkSession, path: str, code_field: str, name_field: str, numeric_code: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(regions, rejected lines) of newline-delimited features; ``region_order`` rises along each file."""
    good, rejects = read_feature_lines(spark, path)
    each = good.select(F.col("line").alias("region_order"), "f")
    return regions_of(each, code_field, name_field, numeric_code), rejects


def read_regions_geojson(
    spark: SparkSession, path: str, code_field: str, name_field: str, numeric_code: bool = True
) -> DataFrame:
    raw = spark.read.schema(_FEATURES).option("multiLine", "true").json(path)
    return regions_from_features(raw, code_field, name_field, numeric_code)


def indexed_regions(regions: DataFrame) -> DataFrame:
    """Regions with their edge list and bounding box, ready for the spatial operators.

    A region without a shape gets a null box, which no spatial operator matches.
    """
    edges = regions.withColumn("edges", all_edges(F.col("rings")))
    xs = F.transform("edges", lambda e: e["x1"])
    ys = F.transform("edges", lambda e: e["y1"])
    return edges.select(
        "code",
        "name",
        "region_order",
        "edges",
        F.array_min(xs).alias("min_x"),
        F.array_max(xs).alias("max_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(ys).alias("max_y"),
    )
