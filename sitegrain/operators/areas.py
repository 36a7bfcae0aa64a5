"""Area units: hexagonal cells or localities, and per-area place and category counts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.hexgrid import cell_center, edge_km, key_to_id, on_globe, with_hex_key
from sitegrain.functions.numbers import POSITION_DIGITS, steady_mean
from sitegrain.operators.ranking import full_rank
from sitegrain.operators.roles import explode_ids


@dataclass(frozen=True)
class AreaUnit:
    """What an area is. The key is what data is grouped by, the label the id shown for it."""

    kind: str = "hex"
    resolution: int = 8
    column: str = "locality"

    def __post_init__(self) -> None:
        if self.kind not in ("hex", "locality"):
            raise ValueError(f"unknown area unit {self.kind!r}")
        if self.kind == "hex":
            edge_km(self.resolution)

    def with_key(self, df: DataFrame, out: str = "area_key") -> DataFrame:
        if self.kind == "hex":
            return with_hex_key(df, self.resolution, out)
        if self.column not in df.columns:
            raise ValueError(f"locality areas need the column {self.column!r}")
        return df.withColumn(out, F.col(self.column).cast("string"))

    def label(self, key: Column) -> Column:
        return key_to_id(key, self.resolution) if self.kind == "hex" else key


HEX8 = AreaUnit()


def with_area_key(df: DataFrame, unit: AreaUnit = HEX8) -> DataFrame:
    """``area_key`` per row. Rows without usable coordinates are in no cell and drop out."""
    return unit.with_key(df.filter(on_globe()) if unit.kind == "hex" else df)


def with_area(df: DataFrame, unit: AreaUnit = HEX8) -> DataFrame:
    """``area_id`` per row, null where the coordinates give no cell."""
    keyed = unit.with_key(df, "_area_key")
    return keyed.withColumn("area_id", unit.label(F.col("_area_key"))).drop("_area_key")


def with_centers(df: DataFrame) -> DataFrame:
    """``lat`` and ``lon`` of each area: its mean position when known, else the middle of its cell."""
    if {"lat", "lon"} <= set(df.columns):
        return df
    if {"lat_mean", "lon_mean"} <= set(df.columns):
        return df.withColumnsRenamed({"lat_mean": "lat", "lon_mean": "lon"})
    lat, lon = cell_center(F.col("area_id"))
    return df.withColumns({"lat": lat, "lon": lon})


def mean_position() -> list[Column]:
    """Aggregates for the mean place position of an area."""
    return [steady_mean(F.col(c), POSITION_DIGITS).alias(f"{c}_mean") for c in ("lat", "lon")]


class CellCounts(NamedTuple):
    areas: DataFrame
    area_category_counts: DataFrame
    area_pois: DataFrame


def cell_counts(places: DataFrame, unit: AreaUnit = HEX8) -> CellCounts:
    """Place count and centre per area, category counts per area, and the exploded rows.

    ``areas`` and ``area_category_counts`` fold map-side, so a crowded cell costs one
    partial row per task.
    """
    keyed = with_area_key(places, unit)
    label = unit.label(F.col("area_key")).alias("area_id")
    areas = (
        keyed.groupBy("area_key")
        .agg(F.count(F.lit(1)).alias("poi_count"), *mean_position())
        .select(label, "poi_count", "lat_mean", "lon_mean")
    )
    exploded = explode_ids(keyed.select("area_key", "place_id", "name", "lat", "lon", "category_ids"))
    counts = (
        exploded.filter(F.col("category_id").isNotNull())
        .groupBy("area_key", "category_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(label, "category_id", "cnt")
    )
    pois = exploded.select(label, "place_id", "name", "lat", "lon", "category_id")
    return CellCounts(areas, counts, pois)


def sum_categories(counts: DataFrame, ids: DataFrame, out_col: str) -> DataFrame:
    """Total count per area over a set of categories.

    Areas without a hit are absent, except that an empty set gives every area a 0.
    """
    wanted = ids.select("category_id").distinct().withColumn("_in", F.lit(True))
    empty = ids.agg((F.count(F.lit(1)) == 0).alias("empty")).scalar()
    hit = F.coalesce(F.col("_in"), F.lit(False))
    totals = (
        counts.join(wanted, "category_id", "left")
        .groupBy("area_id")
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("cnt"))), F.lit(0)).alias(out_col),
            F.bool_or(hit).alias("_hit"),
        )
    )
    return totals.filter(F.col("_hit") | empty).drop("_hit")


def category_ordinals(places: DataFrame) -> DataFrame:
    """(category_id, ordinal from 1) of every id that a place lists, known to the category table or not."""
    ids = explode_ids(places.select("category_ids")).filter(F.col("category_id").isNotNull()).distinct()
    return full_rank(ids, [F.col("category_id").asc()], out="ordinal")


def category_bitmaps(
    places: DataFrame, ordinals: DataFrame, unit: AreaUnit = HEX8, group_cols: tuple[str, ...] = ()
) -> DataFrame:
    """(area_id, groups, bucket, categories): which categories an area has, as bitmaps of 32,768 ordinals.

    Bits are set map-side, so a crowded area sends one bitmap per task. Bitmaps merge: see ``distinct_categories``.
    """
    rows = explode_ids(with_area_key(places, unit).select("area_key", *group_cols, "category_ids"))
    placed = rows.filter(F.col("category_id").isNotNull()).join(ordinals, "category_id")
    return (
        placed.groupBy("area_key", *group_cols, F.bitmap_bucket_number("ordinal").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("categories"))
        .select(unit.label(F.col("area_key")).alias("area_id"), *group_cols, "bucket", "categories")
    )


def distinct_categories(bitmaps: DataFrame, by: tuple[str, ...] = ("area_id",), out: str = "distinct_category_count") -> DataFrame:
    """Number of different categories per group, merged from bitmaps of finer groups; places are not read again."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("categories").alias("categories"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("categories")).alias(out))
