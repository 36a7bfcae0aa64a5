"""Row filters that carve a market out of a place table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.config import AUSTRALIA, SYDNEY, BoundingBox

# Flags that mark an invalid place.
BAD_FLAGS = ("duplicate", "delete", "privatevenue", "doesnt_exist")


def in_bbox(bbox: BoundingBox, lat: str = "lat", lon: str = "lon") -> Column:
    """Inclusive box test as plain comparisons, which Parquet can push down."""
    return F.col(lat).between(bbox.min_lat, bbox.max_lat) & F.col(lon).between(bbox.min_lon, bbox.max_lon)


def bbox_filter(df: DataFrame, bbox: BoundingBox) -> DataFrame:
    return df.filter(in_bbox(bbox))


def country_filter(
    df: DataFrame,
    code: str,
    bbox: BoundingBox = AUSTRALIA,
    ignore_case: bool = False,
    column: str = "country",
) -> DataFrame:
    """Rows of one country; a table without a country column is cut by the box instead."""
    if column not in df.columns:
        return bbox_filter(df, bbox)
    if ignore_case:
        return df.filter(F.upper(F.col(column).cast("string")) == F.lit(code.upper()))
    return df.filter(F.col(column) == F.lit(code))


def metro_filter(df: DataFrame, country: str, bbox: BoundingBox) -> DataFrame:
    return df.filter((F.col("country") == F.lit(country)) & in_bbox(bbox))


def open_only(df: DataFrame) -> DataFrame:
    """Places without a closing date, when the table knows one."""
    return df.filter(F.col("date_closed").isNull()) if "date_closed" in df.columns else df


def has_bad_flag(df: DataFrame, bad: Sequence[str] = BAD_FLAGS) -> Column:
    """True where the flags (text or list of texts) mention a bad one; false for no flags."""
    column = F.col("unresolved_flags")
    kind = df.schema["unresolved_flags"].dataType.typeName()
    text = F.concat_ws("|", column) if kind == "array" else column.cast("string")
    hit = F.lit(False)
    for flag in bad:
        hit = hit | text.contains(flag)
    return F.coalesce(hit, F.lit(False))


def drop_flagged(df: DataFrame, bad: Sequence[str] = BAD_FLAGS, keep_null: bool = True) -> DataFrame:
    """Remove invalid places. Unflagged rows stay unless ``keep_null`` is off."""
    if "unresolved_flags" not in df.columns:
        return df
    kept = ~has_bad_flag(df, bad)
    return df.filter(kept if keep_null else kept & F.col("unresolved_flags").isNotNull())


STRATEGIES = ("auto", "locality", "region_localities", "bbox")


def city_subset(
    df: DataFrame,
    city: str = "Sydney",
    strategy: str = "auto",
    localities: Sequence[str] = (),
    region: str = "NSW",
    bbox: BoundingBox = SYDNEY,
) -> DataFrame:
    """Rows of one city by locality name, by region plus a locality list, or by box.

    ``auto`` takes the first way whose columns the table has; with a locality list and a
    region column that is the region way.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "auto":
        if "locality" not in df.columns:
            strategy = "bbox"
        else:
            strategy = "region_localities" if localities and "region" in df.columns else "locality"
    if strategy == "locality":
        return df.filter(F.col("locality") == F.lit(city))
    if strategy == "region_localities":
        names = sorted({city, *localities})
        return df.filter((F.col("region") == F.lit(region)) & F.col("locality").isin(names))
    return bbox_filter(df, bbox)


def picked(df: DataFrame, ids: Sequence[str], column: str = "area_id") -> DataFrame:
    """Rows of a hand-picked set of areas."""
    return df.filter(F.col(column).isin(list(ids)))


def picked_from(df: DataFrame, picks: DataFrame, column: str = "area_id") -> DataFrame:
    """Rows whose id is in another table of any size."""
    return df.join(picks.select(column), column, "left_semi")
