"""Writers for rankings, reports and map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def z_order(lat: Column, lon: Column, bits: int = 16) -> Column:
    """Position on a curve that keeps near points near: the interleaved bits of both coordinates. Null without a place."""

    def cell(value: Column, low: float, span: float) -> Column:
        return F.least(F.greatest(F.floor((value - low) / span * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint")

    def apart(value: Column) -> Column:
        """Binary digits read as digits to the base four: every bit at twice its place."""
        return F.conv(F.bin(value), 4, 10).cast("bigint")

    y, x = cell(lat, -90.0, 180.0), cell(lon, -180.0, 360.0)
    out = apart(x) + apart(y) * 2
    return F.when(lat.isNotNull() & lon.isNotNull(), out)


def write_clustered(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), lat: str = "lat", lon: str = "lon", files: int | None = None
) -> None:
    """Parquet whose row groups are compact on the map, so that a box filter skips most of them by their ranges.

    Rows are dealt by ranges of partition columns, curve position and, within one position, a hash
    of the whole row, so a crowded spot or partition spreads over several tasks and files. Only the
    partitions that ``df`` holds are replaced.
    """
    order = [*[F.col(c) for c in partition_by], F.col("_z")]
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("_z", z_order(F.col(lat), F.col(lon))).withColumn("_row", whole)
    dealt = keyed.repartitionByRange(files, *order, "_row") if files else keyed.repartitionByRange(*order, "_row")
    writer = dealt.sortWithinPartitions(*order).drop("_z", "_row").write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_top_csv(df: DataFrame, path: str, n: int, order: Sequence[Column | str]) -> None:
    """The first ``n`` rows of an order as one CSV file with a header."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report table that is small by construction (picked areas, one row per metro)."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def geometry_json(rings: Column, ring_parts: Column | None = None) -> Column:
    """Rings as the text of a GeoJSON geometry: a polygon, or a multipolygon where rings are of several parts."""
    pairs = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(pairs), F.lit("}"))
    if ring_parts is None:
        return polygon
    numbers = F.array_sort(F.array_distinct(ring_parts))
    of_part = F.zip_with(pairs, ring_parts, lambda ring, part: F.struct(ring.alias("ring"), part.alias("part")))
    nested = F.transform(
        numbers, lambda n: F.transform(F.filter(of_part, lambda r: r["part"] == n), lambda r: r["ring"])
    )
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(nested), F.lit("}"))
    return F.when(F.size(numbers) > 1, multi).otherwise(polygon)


def features(df: DataFrame, properties: Sequence[str], rings: str = "rings", ring_parts: str = "ring_parts") -> DataFrame:
    """One GeoJSON Feature per row; null properties stay visible as nulls, null rings give a null geometry."""
    parts = F.col(ring_parts) if ring_parts in df.columns else None
    named = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    shape = F.coalesce(geometry_json(F.col(rings), parts), F.lit("null"))
    return df.select(
        F.concat(F.lit('{"type":"Feature","properties":'), named, F.lit(',"geometry":'), shape, F.lit("}")).alias("value")
    )


def write_geojson_lines(df: DataFrame, path: str, properties: Sequence[str], rings: str = "rings") -> None:
    """Newline-delimited features: every task writes its own part, nothing is gathered."""
    features(df, properties, rings).write.mode("overwrite").text(path)
