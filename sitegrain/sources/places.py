"""Place and category tables: discovery of columns, pruned scans, compaction, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.config import BoundingBox
from sitegrain.operators.selection import first_by_hash
from sitegrain.operators.subset import in_bbox

# Accepted physical names per canonical column, best first.
PLACE_COLUMNS: dict[str, tuple[str, ...]] = {
    "place_id": ("fsq_place_id", "place_id", "id"),
    "name": ("name",),
    "lat": ("latitude", "lat"),
    "lon": ("longitude", "lon", "lng"),
    "country": ("country", "country_code", "iso_country"),
    "category_ids": ("fsq_category_ids", "category_ids"),
}
PLACE_TYPES = {
    "place_id": "string", "name": "string", "lat": "double", "lon": "double", "country": "string",
    "category_ids": "array<string>",
}
REQUIRED = ("place_id", "name", "lat", "lon")
# Further place columns that filters and profiles look for.
OPTIONAL_COLUMNS = (
    "locality", "region", "postcode", "date_refreshed", "date_closed", "unresolved_flags",
    "fsq_category_labels", "geom", "bbox", "confidence", "confidence_score",
)
# Category columns that are kept.
CATEGORY_COLUMNS = (
    "category_id", "category_name", "category_label", "level1_category_id", "level1_category_name",
    "level2_category_id", "level2_category_name",
)


def read_parquet(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Parquet file, shard folder or list of either. A missing path fails at once."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(*paths)


def resolve_columns(df: DataFrame) -> dict[str, str | None]:
    """Physical column behind each canonical one, ``None`` where the source has none."""
    present = set(df.columns)
    found = {
        target: next((name for name in names if name in present), None)
        for target, names in PLACE_COLUMNS.items()
    }
    missing = [target for target in REQUIRED if found[target] is None]
    if missing:
        raise ValueError(f"places lack required columns {missing}; the source has {df.columns}")
    return found


def canonical_places(df: DataFrame, keep_optional: bool = True) -> DataFrame:
    """Rename a place table to the canonical columns; absent optional ones become typed nulls."""
    found = resolve_columns(df)
    chosen = [
        (F.col(found[t]) if found[t] else F.lit(None)).cast(PLACE_TYPES[t]).alias(t) for t in PLACE_COLUMNS
    ]
    extra = [c for c in OPTIONAL_COLUMNS if keep_optional and c in df.columns]
    return df.select(*chosen, *extra)


def scan_metro(
    df: DataFrame,
    bbox: BoundingBox,
    country: str | None = None,
    max_rows: int = 0,
) -> DataFrame:
    """Pruned scan of one metro. The plain comparisons reach the Parquet reader.

    ``max_rows`` is the prototyping cap of the caller; 0 reads everything.
    """
    found = resolve_columns(df)
    keep: Column = in_bbox(bbox, found["lat"], found["lon"])
    if country and found["country"]:
        keep = keep & (F.col(found["country"]) == F.lit(country))
    rows = canonical_places(df.filter(keep), keep_optional=False)
    return rows.limit(max_rows) if max_rows else rows


def capped_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "place_id", tie: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), spread evenly and the same on every run and in every engine.

    Rows are taken in the order of a seeded MD5 of their id, then of the whole row or ``tie``.
    """
    return first_by_hash(df, n, [id_col], seed, tie)


def compact(spark: SparkSession, source: str | Sequence[str], path: str, target_bytes: int = 256 << 20, recursive: bool = False) -> int:
    """Rewrite shards into files of about ``target_bytes``; returns the number of files.

    The number follows the sizes of the given files, which come with their rows as metadata, so
    nothing is listed twice and many small or a few huge shards end up alike.
    """
    rows = read_parquet(spark, source, recursive)
    sizes = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    files = max(1, -(-total // target_bytes))
    rows.repartition(files).write.mode("overwrite").parquet(path)
    return files


def clean_categories(df: DataFrame) -> DataFrame:
    """Kept columns with one row per category id: the smallest row, so reruns agree."""
    rest = [c for c in CATEGORY_COLUMNS[1:] if c in df.columns]
    picked = df.groupBy("category_id").agg(F.min(F.struct(*rest)).alias("row"))
    return picked.select("category_id", *[F.col(f"row.{c}").alias(c) for c in rest])
