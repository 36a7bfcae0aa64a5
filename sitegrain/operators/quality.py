"""Place-level and area-level data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.config import QualityPenalties
from sitegrain.functions.numbers import QUALITY_DIGITS, clamp01, steady_mean


def quality_score(
    columns: Sequence[str],
    penalties: QualityPenalties = QualityPenalties(),
    category_col: str = "category_id",
) -> Column:
    """1 minus a penalty per gap, limited to [0, 1]. Columns the table lacks cost nothing."""
    have = set(columns)

    def charge(amount: float, gap: Column) -> Column:
        return F.when(gap, F.lit(amount)).otherwise(F.lit(0.0))

    score = F.lit(1.0)
    if {"lat", "lon"} <= have:
        score = score - charge(penalties.missing_coords, F.col("lat").isNull() | F.col("lon").isNull())
    if "name" in have:
        score = score - charge(penalties.missing_name, F.col("name").isNull())
    if category_col in have:
        score = score - charge(penalties.missing_category, F.col(category_col).isNull())
    if "unresolved_flags" in have:
        score = score - charge(penalties.unresolved_flag, F.col("unresolved_flags").isNotNull())
    return clamp01(score)


def poi_quality(
    df: DataFrame, penalties: QualityPenalties = QualityPenalties(), category_col: str = "category_id"
) -> DataFrame:
    return df.withColumn("data_quality_score", quality_score(df.columns, penalties, category_col))


def area_quality(rows: DataFrame, area_col: str = "area_id") -> DataFrame:
    """Mean score per area over the rows given (exploded rows weigh a place by its categories)."""
    if "data_quality_score" not in rows.columns:
        rows = poi_quality(rows)
    return rows.groupBy(area_col).agg(
        steady_mean(F.col("data_quality_score"), QUALITY_DIGITS).alias("data_quality_score")
    )
