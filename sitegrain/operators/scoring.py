"""Normalisation and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.config import LightWeights, Weights
from sitegrain.functions.numbers import scale01


def scaled(
    df: DataFrame, columns: Mapping[str, str], by: str | None = None, over: Column | None = None
) -> DataFrame:
    """Add min-max scaled copies (``{new: source}``) of columns.

    All ranges come from one aggregate that reaches the rows as a scalar subquery: one row,
    or with ``by`` one map entry per group. ``by`` is for groups listed in the settings
    (templates, metros), never for data keys. ``over`` limits the rows that set the ranges.
    The input is read twice, so hand in a table that is cheap to read.
    """
    inputs = sorted(set(columns.values()))
    base = df if over is None else df.filter(over)
    ranges = F.struct(
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(inputs)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(inputs)],
    )
    if by is None:
        stats = base.agg(ranges.alias("r")).scalar()
    else:
        per_group = base.groupBy(by).agg(ranges.alias("r"))
        stats = per_group.agg(F.map_from_entries(F.collect_list(F.struct(by, "r"))).alias("m")).scalar()
    tagged = df.withColumn("_range", stats)
    own = F.col("_range") if by is None else F.try_element_at(F.col("_range"), F.col(by))
    if by is not None:
        tagged = tagged.withColumn("_range", own)
    place = {c: i for i, c in enumerate(inputs)}
    return tagged.withColumns(
        {
            new: scale01(F.col(c), F.col(f"_range.lo{place[c]}"), F.col(f"_range.hi{place[c]}"))
            for new, c in columns.items()
        }
    ).drop("_range")


# Score parts in output order: (part column, normalised input, weight field, sign).
PARTS: tuple[tuple[str, str, str, float], ...] = (
    ("score_complementarity", "n_complementarity", "complementarity", 1.0),
    ("score_activity", "n_activity", "commercial_activity", 1.0),
    ("score_diversity", "n_diversity", "diversity", 1.0),
    ("score_competition", "n_competition", "direct_competition", -1.0),
    ("score_saturation", "n_saturation", "saturation", -1.0),
    ("score_quality", "n_quality", "data_quality", 1.0),
    ("score_transit_access", "n_transit", "transit_access", 1.0),
    ("score_market_fit", "n_market_fit", "market_fit", 1.0),
    ("score_rent_affordability", "n_rent_affordability", "rent_affordability", 1.0),
)
_LOGS = {
    "commercial_activity_log": "commercial_activity_proxy",
    "diversity_log": "unique_category_count",
    "competition_log": "competitor_density_proxy",
    "saturation_log": "saturation_proxy",
}
_INPUTS = {
    "n_complementarity": "complementarity_ratio",
    "n_activity": "commercial_activity_log",
    "n_diversity": "diversity_log",
    "n_competition": "competition_log",
    "n_saturation": "saturation_log",
    "n_quality": "mean_data_quality_score",
}
_OPTIONAL = {
    "n_transit": "transit_access_score",
    "n_market_fit": "market_fit_score",
    "n_rent_affordability": "rent_affordability_score",
}


def _weight(weights: Weights | Mapping[str, Weights], field: str, by: str | None) -> Column:
    """A literal, or one literal per group chosen by the group column."""
    if isinstance(weights, Weights):
        return F.lit(float(getattr(weights, field)))
    chosen = F.lit(None).cast("double")
    for group, w in weights.items():
        chosen = F.when(F.col(by) == F.lit(group), F.lit(float(getattr(w, field)))).otherwise(chosen)
    return chosen


def opportunity(
    features: DataFrame,
    weights: Weights | Mapping[str, Weights] = Weights(),
    by: str | None = None,
    normalize_over: Column | None = None,
) -> DataFrame:
    """Score features: logs, nine min-max inputs, nine weighted parts and their sum.

    Inputs the table lacks count as 0; a missing rent score is 0 before scaling. With
    ``by`` (and weights per group) every group is scaled and weighted on its own, in the
    same pass. Rows come out unordered; use ``ranking`` to sort or rank.
    """
    df = features.withColumns({new: F.log1p(F.col(c)) for new, c in _LOGS.items()})
    inputs = dict(_INPUTS)
    absent = {}
    for new, c in _OPTIONAL.items():
        if c in df.columns:
            inputs[new] = c
        else:
            absent[new] = F.lit(0.0)
    if "rent_affordability_score" in df.columns:
        df = df.withColumn("_rent", F.coalesce("rent_affordability_score", F.lit(0.0)))
        inputs["n_rent_affordability"] = "_rent"
    df = scaled(df, inputs, by, normalize_over).drop("_rent")
    if absent:
        df = df.withColumns(absent)
    df = df.withColumns(
        {part: F.lit(sign) * _weight(weights, field, by) * F.col(n) for part, n, field, sign in PARTS}
    )
    total = F.col(PARTS[0][0])
    for part, *_ in PARTS[1:]:
        total = total + F.col(part)
    return df.withColumn("opportunity_score", total)


def light_parts(weights: LightWeights) -> dict[str, Column]:
    """Columns of the light score over poi, competitor and complement counts and quality."""
    competitor, complement = F.log1p("competitor_count"), F.log1p("complement_count")
    density = F.log1p("poi_count")
    return {
        "competitor_log": competitor,
        "complement_log": complement,
        "density_log": density,
        "opportunity_score": F.lit(weights.complement) * complement
        - F.lit(weights.competitor) * competitor
        + F.lit(weights.density) * density
        + F.lit(weights.data_quality) * F.col("data_quality_score"),
    }


def light_score(
    areas: DataFrame,
    competitors: DataFrame,
    complements: DataFrame,
    quality: DataFrame,
    weights: LightWeights = LightWeights(),
    on: str = "area_id",
) -> DataFrame:
    """Log-weighted score from separate per-area tables; what an area lacks counts as 0."""
    joined = areas
    for side in (competitors, complements, quality):
        joined = joined.join(side, on, "left")
    filled = joined.withColumns(
        {
            "competitor_count": F.coalesce("competitor_count", F.lit(0)),
            "complement_count": F.coalesce("complement_count", F.lit(0)),
            "data_quality_score": F.coalesce("data_quality_score", F.lit(0.0)),
        }
    )
    return filled.withColumns(light_parts(weights))


def guardrails(
    df: DataFrame,
    min_active: int = 200,
    min_quality: float = 0.0,
    premium: bool = False,
    active_col: str = "active_poi_count",
    quality_col: str = "mean_data_quality_score",
) -> DataFrame:
    """Areas with enough places and quality; ``premium`` also asks for a high market fit."""
    keep = (F.col(active_col) >= min_active) & (F.col(quality_col) >= min_quality)
    if premium and "market_fit_score" in df.columns:
        # Fixed value: the market fit a premium position needs.
        keep = keep & (F.col("market_fit_score") >= 0.60)
    return df.filter(keep)


REQUIRED_RANKED = (
    "area_id", "opportunity_score", "competitor_count", "complementary_count", "commercial_activity_proxy",
    "saturation_proxy", "unique_category_count", "mean_data_quality_score", "active_poi_count",
)


def require_columns(df: DataFrame, needed: Sequence[str] = REQUIRED_RANKED) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"ranked areas lack the columns {missing}")
    return df
