"""Rankings: one template, all templates, strategies, custom keywords, metros."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.config import (
    CUSTOM_WEIGHTS,
    TEMPLATES,
    City,
    LightWeights,
    QualityPenalties,
    Template,
    custom_taxonomy,
    strategy_weights,
)
from sitegrain.functions.numbers import QUALITY_DIGITS, clamp01, steady_sum
from sitegrain.functions.text import category_text, mentions_any
from sitegrain.operators.areas import HEX8, AreaUnit, mean_position, with_area_key
from sitegrain.operators.features import Layers, area_features
from sitegrain.operators.quality import quality_score
from sitegrain.operators.ranking import by_score, full_rank
from sitegrain.operators.reasons import with_reasons
from sitegrain.operators.reports import metro_summary, with_context, with_metro
from sitegrain.operators.roles import CategoryMasks
from sitegrain.operators.scoring import guardrails, light_parts, opportunity
from sitegrain.runtime import cut_lineage


def template_features(
    places: DataFrame,
    categories: DataFrame,
    templates: Mapping[str, Template] = TEMPLATES,
    unit: AreaUnit = HEX8,
    layers: Layers = Layers(),
) -> DataFrame:
    """Feature rows for several templates from one scan, kept for the scoring passes."""
    taxonomies = {k: t.taxonomy for k, t in templates.items()}
    return cut_lineage(area_features(places, categories, taxonomies, unit, layers, keep_center=True))


def score_templates(
    features: DataFrame,
    templates: Mapping[str, Template] = TEMPLATES,
    min_active: int = 200,
    normalize_over: Column | None = None,
) -> DataFrame:
    """Scored areas with reasons. Scaling covers all areas; the guardrail comes after it."""
    weights = {k: t.weights for k, t in templates.items()}
    scored = opportunity(features, weights, by="template", normalize_over=normalize_over)
    return with_reasons(guardrails(scored, min_active))


def rank_areas(
    places: DataFrame,
    categories: DataFrame,
    template: Template = TEMPLATES["gym"],
    unit: AreaUnit = HEX8,
    layers: Layers = Layers(),
    min_active: int = 200,
) -> DataFrame:
    """Scored areas of one template, unordered."""
    one = {template.key: template}
    return score_templates(template_features(places, categories, one, unit, layers), one, min_active)


def rescore(
    features: DataFrame, mode: str = "balanced", min_active: int = 0, min_quality: float = 0.0
) -> DataFrame:
    """Existing features under a strategy's weights, guarded, ranked from 1."""
    scored = with_reasons(opportunity(features, strategy_weights(mode)), out="brief_reason")
    return full_rank(guardrails(scored, min_active, min_quality), by_score())


def keyword_masks(
    categories: DataFrame, competitor: Iterable[str], complement: Iterable[str], exclude: Iterable[str] = ()
) -> CategoryMasks:
    """``competitor`` and ``complement`` flags; exclusions override both."""
    text = category_text()
    words = custom_taxonomy(competitor, complement, exclude)
    allowed = ~mentions_any(text, words.excluded)
    return CategoryMasks(
        categories,
        {
            "competitor": mentions_any(text, words.competitor) & allowed,
            "complement": mentions_any(text, words.complementary) & allowed,
        },
    )


def cell_profile(
    places: DataFrame, masks: CategoryMasks, unit: AreaUnit = HEX8, penalties: QualityPenalties = QualityPenalties()
) -> DataFrame:
    """Place count, centre, set counts and category-weighted quality per area, in one pass.

    Counts of category rows are taken from the id list of the place, so nothing is exploded.
    A place weighs as many rows as it has ids (one when it has none).
    """
    ids = F.coalesce(F.col("category_ids"), F.array().cast("array<string>"))
    rows = F.greatest(F.size(ids), F.lit(1))
    known = F.size(F.array_compact(ids))
    base = quality_score(["lat", "lon", "name"], penalties)
    unknown_base = clamp01(base - F.lit(penalties.missing_category))
    keyed = with_area_key(places, unit).select(
        "area_key",
        "lat",
        "lon",
        *[each.alias(f"_each{w}") for w, each in enumerate(masks.each())],
        rows.alias("_rows"),
        (base * known + unknown_base * (rows - known)).alias("_quality"),
    )
    own = [F.col(f"_each{w}") for w in range(masks.words)]
    counted = keyed.withColumns({f"_{n}": masks.count_of(n, own) for n in ("competitor", "complement")})
    return (
        counted.groupBy("area_key")
        .agg(
            F.count(F.lit(1)).alias("poi_count"),
            *mean_position(),
            F.sum("_competitor").cast("bigint").alias("competitor_count"),
            F.sum("_complement").cast("bigint").alias("complement_count"),
            (
                steady_sum(F.col("_quality"), QUALITY_DIGITS) / (F.sum("_rows") * F.lit(10.0**QUALITY_DIGITS))
            ).alias("data_quality_score"),
        )
        .select(unit.label(F.col("area_key")).alias("area_id"), "*")
        .drop("area_key")
    )


def custom_rank(
    places: DataFrame,
    categories: DataFrame,
    competitor: Iterable[str],
    complement: Iterable[str],
    exclude: Iterable[str] = (),
    context: DataFrame | None = None,
    weights: LightWeights = CUSTOM_WEIGHTS,
    unit: AreaUnit = HEX8,
) -> DataFrame:
    """Light ranking for ad-hoc keywords, with reasons relative to the median area."""
    masks = keyword_masks(categories, competitor, complement, exclude)
    scored = cell_profile(places, masks, unit).withColumns(light_parts(weights))
    scored = cut_lineage(scored.withColumn("active_poi_count", F.col("poi_count")))
    if context is not None:
        scored = with_context(scored, context)
    return with_median_reasons(scored)


def with_median_reasons(scored: DataFrame) -> DataFrame:
    """Reasons where an area beats the median area.

    The columns are logs of counts: the exact median holds one entry per *distinct* count,
    and n places can only make about sqrt(2n) distinct area counts.
    """
    logs = ("complement_log", "density_log", "competitor_log")
    medians = scored.agg(F.struct(*[F.median(c).alias(c) for c in logs]).alias("m")).scalar()
    tagged = scored.withColumn("_m", medians)
    text = F.concat_ws(
        "; ",
        F.when(F.col("complement_log") > F.col("_m.complement_log"), F.lit("Strong complements")),
        F.when(F.col("density_log") > F.col("_m.density_log"), F.lit("High activity")),
        F.when(F.col("competitor_log") < F.col("_m.competitor_log"), F.lit("Lower competition")),
    )
    return tagged.withColumn("reasons_top3", text).drop("_m")


def compare_metros(
    places: DataFrame,
    categories: DataFrame,
    metros: Mapping[str, City],
    template: Template = TEMPLATES["cafe"],
    unit: AreaUnit = HEX8,
) -> DataFrame:
    """Areas of all metros from one scan, scored together so that scores are comparable."""
    features = area_features(
        with_metro(places, metros),
        categories,
        {template.key: template.taxonomy},
        unit,
        group_cols=("metro_key",),
    )
    return opportunity(cut_lineage(features), template.weights)


def metro_report(
    places: DataFrame,
    categories: DataFrame,
    metros: Mapping[str, City],
    template: Template = TEMPLATES["cafe"],
    min_active: int = 80,
    top_n: int = 25,
) -> DataFrame:
    ranked = cut_lineage(compare_metros(places, categories, metros, template))
    return metro_summary(ranked, metros, min_active, top_n)
