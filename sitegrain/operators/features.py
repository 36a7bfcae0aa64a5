"""One feature row per area (and template)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.config import Taxonomy
from sitegrain.functions.numbers import QUALITY_DIGITS, steady_mean
from sitegrain.operators.areas import HEX8, AreaUnit, mean_position, with_area_key
from sitegrain.operators.quality import quality_score
from sitegrain.operators.roles import FLAGS, distinct_ids, role_masks
from sitegrain.operators.spatial import locate
from sitegrain.runtime import cut_lineage


@dataclass(frozen=True)
class Layers:
    """Optional context tables, ready to join. ``None`` leaves a layer's columns out."""

    transit: DataFrame | None = None
    regions: DataFrame | None = None
    market_fit: DataFrame | None = None
    rent: DataFrame | None = None
    suburbs: DataFrame | None = None


def area_aggregate(
    places: DataFrame,
    categories: DataFrame,
    taxonomies: Mapping[str, Taxonomy],
    unit: AreaUnit = HEX8,
    group_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, mean quality and centre per area, for all templates in one pass.

    One scan and one shuffle: flags, quality and cell are computed on the place row, and the
    only grouping is by area. Its partial sums hold one row per area and task, so a cell
    with a third of all places is as cheap as any other. Templates are side-by-side sums of
    the same row and unfold after the aggregate.
    """
    keyed = with_area_key(places, unit)
    masks = role_masks(categories, taxonomies)
    names = [f"_mask{w}" for w in range(masks.words)]
    scored = keyed.withColumns(
        dict(zip(names, masks.folded()))
        | {
            "unique_category_count": distinct_ids(F.col("category_ids")).cast("bigint"),
            "_quality": quality_score(places.columns),
        }
    )
    own = [F.col(n) for n in names]
    keys = list(taxonomies)
    sums = []
    for i, k in enumerate(keys):
        active = ~masks.any_of(f"{k}.is_excluded", own)
        sums.append(F.count_if(active).alias(f"active_{i}"))
        for flag in FLAGS:
            if flag != "is_excluded":
                sums.append(F.count_if(active & masks.any_of(f"{k}.{flag}", own)).alias(f"{flag}_{i}"))
    grouped = scored.groupBy("area_key", *group_cols).agg(
        F.count(F.lit(1)).alias("total_poi_count"),
        *sums,
        F.sum("unique_category_count").alias("unique_category_count"),
        steady_mean(F.col("_quality"), QUALITY_DIGITS).alias("mean_data_quality_score"),
        *mean_position(),
    )
    unfolded = F.array(
        *[
            F.struct(
                F.lit(k).alias("template"),
                F.col(f"active_{i}").alias("active_poi_count"),
                F.col(f"is_competitor_{i}").alias("competitor_count"),
                F.col(f"is_complementary_{i}").alias("complementary_count"),
                F.col(f"is_commercial_other_{i}").alias("commercial_other_count"),
            )
            for i, k in enumerate(keys)
        ]
    )
    return grouped.select(
        unit.label(F.col("area_key")).alias("area_id"),
        *group_cols,
        "total_poi_count",
        "unique_category_count",
        "mean_data_quality_score",
        "lat_mean",
        "lon_mean",
        F.inline(unfolded),
    )


def derived(areas: DataFrame) -> DataFrame:
    """Ratios and proxies of the aggregated counts."""
    base = F.col("active_poi_count") + F.lit(1.0)
    density, support = F.col("competitor_count") / base, F.col("complementary_count") / base
    return areas.withColumns(
        {
            "competitor_density_proxy": density,
            "complementarity_ratio": support,
            "commercial_activity_proxy": F.col("active_poi_count"),
            "saturation_proxy": density * (F.lit(1.0) - support),
            "recent_refresh_share": F.lit(None).cast("double"),
        }
    )


FEATURE_COLUMNS = (
    "area_id", "total_poi_count", "active_poi_count", "competitor_count", "complementary_count",
    "commercial_other_count", "unique_category_count", "mean_data_quality_score",
    "competitor_density_proxy", "complementarity_ratio", "commercial_activity_proxy", "saturation_proxy",
    "recent_refresh_share",
)


def enrich(areas: DataFrame, layers: Layers) -> DataFrame:
    """Join the context layers. ``areas`` needs ``area_id, lat_mean, lon_mean``.

    The polygon lookups run once per area, not per template or layer.
    """
    out = areas
    if layers.transit is not None:
        zero = {
            c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
            for c in ("station_entrance_count", "pt_facility_count", "bus_shelter_count")
        }
        zero["transit_access_score"] = F.coalesce("transit_access_score", F.lit(0.0))
        out = out.join(layers.transit, "area_id", "left").withColumns(zero)
    if layers.regions is not None:
        out = out.join(
            locate(
                areas, layers.regions, "area_id", "lat_mean", "lon_mean", "sa2_code_2021", "sa2_name_2021"
            ),
            "area_id",
            "left",
        )
        if layers.market_fit is not None:
            fit = layers.market_fit.select(
                "sa2_code_2021", "market_fit_score", "seifa_irsad_decile", "sa2_population"
            )
            out = out.join(fit, "sa2_code_2021", "left").withColumns(
                {
                    "market_fit_score": F.coalesce("market_fit_score", F.lit(0.0)),
                    "seifa_irsad_decile": F.coalesce("seifa_irsad_decile", F.lit(0).cast("bigint")),
                }
            )
    if layers.suburbs is not None:
        out = out.join(
            locate(
                areas, layers.suburbs, "area_id", "lat_mean", "lon_mean", "sal_code_2021", "sal_name_2021"
            ),
            "area_id",
            "left",
        )
    if layers.regions is not None and layers.rent is not None:
        rent = layers.rent.select("sa2_code_2021", "rent_stress_share", "rent_affordability_score")
        out = out.join(rent, "sa2_code_2021", "left")
    return out


LAYER_COLUMNS = (
    "station_entrance_count", "pt_facility_count", "bus_shelter_count", "transit_access_raw",
    "transit_access_score", "sa2_code_2021", "sa2_name_2021", "market_fit_score", "seifa_irsad_decile",
    "sa2_population", "sal_name_2021", "sal_code_2021", "rent_stress_share", "rent_affordability_score",
)


def area_features(
    places: DataFrame,
    categories: DataFrame,
    taxonomies: Mapping[str, Taxonomy],
    unit: AreaUnit = HEX8,
    layers: Layers = Layers(),
    keep_center: bool = False,
    group_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Feature rows per area and template, with the layers that are given.

    Layers belong to hexagonal cells; locality areas take none of them. With layers, the
    aggregate is cut off from the place scan first, because several joins read it.
    """
    areas = derived(area_aggregate(places, categories, taxonomies, unit, group_cols))
    wanted = unit.kind == "hex" and any(
        x is not None for x in (layers.transit, layers.regions, layers.suburbs)
    )
    if wanted:
        areas = cut_lineage(areas)
        centers = areas.select("area_id", "lat_mean", "lon_mean").dropDuplicates(["area_id"])
        context = enrich(centers, layers).drop("lat_mean", "lon_mean")
        areas = areas.join(context, "area_id", "left")
    present = [c for c in (*FEATURE_COLUMNS, *LAYER_COLUMNS) if c in areas.columns]
    center = ["lat_mean", "lon_mean"] if keep_center else []
    return areas.select("template", *group_cols, *present, *center)
