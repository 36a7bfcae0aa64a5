"""Context layers: transit access, market fit, rent stress, tenure, postcode housing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.numbers import share_of, weighted_mean
from sitegrain.operators.areas import HEX8, AreaUnit, with_area_key
from sitegrain.operators.scoring import scaled
from sitegrain.runtime import cut_lineage

# Weights of entrances, other facilities and bus shelters.
TRANSIT_WEIGHTS = (2.0, 1.0, 0.5)
# Weights of the two socio-economic indexes in the market fit.
FIT_WEIGHTS = (0.7, 0.3)
# Fixed value: regions with fewer renting households get no affordability score.
MIN_RENTING_HOUSEHOLDS = 200


def transport_bucket(kind: Column) -> Column:
    """entrance, shelter or facility; a missing kind is a facility."""
    text = F.lower(F.coalesce(kind.cast("string"), F.lit("facility")))
    return (
        F.when(text.contains("entrance"), F.lit("entrance"))
        .when(text.contains("bus") & text.contains("shelter"), F.lit("shelter"))
        .otherwise(F.lit("facility"))
    )


def transit_counts(points: DataFrame, unit: AreaUnit = HEX8) -> DataFrame:
    """Entrances, facilities and shelters per area, and their log-weighted sum.

    A kind that names both an entrance and a bus shelter counts as both.
    """
    text = F.lower(F.coalesce(F.col("kind").cast("string"), F.lit("facility")))
    entrance = text.contains("entrance")
    shelter = text.contains("bus") & text.contains("shelter")
    counted = (
        with_area_key(points, unit)
        .groupBy("area_key")
        .agg(
            F.count_if(entrance).alias("station_entrance_count"),
            F.count_if(~(entrance | shelter)).alias("pt_facility_count"),
            F.count_if(shelter).alias("bus_shelter_count"),
        )
    )
    return counted


def transit_access(
    points: DataFrame, unit: AreaUnit = HEX8, weights: tuple[float, float, float] = TRANSIT_WEIGHTS
) -> DataFrame:
    """Transit score in [0, 1] per area, relative to all areas that have transport points."""
    by_entrance, by_facility, by_shelter = weights
    raw = F.log1p(
        F.col("station_entrance_count") * by_entrance
        + F.col("pt_facility_count") * by_facility
        + F.col("bus_shelter_count") * by_shelter
    )
    cells = cut_lineage(transit_counts(points, unit)).withColumn("transit_access_raw", raw)
    return scaled(cells, {"transit_access_score": "transit_access_raw"}).select(
        unit.label(F.col("area_key")).alias("area_id"),
        "station_entrance_count",
        "pt_facility_count",
        "bus_shelter_count",
        "transit_access_raw",
        "transit_access_score",
    )


def market_fit(seifa: DataFrame, weights: tuple[float, float] = FIT_WEIGHTS) -> DataFrame:
    """Affluence score per region, normalised over all regions of the country."""
    advantage, resources = weights
    both = scaled(seifa, {"n_irsad": "seifa_irsad_score", "n_ier": "seifa_ier_score"})
    return both.select(
        "sa2_code_2021",
        "sa2_name_2021",
        "sa2_population",
        "seifa_irsad_score",
        "seifa_irsad_decile",
        "seifa_ier_score",
        "seifa_ier_decile",
        (F.lit(advantage) * F.col("n_irsad") + F.lit(resources) * F.col("n_ier")).alias("market_fit_score"),
    )


def rent_affordability(households: DataFrame, min_households: int = MIN_RENTING_HOUSEHOLDS) -> DataFrame:
    """Share of renting households under stress and 1 minus it; no score for small regions."""
    share = share_of(F.col("rent_stress_households"), F.col("total_renting_households"))
    small = F.col("total_renting_households") < F.lit(min_households)
    return households.select(
        "sa2_code_2021",
        share.alias("rent_stress_share"),
        F.when(small, F.lit(None).cast("double")).otherwise(F.lit(1.0) - share).alias("rent_affordability_score"),
    )


def renter_share(tenure: DataFrame) -> DataFrame:
    return tenure.withColumn(
        "renter_share_2021", share_of(F.col("renter_households_2021"), F.col("total_households_2021"))
    )


def poa_sa2_share(poa_blocks: DataFrame, sa2_blocks: DataFrame) -> DataFrame:
    """Share of each postcode's mesh blocks that lies in each region.

    ``poa_blocks(mb_code_2021, poa_code_2021)`` meets ``sa2_blocks(mb_code_2021,
    sa2_code_2021)`` on the block; the pairs are counted before the window, so a postcode
    that holds a third of all blocks is one short list of regions by then.
    """

    def numbers(df: DataFrame, code: str) -> DataFrame:
        typed = df.select(
            F.col("mb_code_2021").try_cast("bigint").alias("mb_code_2021"), F.col(code).try_cast("bigint").alias(code)
        )
        return typed.dropna()

    pairs = (
        numbers(poa_blocks, "poa_code_2021")
        .join(numbers(sa2_blocks, "sa2_code_2021"), "mb_code_2021", "inner")
        .groupBy("poa_code_2021", "sa2_code_2021")
        .agg(F.count(F.lit(1)).alias("mb_count"))
    )
    total = F.sum("mb_count").over(Window.partitionBy("poa_code_2021"))
    return pairs.withColumn("mb_ratio_from_poa_to_sa2", F.col("mb_count") / total)


def _spread(
    stats: DataFrame, share: DataFrame, value: str, count: str, null_value_as_zero: bool
) -> DataFrame:
    """Postcode medians to regions, weighted by count times block share."""
    rows = stats.join(share, "poa_code_2021", "inner")
    weight = F.coalesce(F.col(count), F.lit(0)) * F.col("mb_ratio_from_poa_to_sa2")
    counted = weight if null_value_as_zero else F.when(F.col(value).isNotNull(), weight)
    return rows.groupBy("sa2_code_2021").agg(
        weighted_mean(F.coalesce(F.col(value), F.lit(0.0)), F.coalesce(counted, F.lit(0.0))).alias(f"{value}_w"),
        F.sum(weight).alias(f"{count}_w"),
    )


def housing_by_region(
    rent: DataFrame, sales: DataFrame, share: DataFrame, null_value_as_zero: bool = True
) -> DataFrame:
    """Weighted rent and sale medians per region; regions with only one of the two are kept."""
    rents = _spread(rent, share, "median_weekly_rent_total", "bonds_lodged_total", null_value_as_zero)
    prices = _spread(sales, share, "median_sale_price_total", "sales_total", null_value_as_zero)
    return rents.join(prices, "sa2_code_2021", "full")


def region_assets(
    regions: DataFrame, fit: DataFrame, rent: DataFrame, tenure: DataFrame, housing: DataFrame | None = None
) -> DataFrame:
    """Regions with every known attribute. Regions without a layer row keep nulls."""
    joined = (
        regions.withColumnsRenamed({"code": "sa2_code_2021", "name": "sa2_name_2021"})
        .join(fit.drop("sa2_name_2021", "seifa_ier_decile"), "sa2_code_2021", "left")
        .join(rent, "sa2_code_2021", "left")
        .join(tenure.drop("sa2_name_2021"), "sa2_code_2021", "left")
    )
    if housing is None:
        return joined
    plain = {c: c[:-2] for c in housing.columns if c.endswith("_w")}
    return joined.join(housing.withColumnsRenamed(plain), "sa2_code_2021", "left")


def layer_fill(metric: str) -> Column:
    """Map colour of a region layer: grey without a value, yellow to green with it."""
    t = F.least(F.greatest(F.col(metric), F.lit(0.0)), F.lit(1.0))

    def channel(start: float, step: float) -> Column:
        return (F.lit(start) + F.lit(step) * t).cast("int")

    # The colours of the map layer.
    return F.when(F.col(metric).isNull(), F.array(*[F.lit(v) for v in (180, 180, 180, 90)])).otherwise(
        F.array(channel(240.0, -130.0), channel(210.0, 25.0), channel(95.0, -40.0), F.lit(170))
    )


def point_fill(kind: Column) -> Column:
    """Map colour of a transport point."""
    # The colours of entrances, shelters and other facilities.
    colours = {"entrance": (0, 180, 255, 180), "shelter": (255, 195, 0, 180), "facility": (180, 180, 180, 140)}
    bucket = transport_bucket(kind)
    chosen = F.array(*[F.lit(v) for v in colours["facility"]])
    for name in ("entrance", "shelter"):
        chosen = F.when(bucket == name, F.array(*[F.lit(v) for v in colours[name]])).otherwise(chosen)
    return chosen


