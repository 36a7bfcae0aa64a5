"""Drill-downs, comparisons, metro summaries and region reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.config import COMPLEMENT_GROUPS, City
from sitegrain.functions.numbers import ramp
from sitegrain.functions.text import area_label
from sitegrain.operators.areas import with_centers
from sitegrain.operators.ranking import bottom_k, head_per_group, top_k
from sitegrain.operators.reasons import report_columns
from sitegrain.operators.roles import with_names
from sitegrain.operators.scoring import scaled
from sitegrain.operators.subset import in_bbox, picked


def compatible(df: DataFrame) -> DataFrame:
    """Add the short column names reports use, a name per area and a one-line reason."""
    alias = {
        "complement_count": "complementary_count",
        "data_quality_score": "mean_data_quality_score",
        "poi_count": "active_poi_count",
    }
    added = {new: F.col(old) for new, old in alias.items() if new not in df.columns and old in df.columns}
    if "area_name" not in df.columns:
        added["area_name"] = F.col("area_id").cast("string")
    if "brief_reason" not in df.columns:
        added["brief_reason"] = F.col("reasons_top3") if "reasons_top3" in df.columns else F.lit("")
    return df.withColumns(added)


def top_categories(counts: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent categories of every area, with names."""
    best = head_per_group(counts, "area_id", n, [F.col("cnt").desc(), F.col("category_id").asc()])
    return with_names(best, categories).select("area_id", "rank", "category_id", "category_name", "cnt")


def competitor_examples(pois: DataFrame, ids: DataFrame, categories: DataFrame, n: int = 20) -> DataFrame:
    """Up to ``n`` different competitor places per area.

    Equal rows share a dense rank, so the bound is applied inside each task before anything
    is shuffled, and duplicates only meet among the few rows that are left.
    """
    hits = pois.join(ids.select("category_id"), "category_id", "left_semi").select(
        "area_id", "place_id", "category_id", "name"
    )
    order = Window.partitionBy("area_id").orderBy("place_id", "category_id", F.col("name").asc_nulls_first())
    best = hits.withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= n).drop("_rank").distinct()
    return with_names(best, categories).select("area_id", "place_id", "name", "category_id", "category_name")


def complement_breakdown(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(area_id, complement_group, count) for every group that has categories at all.

    ``groups`` are (complement_group, category_id) pairs of the built-in group names.
    """
    names = list(COMPLEMENT_GROUPS)
    memberships = groups.groupBy("category_id").agg(F.collect_set("complement_group").alias("_groups"))
    used = groups.agg(F.collect_set("complement_group").alias("used")).scalar()
    sums = [
        F.coalesce(F.sum(F.when(F.array_contains("_groups", g), F.col("cnt"))), F.lit(0)).alias(f"g{i}")
        for i, g in enumerate(names)
    ]
    wide = counts.join(memberships, "category_id", "left").groupBy("area_id").agg(*sums)
    rows = F.array(
        *[F.struct(F.lit(g).alias("complement_group"), F.col(f"g{i}").alias("count")) for i, g in enumerate(names)]
    )
    return wide.withColumn("_used", used).select("area_id", "_used", F.inline(rows)).filter(
        F.array_contains(F.col("_used"), F.col("complement_group"))
    ).select("area_id", "complement_group", "count")


def calibration_counts(places: DataFrame, pois: DataFrame, ids: DataFrame) -> DataFrame:
    """Places in the market and place-category rows that match the competitor definition."""
    total = places.agg(F.count(F.lit(1)).alias("n")).scalar()
    hits = pois.join(ids.select("category_id"), "category_id", "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("competitor_poi_count")).select(
        total.alias("total_poi_count"), "competitor_poi_count"
    )


def metro_tag(metros: Mapping[str, City]) -> Column:
    """Keys of the metros whose box holds a place; boxes may overlap."""
    return F.array_compact(
        F.array(*[F.when(in_bbox(city.bbox), F.lit(key)) for key, city in metros.items()])
    )


def with_metro(places: DataFrame, metros: Mapping[str, City], out: str = "metro_key") -> DataFrame:
    """Places once per metro they lie in: a projection, not a join."""
    return places.select("*", F.explode(metro_tag(metros)).alias(out))


def metro_summary(
    ranked: DataFrame, metros: Mapping[str, City], min_active: int = 80, top_n: int = 25
) -> DataFrame:
    """Per metro: qualified areas, median and best of its top scores, and a status.

    Counts fold map-side; only ``top_n`` rows per metro and task take part in the median.
    """
    enough = F.col("active_poi_count") >= min_active
    sizes = ranked.groupBy("metro_key").agg(F.count_if(enough).alias("n_cells_qualified"))
    best = head_per_group(
        ranked.filter(enough), "metro_key", top_n, [F.col("opportunity_score").desc(), F.col("area_id").asc()]
    )
    scores = best.groupBy("metro_key").agg(
        F.median("opportunity_score").alias("median_top_score"), F.max("opportunity_score").alias("max_score")
    )
    listed = ranked.sparkSession.createDataFrame(
        [(key, city.label) for key, city in metros.items()], "metro_key string, label string"
    )
    # The three states a metro can be in.
    status = (
        F.when(F.col("n_cells_qualified").isNull(), "missing_parquet")
        .when(F.col("n_cells_qualified") == 0, "no_qualified_cells")
        .otherwise("ok")
    )
    return (
        listed.join(sizes, "metro_key", "left")
        .join(scores, "metro_key", "left")
        .select(
            "metro_key",
            "label",
            status.alias("status"),
            F.coalesce("n_cells_qualified", F.lit(0)).alias("n_cells_qualified"),
            "median_top_score",
            "max_score",
        )
        .orderBy(F.col("median_top_score").desc_nulls_last(), "metro_key")
    )


def status_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("status").agg(F.count(F.lit(1)).alias("metros"))


def region_extremes(assets: DataFrame, metric: str, k: int = 10, id_col: str = "sa2_code_2021") -> DataFrame:
    """The best and worst ``k`` regions of a metric; regions without it do not take part."""
    known = assets.filter(F.col(metric).isNotNull())
    best = top_k(known, k, metric, id_col).withColumn("side", F.lit("top"))
    worst = bottom_k(known, k, metric, id_col).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def alignment_check(ranked: DataFrame, n: int = 50) -> DataFrame:
    """Median market fit and decile of the ``n`` best areas."""
    best = top_k(ranked, n)
    return best.agg(
        F.count(F.lit(1)).alias("top_n"),
        F.median("market_fit_score").alias("median_market_fit"),
        F.median("seifa_irsad_decile").cast("bigint").alias("median_irsad_decile"),
    )


def diagnostic_lists(ranked: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` areas by score, by saturation and by complementarity, as one table."""
    out = None
    for metric in ("opportunity_score", "saturation_proxy", "complementarity_ratio"):
        part = top_k(ranked, n, metric).select(
            F.lit(metric).alias("list"),
            "area_id",
            F.col(metric).alias("value"),
            "competitor_count",
            "complementary_count",
            "active_poi_count",
        )
        out = part if out is None else out.unionByName(part)
    return out


def with_context(ranked: DataFrame, context: DataFrame, on: str = "area_id") -> DataFrame:
    """Business-neutral scores of an earlier ranking; typed nulls for what it lacks."""
    types = {"transit_access_score": "double", "market_fit_score": "double", "seifa_irsad_decile": "bigint"}
    have = [c for c in types if c in context.columns]
    joined = ranked.join(context.select(on, *have), on, "left")
    absent = {c: F.lit(None).cast(t) for c, t in types.items() if c not in have}
    return joined.withColumns(absent) if absent else joined


def with_area_centers(ranked: DataFrame, areas: DataFrame, on: str = "area_id") -> DataFrame:
    """Mean positions, joined only when the ranking has none."""
    if {"lat_mean", "lon_mean"} <= set(ranked.columns):
        return ranked
    return ranked.join(areas.select(on, "lat_mean", "lon_mean"), on, "left")


def shortlist(ranked: DataFrame, notes: DataFrame, on: str = "area_id") -> DataFrame:
    """Noted areas of a ranking with status and notes."""
    picked_rows = ranked.join(notes.select(on), on, "left_semi")
    return picked_rows.join(notes.select(on, "shortlist_status", "shortlist_notes"), on, "left")


def map_points(df: DataFrame, id_col: str = "area_id") -> DataFrame:
    """What a map needs per area: position, counts, label and colour; missing context is null."""
    base = compatible(df)
    base = base if {"lat_mean", "lon_mean"} <= set(base.columns) else with_centers(base)
    position = ("lat_mean", "lon_mean") if "lat_mean" in base.columns else ("lat", "lon")
    optional = {
        "sal_name_2021": "string",
        "sa2_name_2021": "string",
        "transit_access_score": "double",
        "market_fit_score": "double",
        "rent_affordability_score": "double",
    }
    points = base.select(
        F.col(position[0]).alias("lat"),
        F.col(position[1]).alias("lon"),
        "opportunity_score",
        "competitor_count",
        "complement_count",
        "poi_count",
        id_col,
        *[(F.col(c) if c in base.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()],
    )
    shaded = scaled(points, {"score_norm": "opportunity_score"})
    # The colours go from red to green with the score.
    return shaded.withColumns(
        {
            "area_label": area_label(),
            "fill_r": ramp(F.col("score_norm"), 220, -160),
            "fill_g": ramp(F.col("score_norm"), 60, 160),
            "fill_b": F.lit(80),
            "fill_a": F.lit(150),
        }
    )

