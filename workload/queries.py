"""One registered query per operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.config import GYM, SYDNEY, TEMPLATES
from sitegrain.operators import areas as A
from sitegrain.operators import layers as L
from sitegrain.operators import reasons as E
from sitegrain.operators import reports as R
from sitegrain.operators import roles as C
from sitegrain.operators import scoring as S
from sitegrain.operators import spatial as G
from sitegrain.operators import subset as P
from sitegrain.operators.features import Layers, area_features
from sitegrain.operators.quality import area_quality, poi_quality, quality_score
from sitegrain.operators.ranking import by_score, full_rank, top_k
from sitegrain.operators.subset import in_bbox
from sitegrain.plans.ranking import (
    compare_metros,
    custom_rank,
    metro_report,
    rank_areas,
    rescore,
    score_templates,
    template_features,
)
from sitegrain.runtime import cut_lineage, new_folder
from sitegrain.sources import places as SP
from sitegrain.sources.census import RENT_COLUMNS, read_noted_csv, rent_stress_households
from sitegrain.sources.feature_lines import SEPARATOR
from sitegrain.sources.profile import Funnel, funnel_counts, schema_profile
from sitegrain.sources.regions import read_region_lines
from sitegrain.sources.sinks import features as geo_features
from sitegrain.sources.sinks import write_clustered, write_geojson_lines
from sitegrain.sources.transport import read_point_lines
from workload.inputs import EAST, METROS, WEST, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places and without a negative zero, so engines can be compared."""
    return df.select(
        *[
            (F.round(F.col(f.name), 6) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(Inputs(spark, folder)))
    return fn


# ---- sources and subsets -------------------------------------------------------------------


@query
def places_canonical(t: Inputs) -> DataFrame:
    p = SP.canonical_places(t.raw_places)
    return p.withColumn("category_ids", F.concat_ws(",", "category_ids"))


@query
def schema_profile_places(t: Inputs) -> DataFrame:
    return schema_profile(t.raw_places)


@query
def row_funnel(t: Inputs) -> DataFrame:
    return funnel_counts(
        t.places,
        ("country", F.col("country") == "AU"),
        ("open", F.col("date_closed").isNull()),
        ("unflagged", ~P.has_bad_flag(t.places)),
        ("city", F.col("locality") == "Sydney"),
    )


@query
def observed_funnel(t: Inputs) -> DataFrame:
    """The same funnel counted on the way, while one action runs over the filtered rows."""
    funnel = Funnel()
    kept = funnel.through(
        funnel.mark(t.places, "input"),
        ("country", lambda d: d.filter(F.col("country") == "AU")),
        ("open", lambda d: d.filter(F.col("date_closed").isNull())),
        ("unflagged", lambda d: d.filter(~P.has_bad_flag(d))),
        ("city", lambda d: d.filter(F.col("locality") == "Sydney")),
    )
    kept.write.format("noop").mode("overwrite").save()
    return funnel.table(t.spark)


@query
def subset_country_bbox(t: Inputs) -> DataFrame:
    parts = {
        "bbox": P.bbox_filter(t.places, WEST),
        "country_any_case": P.country_filter(t.places, "AU", ignore_case=True),
        "country_exact": P.country_filter(t.places, "AU"),
        "no_country_column": P.country_filter(t.places.drop("country"), "AU"),
        "metro": P.metro_filter(t.places, "AU", EAST),
    }
    out = None
    for rule, df in parts.items():
        part = df.select(F.lit(rule).alias("rule"), "place_id", "lat", "lon")
        out = part if out is None else out.unionByName(part)
    return out


@query
def metro_scan(t: Inputs) -> DataFrame:
    return SP.scan_metro(t.raw_places, EAST, "AU").select("place_id", "name", "lat", "lon", "country")


@query
def subset_flags_open(t: Inputs) -> DataFrame:
    return P.drop_flagged(P.open_only(t.places)).select("place_id", "date_closed", "unresolved_flags")


@query
def subset_locality_strategy(t: Inputs) -> DataFrame:
    more = ["LOC_1", "LOC_2", "LOC_3"]
    parts = {
        "locality": P.city_subset(t.places),
        "region_localities": P.city_subset(t.places, strategy="region_localities", localities=more),
        "auto_with_list": P.city_subset(t.places, localities=more),
        "bbox": P.city_subset(t.core_places),
    }
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("strategy"), "place_id")
        out = part if out is None else out.unionByName(part)
    return out


@query
def capped_sample(t: Inputs) -> DataFrame:
    tie = F.concat_ws("|", "name", "country", "locality", "region")
    return SP.capped_sample(t.places, 5000, tie=tie).select("place_id", "lat", "lon")


@query
def capped_sample_hot(t: Inputs) -> DataFrame:
    """Whole localities in the order of their hash until 2000 places; one locality holds a third of all places."""
    sample = SP.capped_sample(t.places, 2000, id_col="locality", tie=F.col("place_id"))
    return sample.select("place_id", "locality")


# ---- written and read back -----------------------------------------------------------------


@query
def noted_csv_readback(t: Inputs) -> DataFrame:
    """Two files under notes with commas: one wide with blank headings, one with its columns in another order."""
    c = RENT_COLUMNS
    raw = t.raw_rent_stress
    text = {n: F.coalesce(F.col(n), F.lit("")) for n in c} | {c[2]: F.concat(F.lit('"'), F.col(c[2]), F.lit(', AU"'))}
    blank, filler = F.lit(""), [F.lit(f"f{i}") for i in range(62)]
    wide = F.concat_ws(",", text[c[0]], blank, text[c[1]], blank, text[c[2]], text[c[3]], *filler, text[c[4]], text[c[5]])
    turned = F.concat_ws(",", text[c[0]], *[text[n] for n in reversed(c[1:])])
    second = F.pmod(F.xxhash64(c[1], c[4]), F.lit(2)) == 1
    rows = raw.select(second.cast("int").alias("file"), F.lit(2).alias("place"), F.when(second, turned).otherwise(wide).alias("line"))
    wide_head = ",".join([c[0], "", c[1], " ", c[2], c[3], *[f"h{i}" for i in range(62)], c[4], c[5]])
    notes = [(0, 0, "Notes, with a comma, on GEOGRAPHY_LEVEL"), (0, 1, wide_head)]
    notes += [(1, 0, "Other notes,,,,"), (1, 1, ",".join([c[0], *reversed(c[1:])]))]
    top = t.spark.createDataFrame(notes, "file int, place int, line string")
    folder = new_folder(t.spark)
    sheets = top.union(rows).repartition("file").sortWithinPartitions("file", "place")
    sheets.select("file", "line").write.partitionBy("file").text(folder)
    return rent_stress_households(read_noted_csv(t.spark, folder))


@query
def clustered_readback(t: Inputs) -> DataFrame:
    """Places of one box, read from a clustered layout; a second write replaces one country only."""
    folder = new_folder(t.spark)
    places = t.places.select("place_id", "lat", "lon", F.coalesce("country", F.lit("none")).alias("country"), "locality")
    write_clustered(places, folder, ["country"])
    write_clustered(places.filter("country = 'NZ'").withColumn("locality", F.lit("rewritten")), folder, ["country"])
    return t.spark.read.parquet(folder).filter(in_bbox(WEST)).select("place_id", "lat", "lon", "country", "locality")


@query
def compacted_shards(t: Inputs) -> DataFrame:
    """Places written as many small shards, compacted by size, counted per country."""
    shards, folder = new_folder(t.spark), new_folder(t.spark)
    t.places.select("place_id", "lat", "lon", "country").repartition(24).write.parquet(shards)
    SP.compact(t.spark, shards, folder, target_bytes=4 << 20)
    return t.spark.read.parquet(folder).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place_id").alias("ids"))


@query
def region_parts_readback(t: Inputs) -> DataFrame:
    """Every corner of written polygons and multipolygons, read back with its part and ring."""
    island = F.transform(F.col("rings")[0], lambda p: F.struct((p["x"] + 1.0).alias("x"), p["y"].alias("y")))
    two = F.col("region_order") % 4 == 1
    zeros = F.array_repeat(F.lit(0), F.size("rings"))
    given = t.region_rings.withColumns(
        {
            "ring_parts": F.when(two, F.concat(zeros, F.array(F.lit(1)))).otherwise(zeros),
            "rings": F.when(two, F.concat("rings", F.array(island))).otherwise(F.col("rings")),
        }
    )
    folder = new_folder(t.spark)
    write_geojson_lines(given, folder, ["code", "name"])
    regions, _ = read_region_lines(t.spark, folder, "code", "name")
    rings = regions.select("code", "name", "ring_parts", F.posexplode("rings").alias("ring", "corners"))
    corners = rings.select("code", "name", F.col("ring_parts")[F.col("ring")].alias("part"), "ring", F.posexplode("corners").alias("corner", "p"))
    return corners.select("code", "name", "part", "ring", "corner", "p.x", "p.y")


@query
def point_lines_readback(t: Inputs) -> DataFrame:
    """Point features one per line, some cut off, some no features, some without a place; rejects are kept apart."""
    key = F.col("c_custkey")
    shape = F.when(key % 13 == 0, F.lit("null")).otherwise(
        F.concat(F.lit('{"type":"Point","coordinates":['), key % 180, F.lit(","), key % 90, F.lit("]}"))
    )
    whole = F.concat(F.lit('{"type":"Feature","properties":{"name":"'), F.col("c_name"), F.lit('"},"geometry":'), shape, F.lit("}"))
    line = F.when(key % 7 == 0, F.substring(whole, 1, 40)).when(key % 11 == 0, F.concat(F.lit("remark "), key)).otherwise(whole)
    marked = F.when(key % 3 == 0, F.concat(F.lit(SEPARATOR), line)).otherwise(line)
    folder = new_folder(t.spark)
    t.table("customer").select(marked.alias("value")).write.text(folder)
    points, rejects = read_point_lines(t.spark, folder, "lines")
    nothing = F.lit(None)
    kept = points.select("name", "lat", "lon", nothing.cast("string").alias("rejected"))
    return kept.unionByName(rejects.select(*[nothing.cast(k).alias(c) for c, k in (("name", "string"), ("lat", "double"), ("lon", "double"))], F.col("bad").alias("rejected")))


# ---- categories and roles ------------------------------------------------------------------


@query
def categories_clean(t: Inputs) -> DataFrame:
    return SP.clean_categories(t.raw_categories)


@query
def category_search(t: Inputs) -> DataFrame:
    return C.search_categories(t.categories, " Coffee ")


@query
def category_match_sets(t: Inputs) -> DataFrame:
    strict = C.competitor_categories(t.categories, "strict")
    broad = C.competitor_categories(t.categories, "broad")
    food = C.match_categories(t.categories, ["cafe", "bar"], ["coffee"])
    parts = {
        "strict": strict,
        "broad": broad,
        "cafe_or_bar_not_coffee": food,
        "union": C.union_ids(strict, food),
        "broad_minus_strict": C.minus_ids(broad, strict),
    }
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("set_name"), "category_id")
        out = part if out is None else out.unionByName(part)
    return out


@query
def complement_groups(t: Inputs) -> DataFrame:
    return C.complement_groups(t.categories)


@query
def place_categories(t: Inputs) -> DataFrame:
    exploded = C.explode_ids(t.core_places.select("place_id", "category_ids"))
    return C.with_categories(exploded, t.categories.select("category_id", "category_name", "category_label"))


@query
def place_roles(t: Inputs) -> DataFrame:
    return C.place_roles(t.core_places, t.categories, {k: v.taxonomy for k, v in TEMPLATES.items()})


# ---- quality, areas ------------------------------------------------------------------------


@query
def poi_quality_scores(t: Inputs) -> DataFrame:
    exploded = C.explode_ids(t.places)
    rows = exploded.withColumns(
        {
            "place_score": quality_score(t.places.columns),
            "row_score": quality_score(exploded.columns),
        }
    )
    return rows.select("place_id", "category_id", "place_score", "row_score")


@query
def area_quality_scores(t: Inputs) -> DataFrame:
    return area_quality(poi_quality(A.cell_counts(t.core_places).area_pois))


@query
def hex_cells(t: Inputs) -> DataFrame:
    out = t.core_places.select("place_id", "lat", "lon")
    for level in (6, 8, 10):
        out = A.with_area(out, A.AreaUnit(resolution=level)).withColumnRenamed("area_id", f"cell_{level}")
    return out.drop("lat", "lon")


@query
def cell_centroids(t: Inputs) -> DataFrame:
    areas = A.cell_counts(t.core_places).areas
    middle = A.with_centers(areas.select("area_id")).withColumnsRenamed({"lat": "cell_lat", "lon": "cell_lon"})
    lat, lon = "cell_lat", "cell_lon"
    return A.with_centers(areas).join(middle.select("area_id", lat, lon), "area_id")


@query
def locality_areas(t: Inputs) -> DataFrame:
    return area_features(t.places, t.categories, {"gym": GYM.taxonomy}, A.AreaUnit("locality")).drop("template")


@query
def area_features_gym(t: Inputs) -> DataFrame:
    return area_features(t.core_places, t.categories, {"gym": GYM.taxonomy}, keep_center=True).drop("template")


@query
def cell_category_counts(t: Inputs) -> DataFrame:
    return A.cell_counts(t.core_places).area_category_counts


@query
def cell_poi_counts(t: Inputs) -> DataFrame:
    return A.cell_counts(t.core_places).areas


@query
def area_distinct_categories(t: Inputs) -> DataFrame:
    """How many different categories each cell has, from bitmaps."""
    places = t.core_places
    return A.distinct_categories(A.category_bitmaps(places, A.category_ordinals(places)))


@query
def country_distinct_categories(t: Inputs) -> DataFrame:
    """Bitmaps per cell and country, merged to countries without reading the places again."""
    places = t.core_places
    bitmaps = cut_lineage(A.category_bitmaps(places, A.category_ordinals(places), group_cols=("country",)))
    return A.distinct_categories(bitmaps, ("country",))


@query
def category_set_counts(t: Inputs) -> DataFrame:
    counts = A.cell_counts(t.core_places).area_category_counts
    strict = A.sum_categories(counts, C.competitor_categories(t.categories), "total")
    none = A.sum_categories(counts, C.match_categories(t.categories, []), "total")
    return strict.withColumn("set_name", F.lit("strict")).unionByName(none.withColumn("set_name", F.lit("none")))


# ---- context layers ------------------------------------------------------------------------


@query
def transport_points(t: Inputs) -> DataFrame:
    return t.transport.select(
        "kind", "source", "lat", "lon", "name", L.transport_bucket(F.col("kind")).alias("bucket"),
        F.array_join(L.point_fill(F.col("kind")).cast("array<string>"), ",").alias("fill"),
    )


@query
def transit_access(t: Inputs) -> DataFrame:
    return t.transit


@query
def seifa_sheet(t: Inputs) -> DataFrame:
    return t.seifa


@query
def market_fit(t: Inputs) -> DataFrame:
    return t.fit


@query
def rent_stress_wide(t: Inputs) -> DataFrame:
    return t.rent_stress


@query
def rent_affordability(t: Inputs) -> DataFrame:
    return t.rent


@query
def renter_share(t: Inputs) -> DataFrame:
    return t.renters


@query
def poa_sa2_share(t: Inputs) -> DataFrame:
    return t.share


@query
def rent_sheet(t: Inputs) -> DataFrame:
    return t.rents


@query
def sales_sheet(t: Inputs) -> DataFrame:
    return t.sales


@query
def housing_weighted_mean(t: Inputs) -> DataFrame:
    zero = L.housing_by_region(t.rents, t.sales, t.share).withColumn("suppressed", F.lit("as zero"))
    skip = L.housing_by_region(t.rents, t.sales, t.share, null_value_as_zero=False)
    return zero.unionByName(skip.withColumn("suppressed", F.lit("left out")))


@query
def housing_full_outer(t: Inputs) -> DataFrame:
    """Rents of one half of the postcodes and sales of the other leave regions with one side only."""
    low = t.rents.filter(F.col("poa_code_2021") < 2003)
    high = t.sales.filter(F.col("poa_code_2021") >= 2001)
    return L.housing_by_region(low, high, t.share)


# ---- spatial -------------------------------------------------------------------------------


@query
def point_in_region(t: Inputs) -> DataFrame:
    points = t.core_places.select("place_id", "lat", "lon")
    return G.locate(points, t.regions, "place_id", "lat", "lon", "sa2_code_2021", "sa2_name_2021")


@query
def suburb_labels(t: Inputs) -> DataFrame:
    areas = cut_lineage(A.cell_counts(t.core_places).areas)
    return G.locate(areas, t.suburbs, "area_id", "lat_mean", "lon_mean", "sal_code_2021", "sal_name_2021")


@query
def region_centroids(t: Inputs) -> DataFrame:
    return G.region_centroids(t.suburbs)


@query
def centroid_region_map(t: Inputs) -> DataFrame:
    return G.centroid_region_map(t.suburbs, t.regions, "sa2_code_2021", "sa2_name_2021")


@query
def region_bbox_overlap(t: Inputs) -> DataFrame:
    return G.regions_in_bbox(t.suburbs, WEST).select("code", "name", "min_x", "max_x", "min_y", "max_y")


def _assets(t: Inputs, housing: bool = False) -> DataFrame:
    return L.region_assets(t.region_rings, t.fit, t.rent, t.renters, t.housing if housing else None)


ASSET_COLUMNS = (
    "sa2_code_2021", "sa2_name_2021", "market_fit_score", "seifa_irsad_decile", "sa2_population",
    "seifa_irsad_score", "seifa_ier_score", "rent_stress_share", "rent_affordability_score",
    "renter_share_2021", "renter_households_2021", "total_households_2021", "median_weekly_rent_total",
    "bonds_lodged_total", "median_sale_price_total", "sales_total",
)


@query
def region_assets(t: Inputs) -> DataFrame:
    fills = {
        f"fill_{m}": F.array_join(L.layer_fill(m).cast("array<string>"), ",")
        for m in ("market_fit_score", "rent_affordability_score", "renter_share_2021")
    }
    return _assets(t, housing=True).select(*ASSET_COLUMNS).withColumns(fills)


@query
def region_geojson(t: Inputs) -> DataFrame:
    """The written features, read back."""
    lines = geo_features(_assets(t), ASSET_COLUMNS[:12])
    shape = (
        "type string, properties struct<sa2_code_2021:bigint,sa2_name_2021:string,market_fit_score:double,"
        "rent_stress_share:double>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    )
    f = F.from_json("value", shape)
    return lines.select(f.alias("f")).select(
        "f.type",
        "f.properties.*",
        F.col("f.geometry.type").alias("geometry_type"),
        F.size("f.geometry.coordinates").alias("rings"),
        F.col("f.geometry.coordinates")[0][0][0].alias("first_x"),
        F.col("f.geometry.coordinates")[0][0][1].alias("first_y"),
    )


@query
def region_top_bottom(t: Inputs) -> DataFrame:
    assets = _assets(t).select(*ASSET_COLUMNS[:10])
    fit = R.region_extremes(assets, "market_fit_score").withColumn("metric", F.lit("market_fit_score"))
    rent = R.region_extremes(assets, "rent_affordability_score").withColumn(
        "metric", F.lit("rent_affordability_score")
    )
    preview = top_k(assets.filter(F.col("market_fit_score").isNotNull()), 15, "market_fit_score", "sa2_code_2021")
    return fit.unionByName(rent).unionByName(
        preview.withColumns({"side": F.lit("top"), "metric": F.lit("preview")})
    )


# ---- scores and rankings -------------------------------------------------------------------


def _layers(t: Inputs) -> Layers:
    return Layers(t.transit, t.regions, t.fit, t.rent, t.suburbs)


MIN_ACTIVE = 20


def _gym(t: Inputs, layers: bool = False) -> DataFrame:
    """Scored gym areas, kept: several reports read them more than once."""
    return rank_areas(
        t.core_places, t.categories, GYM, layers=_layers(t) if layers else Layers(), min_active=MIN_ACTIVE
    )


@query
def guarded_minmax(t: Inputs) -> DataFrame:
    areas = cut_lineage(A.cell_counts(t.core_places).areas).withColumn("flat", F.lit(3.0))
    return S.scaled(areas, {"n_count": "poi_count", "n_lat": "lat_mean", "n_flat": "flat"}).select(
        "area_id", "n_count", "n_lat", "n_flat"
    )


@query
def opportunity_poi(t: Inputs) -> DataFrame:
    return _gym(t).drop("template", "lat_mean", "lon_mean")


@query
def opportunity_full(t: Inputs) -> DataFrame:
    return _gym(t, layers=True).drop("template", "lat_mean", "lon_mean")


@query
def opportunity_templates(t: Inputs) -> DataFrame:
    scored = score_templates(template_features(t.core_places, t.categories), min_active=MIN_ACTIVE)
    return scored.select(
        "template", "area_id", "active_poi_count", "competitor_count", "complementary_count",
        "commercial_other_count", "opportunity_score", "reasons_top3",
    )


@query
def opportunity_normalized_over(t: Inputs) -> DataFrame:
    scored = score_templates(
        template_features(t.core_places, t.categories),
        min_active=MIN_ACTIVE,
        normalize_over=F.col("active_poi_count") >= MIN_ACTIVE,
    )
    return scored.select("template", "area_id", "n_activity", "n_competition", "opportunity_score")


@query
def strategy_rescore(t: Inputs) -> DataFrame:
    features = template_features(t.core_places, t.categories, {"gym": GYM}).drop("template")
    out = None
    for mode in ("balanced", "low competition", "ecosystem-first"):
        part = rescore(features, mode, min_active=MIN_ACTIVE, min_quality=0.5).select(
            F.lit(mode).alias("strategy"), "rank", "area_id", "opportunity_score", "brief_reason"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def rank_per_template(t: Inputs) -> DataFrame:
    scored = score_templates(template_features(t.core_places, t.categories), min_active=0)
    return full_rank(scored, by_score(), by=("template",)).select("template", "area_id", "rank", "opportunity_score")


@query
def light_score(t: Inputs) -> DataFrame:
    cells = A.cell_counts(t.core_places)
    groups = C.complement_groups(t.categories).select("category_id").distinct()
    return S.light_score(
        cells.areas,
        A.sum_categories(cells.area_category_counts, C.competitor_categories(t.categories), "competitor_count"),
        A.sum_categories(cells.area_category_counts, groups, "complement_count"),
        area_quality(cells.area_pois),
    )


KEYWORDS = (["cafe", " Coffee ", ""], ["office", "university", "station"], ["juice", "serviced"])


@query
def custom_rank_keywords(t: Inputs) -> DataFrame:
    context = cut_lineage(
        S.opportunity(template_features(t.core_places, t.categories, {"gym": GYM}, layers=_layers(t)))
    )
    return custom_rank(t.core_places, t.categories, *KEYWORDS, context=context)


@query
def guardrails(t: Inputs) -> DataFrame:
    scored = cut_lineage(_gym(t, layers=True))
    plain = S.guardrails(scored, 60, 0.93).withColumn("rule", F.lit("plain"))
    premium = S.guardrails(scored, 60, 0.93, premium=True).withColumn("rule", F.lit("premium"))
    return plain.unionByName(premium).select("rule", "area_id", "active_poi_count", "market_fit_score")


@query
def topk_areas(t: Inputs) -> DataFrame:
    return top_k(_gym(t), 50).select("area_id", "opportunity_score", "active_poi_count", "reasons_top3")


@query
def diagnostic_top20(t: Inputs) -> DataFrame:
    return R.diagnostic_lists(cut_lineage(_gym(t)))


# ---- explanations and reports --------------------------------------------------------------


@query
def top_reasons(t: Inputs) -> DataFrame:
    scored = _gym(t, layers=True)
    return E.with_reasons(E.with_reasons(scored), mode="corrected", out="reasons_corrected").select(
        "area_id", "reasons_top3", "reasons_corrected"
    )


@query
def score_breakdown(t: Inputs) -> DataFrame:
    return E.score_breakdown(_gym(t, layers=True))


@query
def metrics_table(t: Inputs) -> DataFrame:
    return E.metrics_table(R.compatible(_gym(t, layers=True)))


@query
def metrics_payload(t: Inputs) -> DataFrame:
    shape = (
        "opportunity_score double, saturation_proxy double, mean_data_quality_score double, "
        "rent_affordability_score double, competitor_count bigint, complement_count bigint, reasons_top3 string"
    )
    return E.metrics_payload(_gym(t, layers=True)).select("area_id", F.from_json("payload", shape).alias("p")).select(
        "area_id", "p.*"
    )


@query
def area_narrative(t: Inputs) -> DataFrame:
    scored = _gym(t, layers=True)
    return scored.select("area_id", E.narrative(scored.columns, "Sydney", GYM.label).alias("narrative"))


@query
def strategy_cards(t: Inputs) -> DataFrame:
    return _gym(t).select("area_id", *[c.alias(n) for n, c in E.strategy_card("low competition").items()])


@query
def checklist(t: Inputs) -> DataFrame:
    scored = score_templates(template_features(t.core_places, t.categories), min_active=MIN_ACTIVE)
    return E.with_checklist(scored.select("template", "area_id"))


@query
def top_categories_per_area(t: Inputs) -> DataFrame:
    return R.top_categories(A.cell_counts(t.core_places).area_category_counts, t.categories)


@query
def competitor_examples(t: Inputs) -> DataFrame:
    return R.competitor_examples(
        A.cell_counts(t.core_places).area_pois, C.competitor_categories(t.categories), t.categories
    )


@query
def complement_breakdown(t: Inputs) -> DataFrame:
    return R.complement_breakdown(
        A.cell_counts(t.core_places).area_category_counts, C.complement_groups(t.categories)
    )


@query
def calibration_counts(t: Inputs) -> DataFrame:
    places = P.bbox_filter(t.core_places, SYDNEY)
    return R.calibration_counts(places, A.cell_counts(places).area_pois, C.competitor_categories(t.categories))


@query
def metro_ranked(t: Inputs) -> DataFrame:
    return compare_metros(t.core_places, t.categories, METROS).select(
        "metro_key", "area_id", "active_poi_count", "opportunity_score"
    )


@query
def metro_summary(t: Inputs) -> DataFrame:
    return metro_report(t.core_places, t.categories, METROS, min_active=MIN_ACTIVE)


@query
def metro_status(t: Inputs) -> DataFrame:
    return R.status_counts(metro_report(t.core_places, t.categories, METROS, min_active=MIN_ACTIVE))


@query
def alignment_check(t: Inputs) -> DataFrame:
    return R.alignment_check(_gym(t, layers=True))


@query
def compare_areas(t: Inputs) -> DataFrame:
    """The best, the busiest and the most saturated area side by side."""
    scored = cut_lineage(_gym(t, layers=True))
    picks = (
        top_k(scored, 1).select("area_id")
        .union(top_k(scored, 1, "active_poi_count").select("area_id"))
        .union(top_k(scored, 1, "saturation_proxy").select("area_id"))
    )
    rows = R.compatible(P.picked_from(scored, picks))
    return rows.select("area_id", *E.report_columns(rows.columns)).drop("recent_refresh_share", "template")


@query
def shortlist_notes(t: Inputs) -> DataFrame:
    scored = cut_lineage(_gym(t))
    notes = top_k(scored, 3, "active_poi_count").select(
        "area_id",
        F.lit("Visit").alias("shortlist_status"),
        F.concat(F.lit("see "), F.col("active_poi_count").cast("string"), F.lit(" places")).alias("shortlist_notes"),
    )
    noted = R.shortlist(scored.drop("lat_mean", "lon_mean"), notes)
    placed = R.with_area_centers(noted, A.cell_counts(t.core_places).areas)
    return placed.select("area_id", "opportunity_score", "shortlist_status", "shortlist_notes", "lat_mean", "lon_mean")


@query
def map_points(t: Inputs) -> DataFrame:
    return R.map_points(cut_lineage(top_k(_gym(t, layers=True), 100)))
