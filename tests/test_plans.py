"""Shapes that must hold for the plans to scale."""

from pyspark.sql import functions as F

from sitegrain.config import GYM, TEMPLATES
from sitegrain.operators import areas as A
from sitegrain.operators import roles as C
from sitegrain.operators import scoring as S
from sitegrain.operators import spatial as G
from sitegrain.operators.features import area_features
from sitegrain.operators.reports import competitor_examples, top_categories
from workload.inputs import METROS


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def stored(spark, inputs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("places") / "p")
    inputs.core_places.write.parquet(path)
    return spark.read.parquet(path)


def test_area_features_is_one_scan_and_one_shuffle(spark, inputs, tmp_path_factory):
    places = stored(spark, inputs, tmp_path_factory)
    df = area_features(places, inputs.categories, {k: t.taxonomy for k, t in TEMPLATES.items()})
    plan = physical(df)
    assert plan.count("Exchange") == 1 and plan.count("FileScan parquet") == 1
    assert "Python" not in plan and "Join" not in plan
    assert "GreaterThanOrEqual(lat,-90.0)" in plan
    assert "place_id" not in plan.split("ReadSchema")[1]


def test_place_roles_needs_no_shuffle(spark, inputs, tmp_path_factory):
    places = stored(spark, inputs, tmp_path_factory)
    plan = physical(C.place_roles(places, inputs.categories, {"gym": GYM.taxonomy}))
    assert "Exchange" not in plan and "Join" not in plan
    assert "Filter (" not in plan


def test_spatial_join_is_an_equi_join(inputs):
    areas = A.cell_counts(inputs.core_places).areas
    plan = physical(G.locate(areas, inputs.regions, "area_id", "lat_mean", "lon_mean", "c", "n"))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BroadcastHashJoin" in plan


def test_cover_is_built_once(inputs):
    areas = A.cell_counts(inputs.core_places).areas
    plan = optimized(G.locate(areas, inputs.regions, "area_id", "lat_mean", "lon_mean", "c", "n"))
    built = [line for line in plan.splitlines() if "Generate explode(" in line and "[grid_y#" in line]
    assert len(built) == 1, built


def test_scoring_has_no_join_and_no_global_window(inputs):
    features = area_features(inputs.core_places, inputs.categories, {"gym": GYM.taxonomy})
    plan = physical(S.opportunity(features, GYM.weights))
    assert "Window" not in plan and "Join" not in plan


def test_top_lists_are_limited_before_the_shuffle(inputs):
    cells = A.cell_counts(inputs.core_places)
    assert "WindowGroupLimit" in physical(top_categories(cells.area_category_counts, inputs.categories))
    best = physical(competitor_examples(cells.area_pois, C.competitor_categories(inputs.categories), inputs.categories))
    assert best.count("WindowGroupLimit") == 2


def test_metro_tag_is_a_projection(inputs):
    from sitegrain.operators.reports import with_metro

    assert "Join" not in physical(with_metro(inputs.core_places, METROS))


def test_row_operators_accept_a_stream(spark, inputs, tmp_path):
    """Stateless operators also run on a streaming DataFrame, with the batch result."""
    from sitegrain.config import SYDNEY
    from sitegrain.operators.quality import poi_quality
    from sitegrain.operators.subset import bbox_filter

    path = str(tmp_path / "in")
    inputs.core_places.write.parquet(path)
    stream = spark.readStream.schema(inputs.core_places.schema).parquet(path)

    def steps(df):
        flagged = C.with_roles(bbox_filter(df, SYDNEY), inputs.categories, {"gym": GYM.taxonomy})
        return A.with_area(poi_quality(flagged)).select("place_id", "area_id", "data_quality_score", "roles")

    out = str(tmp_path / "out")
    query = (
        steps(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination(120)
    got, want = spark.read.parquet(out), steps(spark.read.parquet(path))
    assert got.count() == want.count() > 0
    assert got.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first() == want.agg(
        F.sum(F.xxhash64("*").cast("decimal(38,0)"))
    ).first()
