import math
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegrain.config import GYM, TEMPLATES, Taxonomy, Weights
from sitegrain.functions.geometry import covers, covers_from
from sitegrain.functions.numbers import sheet_number, steady_mean
from sitegrain.functions.text import clean_keywords, mentions_any
from sitegrain.operators import areas as A
from sitegrain.operators import roles as C
from sitegrain.operators import scoring as S
from sitegrain.operators import spatial as G
from sitegrain.operators.features import area_features
from sitegrain.operators.quality import poi_quality
from sitegrain.operators.ranking import by_score, full_rank
from sitegrain.operators.reasons import metrics_table, narrative, report_columns, shown, top_reasons
from sitegrain.plans.ranking import custom_rank
from sitegrain.sources.regions import indexed_regions

PLACES = "place_id string, name string, lat double, lon double, category_ids array<string>"


@pytest.fixture(scope="module")
def cats(spark):
    return spark.createDataFrame(
        [("g", "Gym", "Sports > Gym"), ("c", "Cafe", None), ("o", None, "Work > Office"), ("q'\\", "Yoga Loft", "x")],
        "category_id string, category_name string, category_label string",
    )


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(
        [
            ("1", "a", -33.87, 151.2, ["g", "c", "g", None]),
            ("2", None, -33.87, 151.2, []),
            ("3", "b", -33.87, 151.2, None),
            ("4", "c", -33.5, 150.9, ["o", "unknown", "q'\\"]),
            ("5", "d", None, 151.2, ["g"]),
        ],
        PLACES,
    )


def test_keywords(spark):
    assert clean_keywords([" Gym", "gym", "", None, "b "]) == ("b", "gym")
    df = spark.createDataFrame([("A GYM (new)",), ("c++ school",), (None,)], "t string")
    assert [r[0] for r in df.select(mentions_any(F.col("t"), ["gym (n", "c++"])).collect()] == [True, True, False]
    assert not any(r[0] for r in df.select(mentions_any(F.col("t"), [])).collect())


def test_roles_of_null_and_repeated_ids(places, cats):
    tx = {"gym": GYM.taxonomy, "own": Taxonomy(("office",), ("cafe",), ("yoga",), ())}
    got = {(r.place_id, r.template): r for r in C.place_roles(places, cats, tx).collect()}
    assert got["1", "gym"][2:] == (True, True, False, False, 2)
    assert got["4", "gym"][2:] == (True, False, False, True, 3)
    assert got["4", "own"][2:] == (True, False, True, False, 3)
    assert got["2", "gym"][2:] == got["3", "gym"][2:] == (False, False, False, False, 0)
    # Place ids say nothing about roles: null and repeated ones keep each row's own.
    renamed = places.withColumn("place_id", F.when(F.col("place_id") != "5", F.lit("same")))
    assert sorted(r[1:] for r in C.place_roles(renamed, cats, tx).collect()) == sorted(r[1:] for r in C.place_roles(places, cats, tx).collect())


def test_many_templates_and_many_categories(spark, places):
    """More flags than a mask has bits, more categories than lists, ids that occur twice."""
    n = 5 * C.MASK_LISTS
    many = spark.range(n).select(
        F.concat(F.lit("id"), "id").alias("category_id"), F.concat(F.lit("kind "), F.col("id") % 40, F.lit(".")).alias("category_name"),
        F.lit(None).cast("string").alias("category_label"),
    )
    twice = many.limit(1).withColumns({"category_id": F.lit("id7"), "category_name": F.lit("kind 39.")})
    tx = {f"t{i:02}": Taxonomy((f"kind {i}.",), ("kind 39.",), (), ()) for i in range(20)}
    listed = spark.createDataFrame([("a", [f"id{n - 1}", "id7", None, "no"]), (None, ["id7", "id7"]), ("b", None)], "place_id string, category_ids array<string>")
    got = C.place_roles(listed, many.union(twice), tx).collect()
    have = {(r.place_id, r.template) for r in got if r.is_competitor}
    assert have == {("a", f"t{(n - 1) % 40:02}"), ("a", "t07"), (None, "t07")} - {("a", "t39")}
    assert {r.place_id for r in got if r.is_complementary} == {"a", None} and len(got) == 60


def test_excluded_places_are_not_active(places, cats):
    own = {"own": Taxonomy(("office",), ("cafe",), ("gym",), ())}
    got = {r.area_id: r for r in area_features(places, cats, own).collect()}
    assert sorted((r.total_poi_count, r.active_poi_count) for r in got.values()) == [(1, 1), (3, 2)]


def test_custom_rank_counts_rows_of_ids(places, cats):
    got = {r.area_id: r for r in custom_rank(places, cats, ["gym"], ["cafe", "office"], ["yoga"]).collect()}
    # Entries count each, also repeated ones: place 1 lists the gym twice.
    assert sorted((r.poi_count, r.competitor_count, r.complement_count) for r in got.values()) == [(1, 0, 1), (3, 2, 1)]


def test_distinct_categories_merge_over_buckets(spark):
    """More ids than one bitmap holds, a crowded cell, repeated and null ids."""
    n = 70_000
    crowd = spark.range(n).select(F.lit(-33.87).alias("lat"), F.lit(151.2).alias("lon"), F.lit("a").alias("g"),
                                  F.array(F.concat(F.lit("c"), "id"), F.lit("c5"), F.lit(None)).alias("category_ids"))
    few = spark.createDataFrame([(-33.5, 150.9, "a", ["c5", "new"]), (-33.5, 150.9, "b", ["c5"]), (-33.5, 150.9, "b", None)], "lat double, lon double, g string, category_ids array<string>")
    places = crowd.union(few)
    ordinals = A.category_ordinals(places)
    assert rows(ordinals.agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal"))) == [(1, n + 1, n + 1)]
    bitmaps = A.category_bitmaps(places, ordinals, group_cols=("g",))
    assert sorted(r[-1] for r in A.distinct_categories(bitmaps).collect()) == [2, n]
    assert rows(A.distinct_categories(bitmaps, ("g",))) == [("a", n + 1), ("b", 1)]
    assert A.distinct_categories(A.category_bitmaps(places.limit(0), ordinals)).collect() == []


def test_quality_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", "c"), (None, 2.0, None, None)], "lat double, lon double, name string, category_id string")
    good, bad = [r.data_quality_score for r in poi_quality(df).collect()]
    assert good == 1.0 and bad == pytest.approx(0.25)
    flagged = df.withColumn("unresolved_flags", F.lit("x"))
    assert [r.data_quality_score for r in poi_quality(flagged).collect()] == pytest.approx([0.75, 0.0])


def test_steady_mean_ignores_order(spark):
    values = [random.Random(4).uniform(-180, 180) for _ in range(5000)]
    frames = [spark.createDataFrame([(v,) for v in vs], "v double").repartition(n)
              for vs, n in ((values, 3), (values[::-1], 8))]
    means = {f.agg(steady_mean(F.col("v"), 7)).first()[0] for f in frames}
    assert len(means) == 1 and means.pop() == pytest.approx(math.fsum(values) / 5000, abs=1e-7)
    assert frames[0].filter("false").agg(steady_mean(F.col("v"), 7)).first()[0] is None


def test_sheet_numbers(spark):
    df = spark.createDataFrame([("$1,234.5",), ("-",), ("(s)",), (" ",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(sheet_number(F.col("v"))).collect()] == [1234.5, None, None, None, None, None]


def test_hex_cells_hold_their_points(spark):
    rng = random.Random(3)
    pts = [(str(i), rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(2000)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    for level in (6, 8, 10):
        unit = A.AreaUnit(resolution=level)
        cells = A.with_area(df, unit).withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})
        back = A.with_area(A.with_centers(cells).withColumnRenamed("area_id", "cell"), unit)
        # Counted in an aggregate: a filter would be pushed below all of the cell arithmetic.
        assert back.agg(F.count_if(F.col("cell") != F.col("area_id"))).first()[0] == 0
    with pytest.raises(ValueError):
        A.AreaUnit(resolution=5)
    with pytest.raises(ValueError):
        A.AreaUnit("county")
    with pytest.raises(ValueError):
        A.with_area(df, A.AreaUnit("locality"))
    off = spark.createDataFrame([("x", None, 1.0), ("y", 95.0, 1.0)], "id string, lat double, lon double")
    assert [r.area_id for r in A.with_area(off).collect()] == [None, None]
    assert A.with_area_key(off).count() == 0


def test_locate_equals_brute_force_with_very_different_region_sizes(spark):
    rng = random.Random(5)
    shapes = []
    for order in range(60):
        cx, cy, size = rng.uniform(140, 150), rng.uniform(-38, -30), 10 ** rng.uniform(-2.5, 0.9)
        n = rng.randint(3, 7)
        ring = [(cx + size * math.cos(2 * math.pi * k / n), cy + size * math.sin(2 * math.pi * k / n)) for k in range(n)]
        shapes.append((order * 7, f"r{order}", order, [ring]))
    table = spark.createDataFrame(shapes, "code bigint, name string, region_order bigint, rings array<array<struct<x:double,y:double>>>")
    pts = [(i, rng.uniform(-39, -29), rng.uniform(139, 151)) for i in range(800)]
    points = spark.createDataFrame(pts, "id bigint, lat double, lon double")

    def brute(lat, lon):
        for code, _, _, rings in shapes:
            inside = False
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                    if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                        inside = not inside
            if inside:
                return code
        return None

    indexed = indexed_regions(table)
    got = G.locate(points, indexed, "id", "lat", "lon", "code", "name")
    assert {r.id: r.code for r in got.collect()} == {i: brute(lat, lon) for i, lat, lon in pts}
    touched = G.cover_index(indexed).groupBy("region_order").count()
    assert touched.agg(F.max("count")).first()[0] <= 4
    assert G.locate(points, indexed.filter("false"), "id", "lat", "lon", "c", "n").filter("c is null").count() == 800


def _star(rng, x, y, size, n):
    return [
        (x + size * (0.6 + 0.4 * math.sin(14 * math.pi * k / n) + rng.uniform(-0.01, 0.01)) * math.cos(2 * math.pi * k / n),
         y + size * (0.6 + 0.4 * math.sin(14 * math.pi * k / n)) * math.sin(2 * math.pi * k / n))
        for k in range(n)
    ]


def test_cover_equals_the_ray_cast_on_every_region(spark):
    """Many-edged, spiky and overlapping shapes with holes; points anywhere, on grid lines and on corners."""
    rng = random.Random(2)
    shapes = [
        (i, [_star(rng, rng.uniform(0, 2), rng.uniform(0, 2), rng.uniform(0.01, 0.5), rng.choice([3, 5, 12, 40, 300])), _star(rng, 1, 1, 0.2, 20)])
        for i in range(40)
    ]
    shapes += [(100, [[(0.0, 0.0), (1.28, 0.0), (1.28, 1.28), (0.0, 1.28), (0.0, 0.0)], [(0.32, 0.32), (0.64, 0.32), (0.64, 0.64), (0.32, 0.64)]]), (101, None)]
    shapes.append((102, [[(1 + 0.8 * math.cos(k / 500), 1 + 0.8 * math.sin(k / 500)) for k in range(3141)]]))
    kind = "region_order bigint, rings array<array<struct<x:double,y:double>>>"
    indexed = indexed_regions(spark.createDataFrame(shapes, kind).selectExpr("region_order as code", "'n' as name", "*")).persist()
    spots = [(rng.uniform(-0.2, 2.4), rng.uniform(-0.2, 2.4)) for _ in range(1500)] + [(i * 0.04, j * 0.04) for i in range(40) for j in range(40)]
    spots += [p for _, rings in shapes[:10] for ring in rings for p in ring[:40]]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "id long, x double, y double").persist()
    plain = points.join(indexed, covers(F.col("edges"), F.col("x"), F.col("y"))).select("id", "region_order")
    cells = G.cover_index(indexed).persist()
    size = F.lit(G.BASE_DEGREES) * F.pow(F.lit(2.0), F.col("grid_level"))
    same = (F.floor(F.col("x") / size) == F.col("grid_x")) & (F.floor(F.col("y") / size) == F.col("grid_y"))
    found = points.join(cells, same & covers_from(F.col("own"), F.col("ends"), F.col("odd"), F.col("x"), F.col("y"))).select("id", "region_order")
    assert rows(found) == rows(plain) and len(rows(plain)) > 3000
    assert cells.filter("size(own) = 0").count() > 0
    indexed.unpersist(), points.unpersist(), cells.unpersist()


def test_a_region_of_100000_corners(spark):
    rng = random.Random(8)
    ring = _star(rng, 1.0, 1.0, 1.0, 100_000)
    table = spark.createDataFrame([(1, "big", 1, [ring])], "code long, name string, region_order long, rings array<array<struct<x:double,y:double>>>")
    indexed = indexed_regions(table).persist()
    cover = G.cover_index(indexed).persist()
    stats = cover.agg(F.count("*").alias("n"), F.avg(F.size("own")).alias("edges"), F.count_if(F.size("own") == 0).alias("inside")).first()
    assert stats.n < 20_000 and stats.edges < 100 and stats.inside > stats.n / 2
    spots = [(i, rng.uniform(0, 2), rng.uniform(0, 2)) for i in range(150)]
    points = spark.createDataFrame(spots, "id long, lat double, lon double")
    got = {r.id for r in G.locate(points, indexed, "id", "lat", "lon", "c", "n", cover).collect() if r.c == 1}
    x1, y1 = (np.array(v) for v in zip(*ring))
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = {i for i, lat, lon in spots if (((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)).sum() % 2}
    assert got == want
    indexed.unpersist(), cover.unpersist()


def test_scaled_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, None), ("a", 3.0, 5.0, 2.0), ("b", 7.0, 5.0, 4.0)], "g string, v double, f double, n double")
    got = S.scaled(df, {"nv": "v", "nf": "f", "nn": "n"}).orderBy("v").collect()
    assert [r.nv for r in got] == pytest.approx([0, 1 / 3, 1]) and {r.nf for r in got} == {0.0}
    assert [r.nn for r in got] == [None, 0.0, 1.0]
    grouped = S.scaled(df, {"nv": "v"}, by="g").orderBy("v").collect()
    assert [r.nv for r in grouped] == [0.0, 1.0, 0.0]
    limited = S.scaled(df, {"nv": "v"}, over=F.col("g") == "a").orderBy("v").collect()
    assert [r.nv for r in limited] == [0.0, 1.0, 3.0]


def test_published_rows_replay(spark):
    """Ranked rows as published for the coworking template: parts, sum and reasons must come out the same."""
    # n_complementarity, n_activity, n_diversity, n_competition, n_saturation, n_quality, n_transit, n_market_fit, n_rent
    published = [
        ((0.39824486467596004, 0.8752891412649441, 0.8816086430916826, 0.014037813399280365, 0.009155202207228146, 0.0,
          1.0, 0.7256719706548818, 0.7359349748504195), 3.074324724277725,
         "High commercial activity; Strong transit access; High category diversity"),
        ((0.43800476323527454, 1.0, 1.0, 0.010543692570450248, 0.00650810391019616, 0.0, 0.0, 0.7256719706548818,
          0.7359349748504195), 2.710587273585321, "High commercial activity; High category diversity; Strong market fit"),
        ((0.7747921902184419, 0.688395620960142, 0.7221105113817671, 0.006665689090968891, 0.002148698058139266, 0.0, 0.0,
          0.9355571691475644, 0.8398433908115511), 2.7089582177822034,
         "Strong complements; High commercial activity; Strong market fit"),
    ]
    w = TEMPLATES["coworking"].weights
    df = spark.createDataFrame([(*n, s, r) for n, s, r in published],
                               ", ".join(f"{p[1]} double" for p in S.PARTS) + ", want double, why string")
    df = df.withColumns({part: F.lit(sign * getattr(w, f)) * F.col(n) for part, n, f, sign in S.PARTS})
    df = df.withColumn("got", sum((F.col(p[0]) for p in S.PARTS[1:]), F.col(S.PARTS[0][0])))
    for r in df.withColumn("reasons", top_reasons(df.columns)).collect():
        assert r.got == pytest.approx(r.want, abs=1e-12) and r.reasons == r.why


def test_absent_layers_score_zero(spark):
    base = {"area_id": "a", "complementarity_ratio": 0.5, "commercial_activity_proxy": 3, "unique_category_count": 2,
            "competitor_density_proxy": 0.1, "saturation_proxy": 0.1, "mean_data_quality_score": 1.0}
    other = dict(base, area_id="b", commercial_activity_proxy=9, mean_data_quality_score=0.5)
    got = {r.area_id: r for r in S.opportunity(spark.createDataFrame([base, other]), Weights()).collect()}
    assert got["a"].n_transit == got["b"].n_rent_affordability == 0.0
    assert got["b"].score_activity == 0.8 and got["a"].score_quality == 0.5
    with pytest.raises(ValueError, match="lack"):
        S.require_columns(spark.createDataFrame([base]))


def test_full_rank_equals_window(spark):
    rng = random.Random(9)
    data = [(f"a{i:04d}", rng.choice("xxxxxy") + rng.choice("12"), rng.choice([0.5, 0.5, rng.random(), None])) for i in range(3000)]
    df = spark.createDataFrame(data, "area_id string, g string, opportunity_score double").repartition(6)
    order = [F.col("opportunity_score").desc_nulls_last(), F.col("area_id").asc()]
    overall = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    assert rows(full_rank(df, by_score())) == rows(overall)
    grouped = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    assert rows(full_rank(df, by_score(), by=("g",))) == rows(grouped)


def test_texts(spark):
    df = spark.createDataFrame([(0.125, 1234567.0, None, "h3cell123", 3, 20, 1.5, "Strong complements")],
                               "a double, b double, c double, area_id string, competitor_count int, complement_count int, "
                               "opportunity_score double, reasons_top3 string")
    got = df.select(shown(F.col("a"), "float2"), shown(F.col("b"), "int0"), shown(F.col("c"), "float3"),
                    shown(F.col("b"), "float1"), shown(F.col("a"), "pct1"), shown(F.lit("  "), "str")).first()
    assert tuple(got) == ("0.12", "1,234,567", "—", "1,234,567.0", "12.5%", "—")
    text = df.select(narrative(df.columns, "Sydney", "Café")).first()[0]
    for piece in ("1.500", "Sydney", "Café", "Validate on site", "**3** competitor-style", "Strong complements"):
        assert piece in text
    assert "data quality" not in text and "null" not in text.lower()
    table = metrics_table(df)
    assert {r.field for r in table.collect()} == {"opportunity_score", "competitor_count", "complement_count"}
    assert report_columns(["z", "complementary_count", "complement_count", "reasons_top3", "area_id", "opportunity_score",
                           "sa2_name_2021"]) == ["sa2_name_2021", "opportunity_score", "complement_count", "reasons_top3", "z"]
