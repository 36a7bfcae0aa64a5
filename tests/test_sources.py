import json

import pytest
from helpers import rows

from sitegrain.operators.spatial import locate
from sitegrain.sources import census, housing, regions, sinks, transport


def test_points_csv_with_odd_headers_and_cells(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("Stop_Name,MODE,Lat,LONG\nA,Ferry,-33.5,151\nB,,oops,151\nC,,,\nD,,-33.6,151.5\n")
    got = transport.read_points_csv(spark, str(f), "s", name_names=transport.FACILITY_NAME_NAMES)
    assert rows(got) == [("Ferry", "s", -33.5, 151.0, "A"), (None, "s", -33.6, 151.5, "D")]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="coordinate"):
        transport.read_points_csv(spark, str(bad), "s")


def test_points_geojson_skips_malformed(spark, tmp_path):
    features = [
        {"geometry": {"coordinates": [151.2, -33.8]}, "properties": {"LOCATION": "Here"}},
        {"geometry": {"coordinates": ["151.3", "-33.9"]}, "properties": {"name": "There"}},
        {"geometry": None, "properties": {}},
        {"geometry": {"coordinates": [151.2]}, "properties": {}},
        {"geometry": {"coordinates": ["x", "y"]}, "properties": {}},
        {"geometry": {"coordinates": [151.4, -33.7]}, "properties": None},
    ]
    f = tmp_path / "p.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = transport.read_points_geojson(spark, str(f), "shelters")
    assert sorted((r.lat, r.lon, r.name) for r in got.collect()) == [
        (-33.9, 151.3, "There"), (-33.8, 151.2, "Here"), (-33.7, 151.4, None),
    ]
    both = transport.combine_points(got, transport.empty_points(spark).drop("name"))
    assert both.count() == 3 and "name" in both.columns


def test_noted_csv_and_rent_stress(spark, tmp_path):
    f = tmp_path / "raid.csv"
    head = ",".join(census.RENT_COLUMNS)
    body = [
        f"SA2 2021,101,\"Town, East\",{census.INDICATOR},{census.RENTING},400",
        f"SA2 2021,101,\"Town, East\",{census.INDICATOR},{census.STRESSED},100",
        f"SA2 2021,102,Hill,{census.INDICATOR},{census.RENTING},50.0",
        f"SA2 2021,103,Only stress,{census.INDICATOR},{census.STRESSED},9",
        f"LGA 2021,9,Shire,{census.INDICATOR},{census.RENTING},999",
        f"SA2 2021,104,Other,Another indicator,{census.RENTING},7",
    ]
    f.write_text("\n".join(["Note: some words, and a comma", head, *body]) + "\n")
    got = census.rent_stress_households(census.read_noted_csv(spark, str(f)))
    assert rows(got) == [(101, "Town, East", 100, 400), (102, "Hill", 0, 50)]
    from sitegrain.operators.layers import rent_affordability

    scored = {r[0]: r for r in rent_affordability(got).collect()}
    assert scored[101].rent_stress_share == pytest.approx(100 / 401)
    assert scored[101].rent_affordability_score == pytest.approx(1 - 100 / 401)
    assert scored[102].rent_affordability_score is None and scored[102].rent_stress_share == 0.0


def test_noted_csv_of_two_files_over_many_splits(spark, tmp_path):
    """Notes with commas, blank headings, 70 columns, another order in the second file, splits of a few lines."""
    cols = census.RENT_COLUMNS
    head_a = [cols[0], "", *[f"x{i}" for i in range(62)], " ", *cols[1:], ""]
    def line(head, row):
        return ",".join(row.get(h, "z") for h in head)

    data = [{c: f"{c[:4]}{i}" for c in cols} for i in range(400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([f"{cols[0]} notes, of a kind", "a,b,c,d,e,f", ",".join(head_a), *[line(head_a, r) for r in data[:200]]]))
    head_b = [cols[0], *reversed(cols[1:])]
    (tmp_path / "in" / "b.csv").write_text("\n".join([",".join(head_b), *[line(head_b, r) for r in data[200:]], "short"]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = census.read_noted_csv(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 3
        assert rows(got) == sorted((tuple(r[c] for c in cols) for r in data), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "in" / "c.csv").write_text("no header,at all\n")
    with pytest.raises(ValueError, match="1 of 3 files"):
        census.read_noted_csv(spark, str(tmp_path / "in"))


def test_feature_lines_split_and_reject(spark, tmp_path):
    good = [json.dumps({"type": "Feature", "properties": {"name": f"p{i}"}, "geometry": {"type": "Point", "coordinates": [i / 10, -i / 10]}}) for i in range(900)]
    lines = [*good[:300], "", "  ", "{broken", "[1, 2]", "\x1e" + good[300], "plain words", *good[301:], '{"other": 1}']
    f = tmp_path / "p.geojsonl"
    f.write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        points, rejects = transport.read_point_lines(spark, str(f), "s")
        assert points.rdd.getNumPartitions() > 5
        assert sorted(r.lat for r in points.collect()) == sorted(-i / 10 for i in range(900))
        assert sorted(r.bad for r in rejects.collect()) == sorted(["{broken", "[1, 2]", "plain words", '{"other": 1}'])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_multipolygons_round_trip(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.5], [0.0, 4.0]]
    hole, island = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0]], [[10.5, 10.0], [11.0, 10.0], [11.0, 11.25]]
    shapes = {1: [[ring, hole]], 2: [[ring, hole], [island]], 3: [[island], [ring], [hole]]}
    lines = [
        json.dumps({"type": "Feature", "properties": {"code": str(k), "name": None if k == 2 else f"n{k}"},
                    "geometry": {"type": "Polygon", "coordinates": v[0]} if len(v) == 1 else {"type": "MultiPolygon", "coordinates": v}})
        for k, v in shapes.items()
    ]
    (tmp_path / "in.geojsonl").write_text("\n".join([*lines, '{"type":"Feature","properties":{"code":"4"},"geometry":null}']))
    table, rejects = regions.read_region_lines(spark, str(tmp_path / "in.geojsonl"), "code", "name")
    assert rejects.count() == 0 and {r.code: r.ring_parts for r in table.collect()} == {1: [0, 0], 2: [0, 0, 1], 3: [0, 1, 2]}
    sinks.write_geojson_lines(table, str(tmp_path / "out"), ["code", "name"])
    back = {b["properties"]["code"]: b for b in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "out")).collect()))}
    assert {k: b["geometry"] for k, b in back.items()} == {
        k: {"type": "Polygon", "coordinates": v[0]} if len(v) == 1 else {"type": "MultiPolygon", "coordinates": v} for k, v in shapes.items()
    }
    assert back[2]["properties"] == {"code": 2, "name": None}
    again, _ = regions.read_region_lines(spark, str(tmp_path / "out"), "code", "name")
    assert rows(again.drop("region_order")) == rows(table.drop("region_order"))


def test_tenure_json(spark, tmp_path):
    f = tmp_path / "t.json"
    rowsin = [
        {"attributes": {"sa2_code_2021": "11", "sa2_name_2021": "A", "r_tot_total": 30, "total_total": 99}},
        {"attributes": {"sa2_code_2021": 12, "sa2_name_2021": "B", "r_tot_total": "n/a", "total_total": 5}},
    ]
    f.write_text(json.dumps({"features": rowsin}))
    from sitegrain.operators.layers import renter_share

    got = renter_share(census.read_tenure_json(spark, str(f)))
    assert rows(got) == [(11, "A", 30, 99, 0.3), (12, "B", None, 5, None)]


def test_messy_sheets(spark, tmp_path):
    f = tmp_path / "rent.csv"
    f.write_text(
        "Rent tables,,,,\nAll about postcode areas,,,,\n"
        'Postcode,Dwelling Types,Number of Bedrooms,"Median Weekly Rent\n$",New Bonds Lodged\n'
        '2000,Total,Total,"$1,050","1,234"\n2000,House,Total,999,5\n2001, total , TOTAL ,-,s\nSource,x,,,\n2002,Total,2,1,1\n'
    )
    sheet = housing.read_sheet(spark, str(f))
    assert rows(housing.rent_by_postcode(sheet)) == [(2000, 1050.0, 1234), (2001, None, None)]
    g = tmp_path / "sales.csv"
    g.write_text('Title,,,\nPostcode,Dwelling Type,Median Sales Price,"Sales\nNo."\n2000,Total,"1,500.5",12\n2000,Strata,1,1\n')
    assert rows(housing.sales_by_postcode(housing.read_sheet(spark, str(g)))) == [(2000, 1500500.0, 12)]
    with pytest.raises(ValueError, match="header"):
        housing.header_names(spark.createDataFrame([("x",)], "_c0 string"))


def test_polygons_round_trip(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    far = [[[[10, 10], [12, 10], [12, 12], [10, 12], [10, 10]]], [[[20, 20], [21, 20], [21, 21], [20, 21], [20, 20]]]]
    features = [
        {"properties": {"code": "1", "name": "Ring"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"code": "2", "name": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": far}},
        {"properties": {"code": "ZZ", "name": "bad"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"code": "3", "name": "none"}, "geometry": None},
    ]
    f = tmp_path / "r.geojson"
    f.write_text(json.dumps({"features": features}))
    table = regions.read_regions_geojson(spark, str(f), "code", "name")
    assert [r.code for r in table.orderBy("code").collect()] == [1, 2]
    points = spark.createDataFrame(
        [("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("part2", 20.5, 20.5), ("out", 9.0, 9.0), ("null", None, 1.0)],
        "id string, lat double, lon double",
    )
    got = locate(points, regions.indexed_regions(table), "id", "lat", "lon", "code", "name")
    assert {r.id: r.code for r in got.collect()} == {"in": 1, "hole": None, "part2": 2, "out": None, "null": None}

    out = str(tmp_path / "out")
    sinks.write_geojson_lines(table, out, ["code", "name"])
    back = [json.loads(r.value) for r in spark.read.text(out).collect()]
    by = {b["properties"]["code"]: b for b in back}
    assert by[1]["type"] == "Feature" and by[1]["geometry"]["coordinates"][0][1] == [4.0, 0.0]
    assert len(by[2]["geometry"]["coordinates"]) == 2


def test_csv_and_parquet_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 as city")
    sinks.write_top_csv(df, str(tmp_path / "top"), 5, ["id"])
    parts = list((tmp_path / "top").glob("*.csv"))
    assert len(parts) == 1 and parts[0].read_text().splitlines() == ["id,city", "0,0", "1,1", "2,2", "3,0", "4,1"]
    sinks.write_parquet(df, str(tmp_path / "pq"), ["city"])
    assert spark.read.parquet(str(tmp_path / "pq")).where("city = 1").count() == 33
    sinks.write_report_csv(df.limit(2), str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep")).count() == 2


def test_empty_sources_keep_their_types(spark):
    from sitegrain.operators.layers import market_fit, rent_affordability

    assert market_fit(census.empty_seifa(spark)).count() == 0
    assert rent_affordability(census.empty_rent_stress(spark)).count() == 0
    assert dict(housing.empty_rent(spark).dtypes)["bonds_lodged_total"] == "bigint"
    assert census.empty_tenure(spark).count() == housing.empty_sales(spark).count() == 0
