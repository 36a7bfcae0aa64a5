import hashlib
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from sitegrain.config import SYDNEY, BoundingBox
from sitegrain.operators import subset as P
from sitegrain.plans.subsets import city_places, country_places
from sitegrain.sources import places as SP
from sitegrain.sources.profile import Funnel, profile_markdown, schema_profile
from sitegrain.sources.sinks import write_clustered, z_order

RAW = "fsq_place_id string, name string, latitude double, longitude double, country string, fsq_category_ids array<string>"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        [
            ("a", "A", -33.9, 151.2, "AU", ["x"]),
            ("b", "B", -37.8, 144.9, "AU", ["y"]),
            ("c", "C", 40.0, -70.0, "US", ["z"]),
        ],
        RAW,
    )


def test_country_then_city(raw):
    funnel = Funnel()
    au = country_places(raw, "AU", funnel)
    city = city_places(au, funnel=funnel)
    assert [r.place_id for r in city.collect()] == ["a"]
    assert [n for _, n in funnel.counts()] == [3, 2, 2, 2, 1]
    assert au.count() == 2


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError, match="required"):
        SP.canonical_places(spark.createDataFrame([("a", 1.0)], "id string, lat double"))


def test_absent_optional_columns_are_typed_nulls(spark):
    df = SP.canonical_places(spark.createDataFrame([("a", "n", 1.0, 2.0)], "id string, name string, lat double, lng double"))
    assert dict(df.dtypes) == SP.PLACE_TYPES
    assert tuple(df.first()) == ("a", "n", 1.0, 2.0, None, None)


def test_flags_keep_nulls_by_default(spark):
    df = spark.createDataFrame([("a", None), ("b", "stale"), ("c", "x;duplicate")], "id string, unresolved_flags string")
    assert [r.id for r in P.drop_flagged(df).orderBy("id").collect()] == ["a", "b"]
    assert [r.id for r in P.drop_flagged(df, keep_null=False).collect()] == ["b"]
    arr = spark.createDataFrame([("a", None), ("b", ["stale", "delete"]), ("c", [])], "id string, unresolved_flags array<string>")
    assert [r.id for r in P.drop_flagged(arr).orderBy("id").collect()] == ["a", "c"]


def test_country_case_and_fallback(spark):
    df = spark.createDataFrame([("a", "au", -33.0, 151.0), ("b", None, -33.0, 151.0), ("c", "AU", 1.0, 1.0)],
                               "id string, country string, lat double, lon double")
    assert [r.id for r in P.country_filter(df, "AU", ignore_case=True).orderBy("id").collect()] == ["a", "c"]
    assert [r.id for r in P.country_filter(df, "AU").collect()] == ["c"]
    assert [r.id for r in P.country_filter(df.drop("country"), "AU").orderBy("id").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        P.city_subset(df, strategy="guess")


def test_sample_is_exact_repeatable_and_spread(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("place_id"), F.col("id").alias("v"))
    one = SP.capped_sample(df.repartition(7), 1500)
    two = SP.capped_sample(df.repartition(3), 1500)
    assert one.columns == df.columns
    assert rows(one) == rows(two) and one.count() == 1500
    assert 9_000 < one.agg(F.avg("v")).first()[0] < 11_000
    assert SP.capped_sample(df, 30_000).count() == 20_000
    assert rows(SP.capped_sample(df, 1500, seed=7)) != rows(one)


def test_bbox_reaches_the_scan(spark, raw, tmp_path):
    path = str(tmp_path / "p")
    raw.write.parquet(path)
    got = SP.scan_metro(SP.read_parquet(spark, path), SYDNEY, "AU")
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(latitude,-34.2)" in plan and "EqualTo(country,AU)" in plan
    assert [r.place_id for r in got.collect()] == ["a"]
    assert SP.scan_metro(SP.read_parquet(spark, path), SYDNEY, max_rows=1).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SP.read_parquet(spark, str(tmp_path / "nothing"))


def test_nested_shards_and_compaction(spark, raw, tmp_path):
    raw.repartition(3).write.parquet(str(tmp_path / "r" / "deep" / "p"))
    assert SP.compact(spark, str(tmp_path / "r"), str(tmp_path / "one"), recursive=True) == 1
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "one")).count() == 3


def test_compaction_follows_sizes(spark, tmp_path):
    wide = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    wide.repartition(30).write.parquet(str(tmp_path / "many"))
    given = sum(p.stat().st_size for p in (tmp_path / "many").glob("*.parquet"))
    target = given // 3
    assert SP.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), target) == 4
    sizes = [p.stat().st_size for p in (tmp_path / "few").glob("*.parquet")]
    assert len(sizes) == 4 and max(sizes) < target and min(sizes) > target // 2
    back = spark.read.parquet(str(tmp_path / "few"))
    assert back.exceptAll(wide).count() == 0 and back.count() == 60_000


def test_clustered_layout_skips_row_groups(spark, tmp_path):
    """A third of the rows sit on one spot; a box elsewhere touches few files of either partition."""
    import pyarrow.parquet as pq

    spread = F.when(F.col("id") % 3 == 0, 0.5)
    table = spark.range(60_000).select(
        "id", F.coalesce(spread, F.rand(1) * 100 - 50).alias("lat"), F.coalesce(spread, F.rand(2) * 100 - 50).alias("lon"), (F.col("id") % 2).alias("part")
    )
    write_clustered(table, str(tmp_path / "z"), ["part"], files=24)
    box = BoundingBox(20.0, 30.0, -30.0, -20.0)

    def touched(folder):
        hits = total = 0
        for f in folder.rglob("*.parquet"):
            meta = pq.read_metadata(f)
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                y, x = (meta.row_group(g).column(at[c]).statistics for c in ("lat", "lon"))
                total += 1
                hits += y.max >= box.min_lat and y.min <= box.max_lat and x.max >= box.min_lon and x.min <= box.max_lon
        return hits, total

    hits, total = touched(tmp_path / "z")
    assert total >= 20 and hits <= total // 4
    got = spark.read.parquet(str(tmp_path / "z"))
    assert got.count() == 60_000
    inside = f"lat between {box.min_lat} and {box.max_lat} and lon between {box.min_lon} and {box.max_lon}"
    assert rows(got.filter(inside).select("id")) == rows(table.filter(inside).select("id"))
    write_clustered(table.filter("part = 1").limit(7), str(tmp_path / "z"), ["part"], files=1)
    assert dict(map(tuple, spark.read.parquet(str(tmp_path / "z")).groupBy("part").count().collect())) == {0: 30_000, 1: 7}


def test_clustered_layout_spreads_one_spot(spark, tmp_path):
    """All rows at one place: they are dealt over the files."""
    import pyarrow.parquet as pq

    table = spark.range(20_000).select("id", F.lit(-33.87).alias("lat"), F.lit(151.207).alias("lon"), F.lit("AU").alias("part"))
    write_clustered(table, str(tmp_path / "one"), ["part"], files=8)
    sizes = [pq.read_metadata(f).num_rows for f in (tmp_path / "one").rglob("*.parquet")]
    assert sum(sizes) == 20_000 and len(sizes) >= 6 and max(sizes) < 6_000


def test_curve_position_interleaves_bits(spark):
    given = [(-90.0, -180.0), (90.0, 180.0), (-33.87, 151.207), (12.5, -0.1), (0.0, None), (None, 0.0)]
    got = spark.createDataFrame(given, "lat double, lon double").select(z_order(F.col("lat"), F.col("lon"))).collect()

    def plain(lat, lon):
        y, x = (min(max(int((v - low) / span * 65536), 0), 65535) for v, low, span in ((lat, -90.0, 180.0), (lon, -180.0, 360.0)))
        return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(16))

    assert [r[0] for r in got] == [plain(*g) for g in given[:4]] + [None, None]


def test_sample_of_hot_and_repeated_rows(spark):
    """Two thirds of the rows share one id, a third is one row over and over; the order is that of the two hashes."""
    given = [("hot", i % 300) for i in range(600)] + [("same", 1)] * 600 + [(f"p{i}", i) for i in range(300)] + [(None, 1)] * 3
    df = spark.createDataFrame(given, "place_id string, v int").repartition(5)

    def digest(text):
        return hashlib.md5(f"{text}|42".encode()).hexdigest()

    order = sorted(given, key=lambda r: (digest(r[0] or ""), digest(json.dumps({"place_id": r[0], "v": r[1]}, separators=(",", ":")))))
    for n in (0, 1, 7, 300, 700, 1_000, 1_400, 1_503, 2_000):
        assert sorted(map(tuple, SP.capped_sample(df, n).collect()), key=str) == sorted(order[:n], key=str)


def test_profile(raw):
    by = {r.field: r for r in schema_profile(raw).collect()}
    assert by["latitude"].present and by["latitude"].null_count == 0
    assert not by["locality"].present and by["locality"].null_count is None
    assert "| locality | - | no |" in profile_markdown(schema_profile(raw), "Places")
