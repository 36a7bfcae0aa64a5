"""Site-selection inputs derived from the given tables, whole.

Every input is a projection or aggregate of a complete table, so it grows with the data.
Row-level expressions are written once and used by both Spark and the checking SQL.

* places: one per ``lineitem`` row. A third of them sit in one city centre and share one
  locality, so every area-level operator meets a hot key.
* categories: from ``part``; transport points: from ``orders`` and ``customer``;
  regions and the socio-economic sheet: from ``supplier``; suburbs: from ``customer``;
  rent stress: from ``lineitem``; tenure, mesh blocks and sales: from ``orders``;
  rents: from ``customer``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.config import BoundingBox, City
from sitegrain.operators.layers import (
    housing_by_region,
    market_fit,
    poa_sa2_share,
    rent_affordability,
    renter_share,
    transit_access,
)
from sitegrain.runtime import cut_lineage
from sitegrain.sources.census import (
    INDICATOR,
    RENTING,
    STRESSED,
    clean_seifa,
    rent_stress_households,
    tenure_from_features,
)
from sitegrain.sources.housing import rent_by_postcode, sales_by_postcode
from sitegrain.sources.places import canonical_places, clean_categories
from sitegrain.sources.regions import indexed_regions
from sitegrain.sources.transport import FACILITY_NAME_NAMES, combine_points, points_from_table

WEST = BoundingBox(-34.20, -33.55, 150.85, 151.05)
EAST = BoundingBox(-34.20, -33.55, 151.10, 151.45)
METROS = {
    "west": City("west", "West side", WEST, "AU", 10.0, (-33.9, 150.95)),
    "east": City("east", "East side", EAST, "AU", 10.0, (-33.9, 151.25)),
    "empty": City("empty", "No places here", BoundingBox(10.0, 11.0, 106.0, 107.0), "VN", 10.0, (10.5, 106.5)),
}

NAMES = (
    "Gym", "Cafe", "Office", "Restaurant", "Yoga Studio", "Train Station", "Pharmacy", "Coworking Space",
    "Dental Clinic", "Bakery", "City Park", "Supermarket", "Cocktail Bar", "Hospital", "Physiotherapist",
    "Shopping Mall", "University", "Bus Stop", "Fitness Center", "Coffee Shop", "Juice Bar", "Clothing Store",
    "Serviced Office", "Hiking Trail",
)


def _text(number: str) -> str:
    return f"cast(cast({number} as bigint) as string)"


def _category(quantity: str, discount: str) -> str:
    return f"'c' || {_text(quantity)} || '_' || {_text(discount)}"


FIRST = _category("l_quantity", "round(l_discount * 100)")
SECOND = _category("l_partkey % 50 + 1", "l_suppkey % 11")


def place_columns(engine: str = "spark") -> dict[str, str]:
    """Raw place columns over ``lineitem``."""
    left, right = ("array(", ")") if engine == "spark" else ("[", "]")
    strings = "array<string>" if engine == "spark" else "varchar[]"
    return {
        "fsq_place_id": "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || "
        "cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || "
        + _text("round(l_extendedprice * 100)"),
        "name": "case when l_partkey % 17 = 0 then null else 'Place ' || cast(l_partkey as string) end",
        "latitude": "case when l_suppkey % 53 = 5 then null "
        "when l_returnflag = 'R' then cast(-33.87 as double) + (l_partkey % 20) / cast(10000 as double) "
        "when l_returnflag = 'A' then cast(-34.20 as double) + ((l_orderkey * 7919) % 20) * cast(0.0325 as double) "
        "+ (l_partkey % 50) / cast(10000 as double) "
        "else cast(-34.20 as double) + ((l_orderkey * 7919 + l_partkey * 31) % 6500) / cast(10000 as double) end",
        "longitude": "case when l_returnflag = 'R' then cast(151.207 as double) "
        "+ (l_suppkey % 20) / cast(10000 as double) "
        "when l_returnflag = 'A' then cast(150.85 as double) + ((l_orderkey * 104729) % 19) * cast(0.031 as double) "
        "+ (l_suppkey % 50) / cast(10000 as double) "
        "else cast(150.85 as double) + ((l_orderkey * 104729 + l_suppkey * 97) % 6000) / cast(10000 as double) end",
        "country": "case when l_linenumber = 7 then 'NZ' when l_linenumber = 6 then 'au' "
        "when l_partkey % 101 = 0 then null else 'AU' end",
        "fsq_category_ids": f"case when l_linenumber = 7 then null "
        f"when l_linenumber = 6 then cast({left}{right} as {strings}) "
        f"when l_linenumber = 5 then {left}{FIRST}, {SECOND}, 'x5', cast(null as string){right} "
        f"when l_linenumber = 4 then {left}{FIRST}, {FIRST}{right} "
        f"when l_linenumber <= 2 then {left}{FIRST}{right} else {left}{FIRST}, {SECOND}{right} end",
        "locality": "case when l_returnflag = 'R' then 'Sydney' else 'LOC_' || cast(l_suppkey as string) end",
        "region": "case when l_linestatus = 'O' then 'NSW' else 'VIC' end",
        "date_closed": "case when l_tax > 0.075 then '2020-01-01' end",
        "unresolved_flags": "case when l_partkey % 23 = 0 then 'duplicate' "
        "when l_partkey % 29 = 0 then 'stale;privatevenue' when l_partkey % 31 = 0 then 'stale' end",
    }


_NAME_CASE = " ".join(f"when p_partkey % 50 + 1 - 25 * cast(floor((p_partkey % 50 + 1) / 25) as bigint) = {i} "
                      f"then '{n}'" for i, n in enumerate(NAMES))
CATEGORY_COLUMNS = {
    "category_id": _category("p_partkey % 50 + 1", "p_partkey % 11"),
    "category_level": "cast(2 as int)",
    "category_name": f"case {_NAME_CASE} end",
    "category_label": f"'Group ' || {_text('p_partkey % 11')} || ' > ' || "
    f"coalesce(case {_NAME_CASE} end, 'Martial Arts School')",
    "level1_category_id": f"'g' || {_text('p_partkey % 11')}",
    "level1_category_name": f"'Group ' || {_text('p_partkey % 11')}",
    "level2_category_id": "p_brand",
    "level2_category_name": "p_type",
}

STOP_COLUMNS = {
    "LATITUDE": "case when o_custkey % 89 = 3 then 'n/a' when o_orderstatus = 'F' then "
    "cast(cast(-33.87 as double) + (o_orderkey % 20) / cast(10000 as double) as string) else "
    "cast(cast(-34.20 as double) + ((o_orderkey * 6151) % 6500) / cast(10000 as double) as string) end",
    "Long": "cast(case when o_orderstatus = 'F' then cast(151.207 as double) "
    "+ (o_custkey % 20) / cast(10000 as double) "
    "else cast(150.85 as double) + ((o_orderkey * 3079) % 6000) / cast(10000 as double) end as string)",
    "stop_name": "'Stop ' || cast(o_orderkey as string)",
    "Mode": "case o_orderkey % 6 when 0 then 'station_entrance' when 1 then 'Bus Shelter' when 2 then null "
    "when 3 then 'Ferry' when 4 then 'Bus shelter with entrance' else 'Train' end",
}
ENTRANCE_COLUMNS = {
    "Y": "cast(cast(-34.20 as double) + ((c_custkey * 4523) % 6500) / cast(10000 as double) as string)",
    "X": "cast(cast(150.85 as double) + ((c_custkey * 2713) % 6000) / cast(10000 as double) as string)",
    "Station": "c_name",
}


def tile_columns(key: str, grid: str = "g") -> dict[str, str]:
    """Corner and size of a region tile; ``grid`` is the number of tiles per side."""
    return {
        "w": f"cast(0.6 as double) / {grid}",
        "h": f"cast(0.65 as double) / {grid}",
        "x0": f"cast(150.85 as double) + ({key} % {grid}) * (cast(0.6 as double) / {grid})",
        "y0": f"cast(-34.20 as double) + floor({key} / cast({grid} as double)) * (cast(0.65 as double) / {grid})",
    }


# A slanted outline 10% wider than its tile, and a hole: (x factor of w, y factor of h).
OUTLINE = ((0.0, 0.0), (1.1, 0.0), (1.35, 1.0), (0.25, 1.0))
HOLE = ((0.5, 0.4), (0.7, 0.4), (0.7, 0.6), (0.5, 0.6))

SEIFA_COLUMNS = {
    "code": "case when s_suppkey % 37 = 36 then '(c) footer' else cast(s_suppkey as string) end",
    "name": "'  ' || s_name || ' '",
    "score": "cast(700 + (s_suppkey * 29) % 310 as string)",
    "decile": "cast(1 + s_suppkey % 10 as string)",
    "score_1": "case when s_suppkey % 7 = 3 then '-' else cast(850 + (s_suppkey * 37) % 300 as string) end",
    "decile_1": "case when s_suppkey % 7 = 3 then '-' else cast(1 + (s_suppkey * 3) % 10 as string) end",
    "score_2": "cast(800 + (s_suppkey * 53) % 350 as string)",
    "decile_2": "cast(1 + (s_suppkey * 7) % 10 as string)",
    "score_3": "cast(820 + (s_suppkey * 41) % 330 as string)",
    "decile_3": "cast(1 + (s_suppkey * 9) % 10 as string)",
    "population": "cast(1000 + s_suppkey * 13 as string)",
}

POA_BLOCK_COLUMNS = {
    "mb_code_2021": "cast(o_orderkey as string)",
    "poa_code_2021": "case when o_orderstatus = 'F' then '2000' when o_custkey % 61 = 0 then null "
    "else cast(2000 + o_custkey % 300 as string) end",
}
SA2_BLOCK_COLUMNS = {
    "mb_code_2021": "cast(o_orderkey as string)",
    "sa2_code_2021": "case when o_orderkey % 97 = 0 then 'n/a' "
    "else cast((o_orderkey * 31 + o_custkey) % 100 as string) end",
}


SPREAD_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as `{c}`" for c, e in columns.items()])


class Inputs:
    """Lazily derived inputs of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A given table. One that is a single split is spread over the cores by its key;
        a table of many files, as on a cluster, already has its splits and stays as it is."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        key = SPREAD_KEYS.get(name)
        cores = self.spark.sparkContext.defaultParallelism
        if key and rows.rdd.getNumPartitions() < min(cores, 8):
            return rows.repartition(cores, key)
        return rows

    @cached_property
    def raw_places(self) -> DataFrame:
        return _select(self.table("lineitem"), place_columns())

    @cached_property
    def places(self) -> DataFrame:
        return canonical_places(self.raw_places)

    @cached_property
    def core_places(self) -> DataFrame:
        return canonical_places(self.raw_places, keep_optional=False)

    @cached_property
    def raw_categories(self) -> DataFrame:
        return _select(self.table("part"), CATEGORY_COLUMNS)

    @cached_property
    def categories(self) -> DataFrame:
        return clean_categories(self.raw_categories)

    @cached_property
    def transport(self) -> DataFrame:
        stops = points_from_table(
            _select(self.table("orders"), STOP_COLUMNS), "stops", name_names=FACILITY_NAME_NAMES
        )
        entrances = points_from_table(
            _select(self.table("customer"), ENTRANCE_COLUMNS), "entrances", kind="station_entrance"
        )
        return combine_points(stops, entrances)

    def _tiles(self, table: str, key: str, code: str, name: str) -> DataFrame:
        rows = self.table(table)
        side = rows.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("g")).scalar()
        tiles = rows.withColumn("g", side)
        tiles = tiles.withColumns({c: F.expr(e) for c, e in tile_columns(key).items()})

        def ring(corners) -> "F.Column":
            return F.array(
                *[
                    F.struct(
                        (F.col("x0") + F.lit(fx) * F.col("w")).alias("x"),
                        (F.col("y0") + F.lit(fy) * F.col("h")).alias("y"),
                    )
                    for fx, fy in corners
                ]
            )

        rings = F.when(F.col(key) % 3 == 0, F.array(ring(OUTLINE), ring(HOLE))).otherwise(F.array(ring(OUTLINE)))
        return tiles.select(
            F.expr(code).alias("code"), F.expr(name).alias("name"), F.col(key).alias("region_order"), rings.alias("rings")
        )

    @cached_property
    def region_rings(self) -> DataFrame:
        return self._tiles("supplier", "s_suppkey", "s_suppkey", "s_name")

    @cached_property
    def regions(self) -> DataFrame:
        return cut_lineage(indexed_regions(self.region_rings))

    @cached_property
    def suburbs(self) -> DataFrame:
        suburbs = self._tiles("customer", "c_custkey", "'S' || cast(c_custkey as string)", "c_name")
        return cut_lineage(indexed_regions(suburbs))

    @cached_property
    def seifa(self) -> DataFrame:
        return clean_seifa(_select(self.table("supplier"), SEIFA_COLUMNS))

    @cached_property
    def fit(self) -> DataFrame:
        return market_fit(self.seifa)

    @cached_property
    def raw_rent_stress(self) -> DataFrame:
        """Long-form rows with all numbers as text, two geography levels."""
        rented = F.col("l_quantity") <= F.col("l_suppkey") % 50 + 1

        def long_rows(keyed: DataFrame, level: str) -> DataFrame:
            sums = keyed.groupBy("k").agg(
                F.count_if(rented).alias("total"),
                F.count_if(rented & (F.col("l_discount") > 0.05)).alias("stress"),
            )
            code = F.col("k").cast("string")
            rows = F.array(
                F.struct(F.lit(RENTING).alias("c"), F.col("total").alias("t")),
                F.struct(F.lit(STRESSED).alias("c"), F.when(F.col("stress") > 0, F.col("stress")).alias("t")),
            )
            return sums.select(code.alias("code"), F.inline(rows)).filter(F.col("t").isNotNull()).select(
                F.lit(level).alias("GEOGRAPHY_LEVEL"),
                F.col("code").alias("GEOGRAPHY_CODE_2021"),
                F.concat(F.lit("Region "), "code").alias("GEOGRAPHY_NAME_2021"),
                F.lit(INDICATOR).alias("Affordability_Indicator"),
                F.col("c").alias("Affordability_Indicator_Category"),
                F.col("t").cast("string").alias("Total"),
            )

        lines = self.table("lineitem").select("l_quantity", "l_suppkey", "l_discount")
        return long_rows(lines.withColumn("k", F.col("l_suppkey")), "SA2 2021").unionByName(
            long_rows(lines.withColumn("k", F.col("l_suppkey") % 10), "LGA 2021")
        )

    @cached_property
    def rent_stress(self) -> DataFrame:
        return rent_stress_households(self.raw_rent_stress)

    @cached_property
    def rent(self) -> DataFrame:
        return rent_affordability(self.rent_stress)

    @cached_property
    def tenure(self) -> DataFrame:
        """One feature list per region, as a feature service would answer."""
        grouped = (
            self.table("orders")
            .groupBy((F.col("o_custkey") % 100).alias("k"))
            .agg(
                F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("renters"),
                F.count(F.lit(1)).alias("households"),
            )
        )
        attributes = F.struct(
            F.col("k").cast("string").alias("sa2_code_2021"),
            F.concat(F.lit("Region "), F.col("k").cast("string")).alias("sa2_name_2021"),
            F.when(F.col("k") % 41 == 7, F.lit("n/a")).otherwise(F.col("renters").cast("string")).alias("r_tot_total"),
            F.col("households").cast("string").alias("total_total"),
        )
        return tenure_from_features(
            grouped.select(F.array(F.struct(attributes.alias("attributes"))).alias("features"))
        )

    @cached_property
    def renters(self) -> DataFrame:
        return renter_share(self.tenure)

    @cached_property
    def share(self) -> DataFrame:
        orders = self.table("orders")
        return poa_sa2_share(_select(orders, POA_BLOCK_COLUMNS), _select(orders, SA2_BLOCK_COLUMNS))

    def _sheet(self, rows: DataFrame, heading: list[str]) -> DataFrame:
        """A sheet as exported: a note line and a header row above the data, all text."""
        width = len(heading)
        top = [["Quarterly tables. See the notes on postcode coverage."] + [None] * (width - 1), heading]
        schema = ", ".join(f"_c{i} string" for i in range(width))
        return self.spark.createDataFrame(top, schema).union(rows)

    @cached_property
    def rent_sheet(self) -> DataFrame:
        customers = self.table("customer").select(
            (F.lit(2000) + F.col("c_custkey") % 250).alias("poa"), "c_mktsegment", "c_acctbal"
        )
        value = F.abs(F.max("c_acctbal")).cast("bigint")

        def lines(df: DataFrame, dwelling) -> DataFrame:
            median = F.when(F.col("poa") % 19 == 4, F.lit("-")).otherwise(
                F.concat(F.lit("$"), F.format_number("v", 0))
            )
            return df.select(
                F.col("poa").cast("string"),
                dwelling,
                F.lit(" Total "),
                median,
                F.when(F.col("poa") % 23 == 6, F.lit("s")).otherwise(F.format_number("n", 0)),
            )

        totals = customers.groupBy("poa").agg(value.alias("v"), F.count(F.lit(1)).alias("n"))
        split = customers.groupBy("poa", "c_mktsegment").agg(value.alias("v"), F.count(F.lit(1)).alias("n"))
        rows = lines(totals, F.lit("Total")).union(lines(split, F.col("c_mktsegment")))
        return self._sheet(
            rows,
            ["Postcode", "Dwelling Types", "Number of Bedrooms", "Median Weekly Rent\nNew Bonds\n$",
             "New Bonds Lodged\nNo."],
        )

    @cached_property
    def sales_sheet(self) -> DataFrame:
        orders = self.table("orders").select((F.lit(2000) + F.col("o_custkey") % 280).alias("poa"), "o_totalprice")
        rows = (
            orders.groupBy("poa")
            .agg((F.max("o_totalprice") / 1000).cast("bigint").alias("v"), F.count(F.lit(1)).alias("n"))
            .select(
                F.col("poa").cast("string"),
                F.lit("Total"),
                F.when(F.col("poa") % 29 == 8, F.lit("(s)")).otherwise(F.format_number("v", 0)),
                F.format_number("n", 0),
            )
        )
        return self._sheet(rows, ["Postcode", "Dwelling Type", "Median Sales Price\n$'000s", "Sales\nNo."])

    @cached_property
    def rents(self) -> DataFrame:
        return rent_by_postcode(self.rent_sheet)

    @cached_property
    def sales(self) -> DataFrame:
        return sales_by_postcode(self.sales_sheet)

    @cached_property
    def housing(self) -> DataFrame:
        return housing_by_region(self.rents, self.sales, self.share)

    @cached_property
    def transit(self) -> DataFrame:
        return transit_access(self.transport)
