"""Checking SQL: what each registered query must return, over the same tables.

Statements are assembled from named common table expressions; a statement carries only the
ones it uses. They are written relationally (unnest, joins, windows) and share only the
input expressions with the Spark side.
"""

from __future__ import annotations

import math
import re

from sitegrain.config import (
    CHECKLISTS,
    COMPLEMENT_GROUPS,
    GYM,
    GYM_BROAD,
    GYM_STRICT,
    STRATEGIES,
    TEMPLATES,
    Weights,
)
from sitegrain.functions.hexgrid import CELL_AREA_KM2
from sitegrain.operators.reasons import FACTORS, METRICS, REASON_TEXT, STRATEGY_SUMMARY, report_columns
from sitegrain.operators.scoring import PARTS
from sitegrain.sources.census import RENTING, STRESSED
from sitegrain.sources.profile import PLACE_FIELDS
from workload.inputs import (
    CATEGORY_COLUMNS,
    EAST,
    ENTRANCE_COLUMNS,
    HOLE,
    METROS,
    OUTLINE,
    POA_BLOCK_COLUMNS,
    SA2_BLOCK_COLUMNS,
    SEIFA_COLUMNS,
    STOP_COLUMNS,
    WEST,
    place_columns,
    tile_columns,
)

CTES: dict[str, str] = {}
CHECKS: dict[str, str] = {}


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + cast(0 as double))"


def projected(table: str, columns: dict[str, str]) -> str:
    return f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table}"


def statement(final: str) -> str:
    """The final select with every expression it needs, in definition order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    parts = [f"{name} as ({sql})" for name, sql in CTES.items() if name in needed]
    return f"with {', '.join(parts)} {final}" if parts else final


def check(name: str, final: str) -> None:
    CHECKS[name] = statement(final)


def box(b, lat: str = "lat", lon: str = "lon") -> str:
    return f"({lat} between {b.min_lat} and {b.max_lat} and {lon} between {b.min_lon} and {b.max_lon})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_word(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


# ---- inputs ---------------------------------------------------------------------------------

CTES["t_raw"] = projected("lineitem", place_columns("duckdb"))
CTES["t_places"] = (
    "select fsq_place_id as place_id, name, cast(latitude as double) as lat, cast(longitude as double) as lon, "
    "country, fsq_category_ids as category_ids, locality, region, date_closed, unresolved_flags from t_raw"
)
CTES["t_rawcat"] = projected("part", CATEGORY_COLUMNS)
_REST = "category_name, category_label, level1_category_id, level1_category_name, level2_category_id, level2_category_name"
CTES["t_cat"] = (
    f"select category_id, {_REST} from (select *, row_number() over (partition by category_id order by "
    + ", ".join(f"{c} asc nulls first" for c in _REST.split(", "))
    + ") as rn from t_rawcat) where rn = 1"
)
CTES["t_cattext"] = (
    "select *, lower(coalesce(category_name, '') || ' | ' || coalesce(category_label, '')) as txt, "
    "lower(coalesce(category_name, '')) as nm from t_cat"
)
CTES["t_ids"] = (
    "select place_id, unnest(category_ids) as category_id from t_places where len(category_ids) > 0"
)
CTES["t_exploded"] = (
    "select place_id, category_id from t_ids union all "
    "select place_id, null from t_places where category_ids is null or len(category_ids) = 0"
)


def hex_sql(lat: str, lon: str, resolution: int) -> tuple[str, str]:
    """Axial q and r as scalar expressions over named steps; see ``t_hexNN`` below."""
    size = math.sqrt(CELL_AREA_KM2[resolution] * 2.0 / (3.0 * math.sqrt(3.0)))
    x, y = f"(6371.0072 * radians({lon}))", f"(6371.0072 * sin(radians({lat})))"
    return (
        f"({math.sqrt(3.0) / 3.0!r} * {x} - {y} / 3.0) / {size!r}",
        f"({2.0 / 3.0!r} * {y}) / {size!r}",
    )


def hex_cte(source: str, resolution: int, lat: str = "lat", lon: str = "lon") -> str:
    q, r = hex_sql(lat, lon, resolution)
    return (
        "select * exclude (q, r, s, rq, rr, rs), case when lat is null or lon is null then null else "
        f"'hx{resolution}_' || cast(cast(case when abs(rq - q) > abs(rr - r) and abs(rq - q) > abs(rs - s) "
        "then -rr - rs else rq end as bigint) as varchar) || '_' || cast(cast(case when not (abs(rq - q) > "
        "abs(rr - r) and abs(rq - q) > abs(rs - s)) and abs(rr - r) > abs(rs - s) then -rq - rs else rr end as "
        f"bigint) as varchar) end as area_id from (select *, floor(q + 0.5) as rq, floor(r + 0.5) as rr, "
        f"floor(s + 0.5) as rs from (select *, -q - r as s from (select *, {q} as q, {r} as r from {source})))"
    )


for _level in (6, 8, 10):
    CTES[f"t_hex{_level}"] = hex_cte("t_places", _level)
CTES["t_cells"] = "select * from t_hex8 where area_id is not null"

# Roles: one row per template, role and keyword; a category has a role if any keyword hits.
_ROLE_ROWS = ", ".join(
    f"({quoted(key)}, {quoted(flag)}, {quoted(word)})"
    for key, template in TEMPLATES.items()
    for flag, words in template.taxonomy.keywords().items()
    for word in words
)
CTES["t_words"] = f"select * from (values {_ROLE_ROWS}) w(template, role, word)"
CTES["t_templates"] = "select * from (values " + ", ".join(f"({quoted(k)})" for k in TEMPLATES) + ") v(template)"
CTES["t_catroles"] = (
    "select distinct template, role, category_id from t_cattext join t_words on contains(txt, word)"
)
CTES["t_flags"] = (
    "select place_id, template, bool_or(role = 'is_competitor') as c, bool_or(role = 'is_complementary') as m, "
    "bool_or(role = 'is_excluded') as x, bool_or(role = 'is_commercial_other') as o "
    "from t_ids join t_catroles using (category_id) group by place_id, template"
)
CTES["t_uniq"] = "select place_id, count(distinct category_id) as u from t_ids group by place_id"
CTES["t_roles"] = (
    "select p.place_id, t.template, coalesce(c, false) as is_competitor, coalesce(m, false) as is_complementary, "
    "coalesce(x, false) as is_excluded, coalesce(o, false) as is_commercial_other, "
    "cast(coalesce(u, 0) as bigint) as unique_category_count from t_places p cross join t_templates t "
    "left join t_flags f on f.place_id = p.place_id and f.template = t.template "
    "left join t_uniq n on n.place_id = p.place_id"
)


def quality(category: str | None, flags: bool) -> str:
    parts = [
        "1.0",
        "(case when lat is null or lon is null then 0.40 else 0.0 end)",
        "(case when name is null then 0.20 else 0.0 end)",
    ]
    if category:
        parts.append(f"(case when {category} is null then 0.15 else 0.0 end)")
    if flags:
        parts.append("(case when unresolved_flags is not null then 0.25 else 0.0 end)")
    score = " - ".join(f"cast({p} as double)" for p in parts)
    return f"least(greatest({score}, 0.0), 1.0)"


def mean(v: str, digits: int) -> str:
    """Mean of values taken to a number of decimals, from an exact integer sum."""
    unit = f"cast(1e{digits} as double)"
    return f"(cast(sum(cast(round({v} * {unit}) as bigint)) as double) / (count({v}) * {unit}))"


def features(name: str, key: str, source: str, flags: bool, extra: str = "") -> None:
    """Feature rows per template over a source with the area in column ``key``."""
    CTES[name] = (
        f"select template, {extra}area_id, n as total_poi_count, a as active_poi_count, c as competitor_count, "
        "m as complementary_count, o as commercial_other_count, u as unique_category_count, "
        "q as mean_data_quality_score, c / (a + 1.0) as competitor_density_proxy, "
        "m / (a + 1.0) as complementarity_ratio, a as commercial_activity_proxy, "
        "(c / (a + 1.0)) * (1.0 - m / (a + 1.0)) as saturation_proxy, cast(null as double) as recent_refresh_share, "
        "lat_mean, lon_mean from ("
        f"select r.template, {extra}{key} as area_id, count(*) as n, count(*) filter (not is_excluded) as a, "
        "count(*) filter (not is_excluded and is_competitor) as c, "
        "count(*) filter (not is_excluded and is_complementary) as m, "
        "count(*) filter (not is_excluded and is_commercial_other) as o, "
        f"cast(sum(unique_category_count) as bigint) as u, {mean(quality(None, flags), 6)} as q, "
        f"{mean('lat', 7)} as lat_mean, {mean('lon', 7)} as lon_mean from {source} join t_roles r using (place_id) "
        f"group by r.template, {extra}{key})"
    )


features("t_feat", "area_id", "t_cells", False)
features("t_feat_loc", "locality", "t_places", True)
FEATURE_LIST = [
    "area_id", "total_poi_count", "active_poi_count", "competitor_count", "complementary_count",
    "commercial_other_count", "unique_category_count", "mean_data_quality_score", "competitor_density_proxy",
    "complementarity_ratio", "commercial_activity_proxy", "saturation_proxy", "recent_refresh_share",
]
DOUBLES = {
    "mean_data_quality_score", "competitor_density_proxy", "complementarity_ratio", "saturation_proxy",
    "recent_refresh_share", "transit_access_raw", "transit_access_score", "market_fit_score",
    "rent_stress_share", "rent_affordability_score", "lat_mean", "lon_mean", "opportunity_score",
    "median_weekly_rent_total", "bonds_lodged_total", "median_sale_price_total", "sales_total",
    "seifa_irsad_score", "seifa_ier_score", "renter_share_2021", "data_quality_score",
}
NORMALIZED = [p[1] for p in PARTS]
SCORES = [p[0] for p in PARTS]
LOGS = ["commercial_activity_log", "diversity_log", "competition_log", "saturation_log"]
DOUBLES |= set(NORMALIZED) | set(SCORES) | set(LOGS)


def shown(columns) -> str:
    return ", ".join(f"{r6(c)} as {c}" if c in DOUBLES else c for c in columns)


# ---- transport ------------------------------------------------------------------------------

CTES["t_stops"] = projected("orders", {f'"{c}"': e for c, e in STOP_COLUMNS.items()})
CTES["t_entr"] = projected("customer", {f'"{c}"': e for c, e in ENTRANCE_COLUMNS.items()})
CTES["t_transport"] = (
    'select "Mode" as kind, \'stops\' as source, try_cast("LATITUDE" as double) as lat, '
    'try_cast("Long" as double) as lon, stop_name as name from t_stops where try_cast("LATITUDE" as double) '
    "is not null union all select 'station_entrance', 'entrances', try_cast(\"Y\" as double), "
    'try_cast("X" as double), "Station" from t_entr'
)
CTES["t_thex"] = hex_cte("t_transport", 8)
_K = "lower(coalesce(kind, 'facility'))"
CTES["t_tcount"] = (
    "select area_id, count(*) filter (e) as station_entrance_count, count(*) filter (not e and not b) as "
    "pt_facility_count, count(*) filter (b) as bus_shelter_count from (select area_id, "
    f"contains({_K}, 'entrance') as e, contains({_K}, 'bus') and contains({_K}, 'shelter') as b from t_thex) "
    "group by area_id"
)
CTES["t_transit"] = (
    "select *, case when mx - mn <= 1e-9 then 0.0 else (transit_access_raw - mn) / (mx - mn) end as "
    "transit_access_score from (select *, min(transit_access_raw) over () as mn, max(transit_access_raw) over () "
    "as mx from (select *, ln(1 + 2.0::double * station_entrance_count + pt_facility_count + 0.5::double * "
    "bus_shelter_count) as transit_access_raw from t_tcount))"
)

# ---- regions --------------------------------------------------------------------------------


def tiles(name: str, table: str, key: str, code: str, label: str) -> None:
    columns = tile_columns(key)
    CTES[f"{name}_grid"] = f"select cast(ceil(sqrt(count(*))) as bigint) as g from {table}"
    CTES[name] = (
        f"select {code} as code, {label} as name, {key} as region_order, {columns['x0']} as x0, {columns['y0']} as y0, "
        f"{columns['w']} as w, {columns['h']} as h from {table} cross join {name}_grid"
    )
    pieces = []
    for ring, condition in ((OUTLINE, "true"), (HOLE, "region_order % 3 = 0")):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            pieces.append(
                f"select code, name, region_order, x0 + {ax}::double * w as x1, y0 + {ay}::double * h as y1, "
                f"x0 + {bx}::double * w as x2, y0 + {by}::double * h as y2 from {name} where {condition}"
            )
    CTES[f"{name}_edges"] = " union all ".join(pieces)
    CTES[f"{name}_box"] = (
        "select code, any_value(name) as name, any_value(region_order) as region_order, min(x1) as min_x, "
        f"max(x1) as max_x, min(y1) as min_y, max(y1) as max_y from {name}_edges group by code"
    )


tiles("t_reg", "supplier", "s_suppkey", "s_suppkey", "s_name")
tiles("t_sub", "customer", "c_custkey", "'S' || cast(c_custkey as varchar)", "c_name")


def located(name: str, points: str, key: str, lat: str, lon: str, regions: str) -> None:
    """Lowest region in order whose edges a ray from the point crosses an odd number of times."""
    CTES[f"{name}_hit"] = (
        f"select pk, min(region_order) as best from (select p.{key} as pk, b.region_order, "
        f"sum(case when ((e.y1 > p.{lat}) <> (e.y2 > p.{lat})) and p.{lon} < (e.x2 - e.x1) * (p.{lat} - e.y1) / "
        f"(e.y2 - e.y1) + e.x1 then 1 else 0 end) as crossings from {points} p join {regions}_box b on "
        f"p.{lon} between b.min_x and b.max_x and p.{lat} between b.min_y and b.max_y join {regions}_edges e on "
        f"e.code = b.code group by p.{key}, b.region_order) where crossings % 2 = 1 group by pk"
    )
    CTES[name] = (
        f"select p.{key} as pk, b.code, b.name from {points} p left join {name}_hit h on h.pk = p.{key} "
        f"left join {regions}_box b on b.region_order = h.best"
    )


CTES["t_areas"] = (
    f"select area_id, count(*) as poi_count, {mean('lat', 7)} as lat_mean, {mean('lon', 7)} as lon_mean from t_cells "
    "group by area_id"
)
located("t_area_reg", "t_areas", "area_id", "lat_mean", "lon_mean", "t_reg")
located("t_area_sub", "t_areas", "area_id", "lat_mean", "lon_mean", "t_sub")
located("t_place_reg", "t_places", "place_id", "lat", "lon", "t_reg")


def centroids(name: str, regions: str) -> None:
    CTES[name] = (
        "select code, sum((y1 + y2) * k) / (3 * sum(k)) as lat, sum((x1 + x2) * k) / (3 * sum(k)) as lon "
        f"from (select *, x1 * y2 - x2 * y1 as k from {regions}_edges) group by code"
    )


centroids("t_sub_center", "t_sub")
located("t_center_reg", "t_sub_center", "code", "lat", "lon", "t_reg")

# ---- census and housing ---------------------------------------------------------------------

CTES["t_sheet"] = projected("supplier", SEIFA_COLUMNS)
CTES["t_seifa"] = (
    "select try_cast(code as bigint) as sa2_code_2021, trim(name) as sa2_name_2021, "
    + ", ".join(
        f"try_cast(score{tail} as double) as seifa_{index}_score, try_cast(decile{tail} as bigint) as seifa_{index}_decile"
        for tail, index in (("", "irsd"), ("_1", "irsad"), ("_2", "ier"), ("_3", "ieo"))
    )
    + ", try_cast(population as bigint) as sa2_population from t_sheet where try_cast(code as bigint) is not null"
)
CTES["t_fit"] = (
    "select sa2_code_2021, sa2_name_2021, sa2_population, seifa_irsad_score, seifa_irsad_decile, seifa_ier_score, "
    "seifa_ier_decile, 0.7::double * (seifa_irsad_score - min(seifa_irsad_score) over ()) / "
    "(max(seifa_irsad_score) over () - min(seifa_irsad_score) over ()) + 0.3::double * (seifa_ier_score - "
    "min(seifa_ier_score) over ()) / (max(seifa_ier_score) over () - min(seifa_ier_score) over ()) "
    "as market_fit_score from t_seifa"
)
CTES["t_hh"] = (
    "select l_suppkey as sa2_code_2021, 'Region ' || cast(l_suppkey as varchar) as sa2_name_2021, "
    "count(*) filter (l_quantity <= l_suppkey % 50 + 1 and l_discount > 0.05) as rent_stress_households, "
    "count(*) filter (l_quantity <= l_suppkey % 50 + 1) as total_renting_households from lineitem group by l_suppkey"
)
CTES["t_rent"] = (
    "select sa2_code_2021, s as rent_stress_share, case when total_renting_households < 200 then null else 1.0 - s "
    "end as rent_affordability_score from (select *, least(greatest(rent_stress_households / "
    "(total_renting_households + 1.0), 0.0), 1.0) as s from t_hh)"
)
CTES["t_renters"] = (
    "select k as sa2_code_2021, 'Region ' || cast(k as varchar) as sa2_name_2021, renter_households_2021, "
    "total_households_2021, case when renter_households_2021 is not null then least(greatest(renter_households_2021 / "
    "(total_households_2021 + 1.0), 0.0), 1.0) end as renter_share_2021 from (select o_custkey % 100 as k, case when o_custkey % 100 % 41 = 7 then null else "
    "count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) end as renter_households_2021, "
    "count(*) as total_households_2021 from orders group by o_custkey % 100)"
)
CTES["t_poa"] = projected("orders", POA_BLOCK_COLUMNS)
CTES["t_sa2"] = projected("orders", SA2_BLOCK_COLUMNS)
CTES["t_pairs"] = (
    "select try_cast(p.poa_code_2021 as bigint) as poa_code_2021, try_cast(s.sa2_code_2021 as bigint) as "
    "sa2_code_2021, count(*) as mb_count from t_poa p join t_sa2 s using (mb_code_2021) where "
    "try_cast(p.poa_code_2021 as bigint) is not null and try_cast(s.sa2_code_2021 as bigint) is not null "
    "group by all"
)
CTES["t_totals"] = "select poa_code_2021, sum(mb_count) as mb_total from t_pairs group by poa_code_2021"
CTES["t_share"] = (
    "select poa_code_2021, sa2_code_2021, mb_count, cast(mb_count as double) / cast(mb_total as double) as "
    "mb_ratio_from_poa_to_sa2 from t_pairs join t_totals using (poa_code_2021)"
)
CTES["t_rents"] = (
    "select poa as poa_code_2021, case when poa % 19 = 4 then null else cast(v as double) end as "
    "median_weekly_rent_total, case when poa % 23 = 6 then null else n end as bonds_lodged_total from "
    "(select 2000 + c_custkey % 250 as poa, cast(trunc(abs(max(c_acctbal))) as bigint) as v, count(*) as n "
    "from customer group by 2000 + c_custkey % 250)"
)
CTES["t_sales"] = (
    "select poa as poa_code_2021, case when poa % 29 = 8 then null else cast(v as double) * 1000 end as "
    "median_sale_price_total, n as sales_total from (select 2000 + o_custkey % 280 as poa, "
    "cast(trunc(max(o_totalprice) / 1000) as bigint) as v, count(*) as n from orders group by 2000 + o_custkey % 280)"
)


def housing(name: str, rents: str = "t_rents", sales: str = "t_sales", skip_null: bool = False) -> None:
    def side(table: str, value: str, count: str) -> str:
        weight = f"coalesce({count}, 0) * mb_ratio_from_poa_to_sa2"
        counted = f"(case when {value} is null then 0.0 else {weight} end)" if skip_null else weight
        return (
            f"select sa2_code_2021, sum(coalesce({value}, 0.0) * {counted}) / (case when sum({counted}) <= 0 then 1.0 "
            f"else sum({counted}) end) as {value}_w, sum({weight}) as {count}_w from {table} "
            "join t_share using (poa_code_2021) group by sa2_code_2021"
        )

    CTES[name] = (
        "select coalesce(a.sa2_code_2021, b.sa2_code_2021) as sa2_code_2021, median_weekly_rent_total_w, "
        "bonds_lodged_total_w, median_sale_price_total_w, sales_total_w from ("
        + side(rents, "median_weekly_rent_total", "bonds_lodged_total")
        + ") a full outer join ("
        + side(sales, "median_sale_price_total", "sales_total")
        + ") b on a.sa2_code_2021 = b.sa2_code_2021"
    )


CTES["t_rents_low"] = "select * from t_rents where poa_code_2021 < 2003"
CTES["t_sales_high"] = "select * from t_sales where poa_code_2021 >= 2001"
housing("t_housing")
housing("t_housing_skip", skip_null=True)
housing("t_housing_part", "t_rents_low", "t_sales_high")
CTES["t_assets"] = (
    "select r.code as sa2_code_2021, r.name as sa2_name_2021, market_fit_score, seifa_irsad_decile, sa2_population, "
    "seifa_irsad_score, seifa_ier_score, rent_stress_share, rent_affordability_score, renter_share_2021, "
    "renter_households_2021, total_households_2021, median_weekly_rent_total_w as median_weekly_rent_total, "
    "bonds_lodged_total_w as bonds_lodged_total, median_sale_price_total_w as median_sale_price_total, "
    "sales_total_w as sales_total, r.region_order, r.x0, r.y0 from t_reg r left join t_fit f on "
    "f.sa2_code_2021 = r.code left join t_rent n on n.sa2_code_2021 = r.code left join t_renters t on "
    "t.sa2_code_2021 = r.code left join t_housing h on h.sa2_code_2021 = r.code"
)
ASSETS = [
    "sa2_code_2021", "sa2_name_2021", "market_fit_score", "seifa_irsad_decile", "sa2_population",
    "seifa_irsad_score", "seifa_ier_score", "rent_stress_share", "rent_affordability_score",
    "renter_share_2021", "renter_households_2021", "total_households_2021", "median_weekly_rent_total",
    "bonds_lodged_total", "median_sale_price_total", "sales_total",
]

# ---- scores ---------------------------------------------------------------------------------

CTES["t_context"] = (
    "select a.area_id, coalesce(station_entrance_count, 0) as station_entrance_count, coalesce(pt_facility_count, 0) "
    "as pt_facility_count, coalesce(bus_shelter_count, 0) as bus_shelter_count, transit_access_raw, "
    "coalesce(transit_access_score, 0.0) as transit_access_score, r.code as sa2_code_2021, r.name as sa2_name_2021, "
    "coalesce(market_fit_score, 0.0) as market_fit_score, coalesce(seifa_irsad_decile, 0) as seifa_irsad_decile, "
    "sa2_population, s.name as sal_name_2021, s.code as sal_code_2021, rent_stress_share, rent_affordability_score "
    "from t_areas a left join t_transit t using (area_id) left join t_area_reg r on r.pk = a.area_id left join "
    "t_area_sub s on s.pk = a.area_id left join t_fit f on f.sa2_code_2021 = r.code left join t_rent n on "
    "n.sa2_code_2021 = r.code"
)
LAYER_LIST = [
    "station_entrance_count", "pt_facility_count", "bus_shelter_count", "transit_access_raw",
    "transit_access_score", "sa2_code_2021", "sa2_name_2021", "market_fit_score", "seifa_irsad_decile",
    "sa2_population", "sal_name_2021", "sal_code_2021", "rent_stress_share", "rent_affordability_score",
]


def scored(name: str, source: str, weights: dict[str, Weights], layers: bool, by: str = "template",
           over: str = "true") -> None:
    """Logs, min-max over each ``by`` group, weighted parts, sum and top reasons."""
    inputs = {
        "n_complementarity": "complementarity_ratio",
        "n_activity": "commercial_activity_log",
        "n_diversity": "diversity_log",
        "n_competition": "competition_log",
        "n_saturation": "saturation_log",
        "n_quality": "mean_data_quality_score",
    }
    if layers:
        inputs |= {
            "n_transit": "transit_access_score",
            "n_market_fit": "market_fit_score",
            "n_rent_affordability": "coalesce(rent_affordability_score, 0.0)",
        }
    CTES[f"{name}_log"] = (
        "select *, ln(1 + commercial_activity_proxy) as commercial_activity_log, ln(1 + unique_category_count) as "
        "diversity_log, ln(1 + competitor_density_proxy) as competition_log, ln(1 + saturation_proxy) as "
        f"saturation_log from {source}"
    )

    def norm(n: str) -> str:
        if n not in inputs:
            return f"cast(0 as double) as {n}"
        v = inputs[n]
        lo = f"min({v}) filter ({over}) over (partition by {by})"
        hi = f"max({v}) filter ({over}) over (partition by {by})"
        return f"case when {hi} - {lo} <= 1e-9 then 0.0 else ({v} - {lo}) / ({hi} - {lo}) end as {n}"

    CTES[f"{name}_norm"] = f"select *, {', '.join(norm(n) for n in NORMALIZED)} from {name}_log"

    def part(p: tuple) -> str:
        column, n, field, sign = p
        if len(weights) == 1:
            w = repr(sign * getattr(next(iter(weights.values())), field)) + "::double"
        else:
            w = "case template " + " ".join(
                f"when {quoted(k)} then {sign * getattr(x, field)!r}::double" for k, x in weights.items()
            ) + " end"
        return f"({w}) * {n} as {column}"

    CTES[f"{name}_part"] = f"select *, {', '.join(part(p) for p in PARTS)} from {name}_norm"
    CTES[f"{name}_sum"] = f"select *, {' + '.join(SCORES)} as opportunity_score from {name}_part"

    def reasons(corrected: bool) -> str:
        entries = []
        shape = {p[0]: p for p in PARTS}
        for i, (column, text) in enumerate(REASON_TEXT):
            _, n, _, sign = shape[column]
            if sign > 0:
                strength = column
            elif not corrected:
                strength = f"-{column}"
            else:
                strength = f"(case when {n} > 0 then -{column} / {n} * (1.0 - {n}) else 1.0 end)"
            entries.append(f"{{'w': -({strength}) + cast(0 as double), 'i': {i}, 't': {quoted(text)}}}")
        ordered = f"list_sort([{', '.join(entries)}])"
        return f"array_to_string(list_transform({ordered}[1:3], lambda e: e.t), '; ')"

    CTES[name] = (
        f"select *, {reasons(False)} as reasons_top3, {reasons(True)} as reasons_corrected from {name}_sum"
    )


ALL_WEIGHTS = {k: t.weights for k, t in TEMPLATES.items()}
CTES["t_gym"] = "select * from t_feat where template = 'gym'"
CTES["t_gym_ctx"] = "select f.*, c.* exclude (area_id) from t_gym f join t_context c using (area_id)"
scored("s_poi", "t_gym", {"gym": GYM.weights}, False)
scored("s_full", "t_gym_ctx", {"gym": GYM.weights}, True)
scored("s_all", "t_feat", ALL_WEIGHTS, False)
scored("s_over", "t_feat", ALL_WEIGHTS, False, over="active_poi_count >= 20")
CTES["s_poi20"] = "select * from s_poi where active_poi_count >= 20"
CTES["s_full20"] = "select * from s_full where active_poi_count >= 20"
CTES["s_all20"] = "select * from s_all where active_poi_count >= 20"
TAIL = [*LOGS, *NORMALIZED, *SCORES, "opportunity_score", "reasons_top3"]

# ---- checks: sources and subsets ------------------------------------------------------------

check(
    "places_canonical",
    f"select place_id, name, {r6('lat')} as lat, {r6('lon')} as lon, country, coalesce(array_to_string(category_ids, "
    "','), '') as category_ids, locality, region, date_closed, unresolved_flags from t_places",
)
_RAW_TYPES = {
    "fsq_place_id": "string", "name": "string", "latitude": "double", "longitude": "double", "country": "string",
    "fsq_category_ids": "array<string>", "locality": "string", "region": "string", "date_closed": "string",
    "unresolved_flags": "string",
}
check(
    "schema_profile_places",
    " union all ".join(
        [
            f"select {quoted(c)} as field, {quoted(kind)} as dtype, true as present, "
            f"{str(c in PLACE_FIELDS).lower()} as checked, count(*) - count({c}) as null_count, "
            f"{r6(f'count({c}) / cast(count(*) as double)')} as filled_share from t_raw"
            for c, kind in _RAW_TYPES.items()
        ]
        + [
            f"select {quoted(c)}, cast(null as varchar), false, true, cast(null as bigint), cast(null as double)"
            for c in PLACE_FIELDS
            if c not in _RAW_TYPES
        ]
    ),
)
_BAD = "(" + " or ".join(
    f"contains(unresolved_flags, '{f}')" for f in ("duplicate", "delete", "privatevenue", "doesnt_exist")
) + ")"
_OK = f"not coalesce({_BAD}, false)"
_STEPS = [
    ("input", "true"), ("country", "country = 'AU'"), ("open", "date_closed is null"), ("unflagged", _OK),
    ("city", "locality = 'Sydney'"),
]
check(
    "row_funnel",
    " union all ".join(
        f"select {i} as step, {quoted(s)} as stage, count(*) as rows from t_places where "
        + " and ".join(c for _, c in _STEPS[: i + 1])
        for i, (s, _) in enumerate(_STEPS)
    ),
)
_COORD = f"place_id, {r6('lat')} as lat, {r6('lon')} as lon"
check(
    "subset_country_bbox",
    f"select 'bbox' as rule, {_COORD} from t_places where {box(WEST)} union all "
    f"select 'country_any_case', {_COORD} from t_places where upper(country) = 'AU' union all "
    f"select 'country_exact', {_COORD} from t_places where country = 'AU' union all "
    f"select 'no_country_column', {_COORD} from t_places where lat between -44 and -10 and lon between 112 and 154 "
    f"union all select 'metro', {_COORD} from t_places where country = 'AU' and {box(EAST)}",
)
check(
    "metro_scan",
    f"select place_id, name, {r6('lat')} as lat, {r6('lon')} as lon, country from t_places where country = 'AU' and {box(EAST)}",
)
check(
    "subset_flags_open",
    f"select place_id, date_closed, unresolved_flags from t_places where date_closed is null and {_OK}",
)
_LIST = "region = 'NSW' and locality in ('Sydney', 'LOC_1', 'LOC_2', 'LOC_3')"
check(
    "subset_locality_strategy",
    "select 'locality' as strategy, place_id from t_places where locality = 'Sydney' union all "
    f"select 'region_localities', place_id from t_places where {_LIST} union all "
    f"select 'auto_with_list', place_id from t_places where {_LIST} union all "
    "select 'bbox', place_id from t_places where lat between -34.20 and -33.55 and lon between 150.85 and 151.45",
)

# ---- checks: categories and roles -----------------------------------------------------------

check("categories_clean", f"select category_id, {_REST} from t_cat")
check(
    "category_search",
    "select category_id, category_name, category_label from t_cattext where contains(txt, 'coffee') "
    "order by category_id limit 50",
)
CTES["t_strict"] = f"select category_id from t_cattext where {any_word('nm', GYM_STRICT)}"
CTES["t_broad"] = f"select category_id from t_cattext where {any_word('nm', GYM_BROAD)}"
CTES["t_food"] = (
    f"select category_id from t_cattext where {any_word('txt', ('cafe', 'bar'))} and not contains(txt, 'coffee')"
)
check(
    "category_match_sets",
    "select 'strict' as set_name, category_id from t_strict union all select 'broad', category_id from t_broad "
    "union all select 'cafe_or_bar_not_coffee', category_id from t_food union all select 'union', category_id from "
    "(select * from t_strict union select * from t_food) union all select 'broad_minus_strict', category_id from "
    "(select * from t_broad except select * from t_strict)",
)
CTES["t_groups"] = " union ".join(
    f"select {quoted(g)} as complement_group, category_id from t_cattext where {any_word('nm', words)}"
    for g, words in COMPLEMENT_GROUPS.items()
)
check("complement_groups", "select complement_group, category_id from t_groups")
check(
    "place_categories",
    "select e.place_id, e.category_id, category_name, category_label from t_exploded e left join t_cat c "
    "on c.category_id = e.category_id",
)
check("place_roles", "select * from t_roles")

# ---- checks: quality and areas --------------------------------------------------------------

check(
    "poi_quality_scores",
    f"select place_id, e.category_id, {r6(quality(None, True))} as place_score, "
    f"{r6(quality('e.category_id', True))} as row_score from t_exploded e join t_places p using (place_id)",
)
CTES["t_pois"] = (
    "select area_id, place_id, name, lat, lon, e.category_id from t_exploded e join t_cells using (place_id)"
)
CTES["t_quality"] = (
    f"select area_id, {mean(quality('category_id', False), 6)} as data_quality_score from t_pois group by area_id"
)
check("area_quality_scores", f"select area_id, {r6('data_quality_score')} as data_quality_score from t_quality")
check(
    "hex_cells",
    "select a.place_id, a.area_id as cell_6, b.area_id as cell_8, c.area_id as cell_10 from t_hex6 a "
    "join t_hex8 b using (place_id) join t_hex10 c using (place_id)",
)
_E8 = repr(math.sqrt(CELL_AREA_KM2[8] * 2.0 / (3.0 * math.sqrt(3.0))))
_AX = "cast(split_part(area_id, '_', {}) as double)"
check(
    "cell_centroids",
    f"select area_id, poi_count, {r6('lat_mean')} as lat, {r6('lon_mean')} as lon, "
    f"{r6(f'degrees(asin(({_E8} * 1.5 * {_AX.format(3)}) / 6371.0072))')} as cell_lat, "
    f"{r6(f'degrees(({_E8} * (sqrt(3) * {_AX.format(2)} + sqrt(3) / 2 * {_AX.format(3)})) / 6371.0072)')} as cell_lon "
    "from t_areas",
)
check("locality_areas", f"select {shown(FEATURE_LIST)} from t_feat_loc where template = 'gym'")
check("area_features_gym", f"select {shown([*FEATURE_LIST, 'lat_mean', 'lon_mean'])} from t_gym")
CTES["t_counts"] = (
    "select area_id, category_id, count(*) as cnt from t_pois where category_id is not null group by area_id, category_id"
)
check("cell_category_counts", "select area_id, category_id, cnt from t_counts")
check("cell_poi_counts", f"select area_id, poi_count, {shown(['lat_mean', 'lon_mean'])} from t_areas")
check(
    "category_set_counts",
    "select area_id, cast(sum(cnt) as bigint) as total, 'strict' as set_name from t_counts join t_strict "
    "using (category_id) group by area_id union all select distinct area_id, cast(0 as bigint), 'none' from t_counts",
)

# ---- checks: layers -------------------------------------------------------------------------

_BUCKET = (
    f"case when contains({_K}, 'entrance') then 'entrance' when contains({_K}, 'bus') and contains({_K}, 'shelter') "
    "then 'shelter' else 'facility' end"
)
check(
    "transport_points",
    f"select kind, source, {r6('lat')} as lat, {r6('lon')} as lon, name, bucket, case bucket when 'entrance' then "
    "'0,180,255,180' when 'shelter' then '255,195,0,180' else '180,180,180,140' end as fill from (select *, "
    f"{_BUCKET} as bucket from t_transport)",
)
check(
    "transit_access",
    "select area_id, station_entrance_count, pt_facility_count, bus_shelter_count, "
    f"{shown(['transit_access_raw', 'transit_access_score'])} from t_transit",
)
check("seifa_sheet", "select * from t_seifa")
check(
    "market_fit",
    "select sa2_code_2021, sa2_name_2021, sa2_population, seifa_irsad_score, seifa_irsad_decile, seifa_ier_score, "
    f"seifa_ier_decile, {r6('market_fit_score')} as market_fit_score from t_fit",
)
check("rent_stress_wide", "select * from t_hh where total_renting_households > 0")
check(
    "rent_affordability",
    f"select sa2_code_2021, {shown(['rent_stress_share', 'rent_affordability_score'])} from t_rent",
)
check(
    "renter_share",
    "select sa2_code_2021, sa2_name_2021, renter_households_2021, total_households_2021, "
    f"{shown(['renter_share_2021'])} from t_renters",
)
check(
    "poa_sa2_share",
    f"select poa_code_2021, sa2_code_2021, mb_count, {r6('mb_ratio_from_poa_to_sa2')} as mb_ratio_from_poa_to_sa2 from t_share",
)
check("rent_sheet", "select * from t_rents")
check("sales_sheet", "select * from t_sales")
_HOUSING = ["median_weekly_rent_total_w", "bonds_lodged_total_w", "median_sale_price_total_w", "sales_total_w"]
_H = "sa2_code_2021, " + ", ".join(f"{r6(c)} as {c}" for c in _HOUSING)
check(
    "housing_weighted_mean",
    f"select {_H}, 'as zero' as suppressed from t_housing union all select {_H}, 'left out' from t_housing_skip",
)
check("housing_full_outer", f"select {_H} from t_housing_part")

# ---- checks: spatial ------------------------------------------------------------------------

check("point_in_region", "select pk as place_id, code as sa2_code_2021, name as sa2_name_2021 from t_place_reg")
check("suburb_labels", "select pk as area_id, code as sal_code_2021, name as sal_name_2021 from t_area_sub")
check("region_centroids", f"select code, {r6('lat')} as lat, {r6('lon')} as lon from t_sub_center")
check(
    "centroid_region_map",
    "select pk as code, code as sa2_code_2021, name as sa2_name_2021 from t_center_reg",
)
check(
    "region_bbox_overlap",
    "select code, name, " + ", ".join(f"{r6(c)} as {c}" for c in ("min_x", "max_x", "min_y", "max_y"))
    + f" from t_sub_box where max_x >= {WEST.min_lon} and min_x <= {WEST.max_lon} and max_y >= {WEST.min_lat} "
    f"and min_y <= {WEST.max_lat}",
)


def fill(metric: str) -> str:
    t = f"least(greatest({metric}, 0.0), 1.0)"
    channels = " || ',' || ".join(
        f"cast(cast(trunc({a}::double + {b}::double * {t}) as int) as varchar)"
        for a, b in ((240.0, -130.0), (210.0, 25.0), (95.0, -40.0))
    )
    return f"case when {metric} is null then '180,180,180,90' else {channels} || ',170' end as fill_{metric}"


check(
    "region_assets",
    f"select {shown(ASSETS)}, "
    + ", ".join(fill(m) for m in ("market_fit_score", "rent_affordability_score", "renter_share_2021"))
    + " from t_assets",
)
check(
    "region_geojson",
    "select 'Feature' as type, sa2_code_2021, sa2_name_2021, "
    f"{shown(['market_fit_score', 'rent_stress_share'])}, 'Polygon' as geometry_type, "
    f"cast(case when region_order % 3 = 0 then 2 else 1 end as int) as rings, {r6('x0')} as first_x, "
    f"{r6('y0')} as first_y from t_assets",
)


def extreme(metric: str, tag: str, side: str, k: int) -> str:
    direction = "desc" if side == "top" else "asc"
    return (
        f"select * from (select {shown(ASSETS[:10])}, '{side}' as side, '{tag}' as metric from t_assets where {metric} is not "
        f"null order by t_assets.{metric} {direction}, t_assets.sa2_code_2021 limit {k})"
    )


check(
    "region_top_bottom",
    " union all ".join(
        [
            extreme("market_fit_score", "market_fit_score", "top", 10),
            extreme("market_fit_score", "market_fit_score", "bottom", 10),
            extreme("rent_affordability_score", "rent_affordability_score", "top", 10),
            extreme("rent_affordability_score", "rent_affordability_score", "bottom", 10),
            extreme("market_fit_score", "preview", "top", 15),
        ]
    ),
)

# ---- checks: scores and rankings ------------------------------------------------------------


def minmax(v: str) -> str:
    return f"({v} - min({v}) over ()) / (max({v}) over () - min({v}) over ())"


check(
    "guarded_minmax",
    f"select area_id, {r6(minmax('poi_count'))} as n_count, {r6(minmax('lat_mean'))} as n_lat, "
    "cast(0 as double) as n_flat from t_areas",
)
check("opportunity_poi", f"select {shown([*FEATURE_LIST, *TAIL])} from s_poi20")
check("opportunity_full", f"select {shown([*FEATURE_LIST, *LAYER_LIST, *TAIL])} from s_full20")
check(
    "opportunity_templates",
    "select template, area_id, active_poi_count, competitor_count, complementary_count, commercial_other_count, "
    f"{shown(['opportunity_score'])}, reasons_top3 from s_all20",
)
check(
    "opportunity_normalized_over",
    f"select template, area_id, {shown(['n_activity', 'n_competition', 'opportunity_score'])} from s_over "
    "where active_poi_count >= 20",
)
for _i, (_mode, _w) in enumerate(STRATEGIES.items()):
    scored(f"s_mode{_i}", "t_gym", {_mode: _w}, False)
check(
    "strategy_rescore",
    " union all ".join(
        f"select {quoted(mode)} as strategy, row_number() over (order by round(opportunity_score, 9) desc, area_id) as rank, "
        f"area_id, {shown(['opportunity_score'])}, reasons_top3 as brief_reason from s_mode{i} "
        "where active_poi_count >= 20 and mean_data_quality_score >= 0.5"
        for i, mode in enumerate(STRATEGIES)
    ),
)
check(
    "rank_per_template",
    "select template, area_id, row_number() over (partition by template order by round(opportunity_score, 9) desc, area_id) "
    f"as rank, {shown(['opportunity_score'])} from s_all",
)


def light(name: str, competitor: str, complement: str, weights: tuple[float, float, float]) -> None:
    wc, wm, wq = weights
    CTES[name] = (
        f"select *, {wm}::double * complement_log - {wc}::double * competitor_log + {wq}::double * data_quality_score "
        "as opportunity_score from (select *, ln(1 + competitor_count) as competitor_log, ln(1 + complement_count) as "
        "complement_log, ln(1 + poi_count) as density_log from (select a.area_id, poi_count, lat_mean, lon_mean, "
        "cast(coalesce(c, 0) as bigint) as competitor_count, cast(coalesce(m, 0) as bigint) as complement_count, "
        "coalesce(data_quality_score, 0.0) as data_quality_score from t_areas a left join (select area_id, sum(cnt) "
        f"as c from t_counts join {competitor} using (category_id) group by area_id) using (area_id) left join "
        f"(select area_id, sum(cnt) as m from t_counts join {complement} using (category_id) group by area_id) "
        "using (area_id) left join t_quality using (area_id)))"
    )


CTES["t_group_ids"] = "select distinct category_id from t_groups"
light("s_light", "t_strict", "t_group_ids", (1.0, 1.0, 0.5))
_LIGHT = "area_id, poi_count, competitor_count, complement_count, " + ", ".join(
    f"{r6(c)} as {c}"
    for c in (
        "lat_mean", "lon_mean", "data_quality_score", "competitor_log", "complement_log", "density_log",
        "opportunity_score",
    )
)
check("light_score", f"select {_LIGHT} from s_light")
_NOT = "not " + any_word("txt", ("juice", "serviced"))
CTES["t_custom_c"] = f"select category_id from t_cattext where {any_word('txt', ('cafe', 'coffee'))} and {_NOT}"
CTES["t_custom_m"] = (
    f"select category_id from t_cattext where {any_word('txt', ('office', 'university', 'station'))} and {_NOT}"
)
light("s_custom", "t_custom_c", "t_custom_m", (1.2, 1.0, 0.5))
CTES["s_custom_med"] = (
    "select *, array_to_string(list_filter(["
    "case when complement_log > median(complement_log) over () then 'Strong complements' end, "
    "case when density_log > median(density_log) over () then 'High activity' end, "
    "case when competitor_log < median(competitor_log) over () then 'Lower competition' end], "
    "lambda x: x is not null), '; ') as reasons_top3, poi_count as active_poi_count from s_custom "
    "join (select area_id, transit_access_score, market_fit_score, seifa_irsad_decile from t_context) using (area_id)"
)
check(
    "custom_rank_keywords",
    f"select {_LIGHT}, active_poi_count, {shown(['transit_access_score', 'market_fit_score'])}, seifa_irsad_decile, "
    "reasons_top3 from s_custom_med",
)
check(
    "guardrails",
    f"select 'plain' as rule, area_id, active_poi_count, {shown(['market_fit_score'])} from s_full20 where "
    "active_poi_count >= 60 and mean_data_quality_score >= 0.93 union all "
    f"select 'premium', area_id, active_poi_count, {shown(['market_fit_score'])} from s_full20 where "
    "active_poi_count >= 60 and mean_data_quality_score >= 0.93 and market_fit_score >= 0.60",
)
check(
    "topk_areas",
    f"select area_id, {r6('opportunity_score')} as opportunity_score, active_poi_count, reasons_top3 from s_poi20 "
    "order by round(s_poi20.opportunity_score, 9) desc, area_id limit 50",
)
check(
    "diagnostic_top20",
    " union all ".join(
        f"select * from (select '{m}' as list, area_id, {r6(m)} as value, competitor_count, complementary_count, "
        f"active_poi_count from s_poi20 order by s_poi20.{m} desc, area_id limit 20)"
        for m in ("opportunity_score", "saturation_proxy", "complementarity_ratio")
    ),
)

# ---- checks: explanations and reports -------------------------------------------------------

check("top_reasons", "select area_id, reasons_top3, reasons_corrected from s_full20")
check(
    "score_breakdown",
    " union all ".join(
        f"select area_id, {quoted(label)} as factor, {r6(f'coalesce({c}, 0.0)')} as contribution from s_full20"
        for label, c in FACTORS
    ),
)
REPORT_COLUMNS = [*FEATURE_LIST, *LAYER_LIST, *TAIL, "lat_mean", "lon_mean", "complement_count", "data_quality_score",
                  "poi_count"]
CTES["s_report"] = (
    "select *, complementary_count as complement_count, mean_data_quality_score as data_quality_score, "
    "active_poi_count as poi_count, area_id as area_name, reasons_top3 as brief_reason from s_full20"
)


def as_text(c: str, style: str) -> str:
    if style == "str":
        text = f"nullif(trim(cast({c} as varchar)), '')"
    elif style == "int0":
        text = f"format('{{:,}}', cast(round_even({c}, 0) as bigint))"
    elif style == "float1":
        text = f"format('{{:,}}', cast(trunc({c}) as bigint)) || right(printf('%.1f', cast({c} as double)), 2)"
    else:
        text = f"printf('%.{style[5:]}f', cast({c} as double))"
    return f"coalesce({text}, '—')"


check(
    "metrics_table",
    " union all ".join(
        f"select area_id, {quoted(g)} as metric_group, {quoted(label)} as metric, {as_text(c, style)} as value, "
        f"{quoted(c)} as field from s_report"
        for g, label, c, style in METRICS
        if c in REPORT_COLUMNS
    ),
)
check(
    "metrics_payload",
    "select area_id, "
    + shown(["opportunity_score", "saturation_proxy", "mean_data_quality_score", "rent_affordability_score"])
    + ", competitor_count, complementary_count as complement_count, reasons_top3 from s_full20",
)


def f2(c: str) -> str:
    return f"printf('%.2f', {c})"


check(
    "area_narrative",
    "select area_id, 'This **Gym / boutique fitness** shortlist cell in **Sydney** (area `' || area_id || '`) scores **' "
    "|| printf('%.3f', opportunity_score) || '** on the opportunity index, using POI-based proxies only—not revenue "
    "or foot traffic.' || chr(10) || chr(10) || 'Surrounding mix: **' || competitor_count || '** competitor-style "
    "POIs, **' || complementary_count || '** complement POIs, **' || active_poi_count || '** active POIs (activity "
    f"proxy).' || chr(10) || chr(10) || 'Context layers: data quality ≈ **' || {f2('mean_data_quality_score')} || "
    f"'**; transit access proxy ≈ **' || {f2('transit_access_score')} || '**; market fit proxy ≈ **' || "
    f"{f2('market_fit_score')} || '**' || coalesce('; rent affordability proxy ≈ **' || "
    f"{f2('rent_affordability_score')} || '** (rental stress share ≈ **' || {f2('rent_stress_share')} || '**)', '') "
    "|| '.' || chr(10) || chr(10) || '**Top score drivers (auto):** ' || reasons_top3 || chr(10) || chr(10) || "
    "'**Validate on site:** (1) observe weekday/weekend traffic near candidate streets; (2) compare your offer vs. "
    "nearby competitors; (3) confirm lease, access, and planning constraints.' as narrative from s_full20",
)


def comma(c: str) -> str:
    return f"format('{{:,}}', {c})"


check(
    "strategy_cards",
    f"select area_id, {quoted(STRATEGY_SUMMARY['low competition'])} as summary, 'Strong activity proxy (≈ ' || "
    f"{comma('commercial_activity_proxy')} || ' active POIs in-area).' || chr(10) || 'Supportive ecosystem (' || "
    f"{comma('complementary_count')} || ' complementary venues).' || chr(10) || 'Category diversity (≈ ' || "
    f"{comma('unique_category_count')} || ' unique categories) suggests mixed-use catchment.' || chr(10) || "
    f"'Data quality is solid (≈ ' || {f2('mean_data_quality_score')} || ').' as pros, 'Direct competition exists (' || "
    f"{comma('competitor_count')} || ' competitors).' || chr(10) || 'Saturation proxy (≈ ' || printf('%.3f', "
    "saturation_proxy) || ') may indicate tighter share-of-wallet dynamics.' || chr(10) || 'Area-unit artifacts: "
    "boundaries may not match real neighborhoods or trade areas.' as risks from s_poi20",
)
CTES["t_lists"] = "select * from (values " + ", ".join(
    f"({quoted(key)}, {quoted(section)}, {i}, {quoted(text)})"
    for key, lists in CHECKLISTS.items()
    for section, texts in lists.items()
    for i, text in enumerate(texts, 1)
) + ") v(template, section, step, advice)"
check(
    "checklist",
    "select template, area_id, section, step, advice from s_all20 join t_lists using (template)",
)
check(
    "top_categories_per_area",
    "select area_id, rank, category_id, coalesce(category_name, category_id) as category_name, cnt from (select *, "
    "row_number() over (partition by area_id order by cnt desc, category_id) as rank from t_counts) left join t_cat "
    "using (category_id) where rank <= 10",
)
check(
    "competitor_examples",
    "select area_id, place_id, name, category_id, coalesce(category_name, category_id) as category_name from (select *, "
    "row_number() over (partition by area_id order by place_id, category_id, name nulls first) as rn from (select "
    "distinct area_id, place_id, name, category_id from t_pois where category_id in (select category_id from t_strict))) "
    "left join t_cat using (category_id) where rn <= 20",
)
CTES["t_used"] = "select distinct complement_group from t_groups"
check(
    "complement_breakdown",
    "select area_id, complement_group, cast(coalesce(s, 0) as bigint) as count from (select distinct area_id from "
    "t_counts) cross join t_used left join (select area_id, complement_group, sum(cnt) as s from t_counts join "
    "t_groups using (category_id) group by area_id, complement_group) using (area_id, complement_group)",
)
check(
    "calibration_counts",
    "select (select count(*) from t_places where lat between -34.20 and -33.55 and lon between 150.85 and 151.45) as "
    "total_poi_count, (select count(*) from t_pois join t_strict using (category_id) where lat between -34.20 and "
    "-33.55 and lon between 150.85 and 151.45) as competitor_poi_count",
)
CTES["t_metro_places"] = " union all ".join(
    f"select *, {quoted(k)} as metro_key from t_cells where {box(c.bbox)}" for k, c in METROS.items()
)
features("t_feat_metro", "area_id", "t_metro_places", False, "metro_key, ")
CTES["t_cafe_metro"] = "select * from t_feat_metro where template = 'cafe'"
scored("s_metro", "t_cafe_metro", {"cafe": TEMPLATES["cafe"].weights}, False)
check(
    "metro_ranked",
    f"select metro_key, area_id, active_poi_count, {shown(['opportunity_score'])} from s_metro",
)
CTES["t_metros"] = "select * from (values " + ", ".join(
    f"({quoted(k)}, {quoted(c.label)})" for k, c in METROS.items()
) + ") v(metro_key, label)"
CTES["t_summary"] = (
    "select metro_key, label, case when n is null then 'missing_parquet' when n = 0 then 'no_qualified_cells' else "
    "'ok' end as status, coalesce(n, 0) as n_cells_qualified, median_top_score, max_score from t_metros left join "
    "(select metro_key, count(*) filter (active_poi_count >= 20) as n from s_metro group by metro_key) using "
    "(metro_key) left join (select metro_key, median(opportunity_score) as median_top_score, max(opportunity_score) "
    "as max_score from (select *, row_number() over (partition by metro_key order by round(opportunity_score, 9) desc, area_id) "
    "as rn from s_metro where active_poi_count >= 20) where rn <= 25 group by metro_key) using (metro_key)"
)
check(
    "metro_summary",
    f"select metro_key, label, status, n_cells_qualified, {r6('median_top_score')} as median_top_score, "
    f"{r6('max_score')} as max_score from t_summary",
)
check("metro_status", "select status, count(*) as metros from t_summary group by status")
check(
    "alignment_check",
    f"select count(*) as top_n, {r6('median(market_fit_score)')} as median_market_fit, "
    "cast(trunc(median(seifa_irsad_decile)) as bigint) as median_irsad_decile from (select * from s_full20 order by "
    "round(opportunity_score, 9) desc, area_id limit 50)",
)


def best_by(metric: str, source: str, k: int = 1) -> str:
    return f"(select area_id from {source} order by {metric} desc, area_id limit {k})"


_COMPARE = [
    c
    for c in report_columns([*REPORT_COLUMNS, "area_name", "brief_reason"])
    if c not in ("recent_refresh_share", "template")
]
check(
    "compare_areas",
    f"select area_id, {shown(_COMPARE)} from s_report where area_id in {best_by('opportunity_score', 's_full20')} or "
    f"area_id in {best_by('active_poi_count', 's_full20')} or area_id in {best_by('saturation_proxy', 's_full20')}",
)
check(
    "shortlist_notes",
    f"select area_id, {shown(['opportunity_score'])}, 'Visit' as shortlist_status, 'see ' || active_poi_count || "
    f"' places' as shortlist_notes, {shown(['lat_mean', 'lon_mean'])} from s_poi20 where area_id in "
    f"{best_by('active_poi_count', 's_poi20', 3)}",
)
CTES["s_top100"] = "select * from s_full20 order by round(opportunity_score, 9) desc, area_id limit 100"
CTES["s_map"] = (
    "select *, case when max(opportunity_score) over () = min(opportunity_score) over () then 0.0::double "
    f"else {minmax('opportunity_score')} end as score_norm from s_top100"
)
check(
    "map_points",
    f"select {r6('lat_mean')} as lat, {r6('lon_mean')} as lon, {r6('opportunity_score')} as opportunity_score, "
    "competitor_count, complementary_count as complement_count, active_poi_count as poi_count, area_id, sal_name_2021, "
    "sa2_name_2021, " + shown(["transit_access_score", "market_fit_score", "rent_affordability_score"])
    + f", {r6('score_norm')} as score_norm, coalesce(nullif(concat_ws(' • ', nullif(sal_name_2021, ''), "
    "nullif(sa2_name_2021, '')), ''), 'Unknown area') as area_label, cast(trunc(220.0::double - 160.0::double * "
    "score_norm) as int) as fill_r, cast(trunc(60.0::double + 160.0::double * score_norm) as int) as fill_g, "
    "cast(80 as int) as fill_b, cast(150 as int) as fill_a from s_map",
)


# ---- samples, bitmaps, and files written and read back ---------------------------------------


def sampled(n: int, key: str, tie: str, shown_columns: str) -> str:
    order = f"md5(coalesce({key}, '') || '|42'), md5(coalesce({tie}, '') || '|42')"
    return f"select {shown_columns} from (select *, row_number() over (order by {order}) as rn from t_places) where rn <= {n}"


check("capped_sample", sampled(5000, "place_id", "concat_ws('|', name, country, locality, region)", f"place_id, {r6('lat')} as lat, {r6('lon')} as lon"))
check("capped_sample_hot", sampled(2000, "locality", "place_id", "place_id, locality"))
_LISTED = "(select {}, unnest(category_ids) as category_id from t_cells) where category_id is not null group by {}"
check("area_distinct_categories", f"select area_id, count(distinct category_id) as distinct_category_count from {_LISTED.format('area_id', 'area_id')}")
check("country_distinct_categories", f"select country, count(distinct category_id) as distinct_category_count from {_LISTED.format('country', 'country')}")
check(
    "noted_csv_readback",
    "select sa2_code_2021, sa2_name_2021 || ', AU' as sa2_name_2021, rent_stress_households, total_renting_households "
    "from t_hh where total_renting_households > 0",
)
_CORNERS = []
for part, ring, corners, shift, condition in (
    ("0", "0", OUTLINE, 0, "true"), ("0", "1", HOLE, 0, "region_order % 3 = 0"),
    ("1", "case when region_order % 3 = 0 then 2 else 1 end", OUTLINE, 1, "region_order % 4 = 1"),
):
    for corner, (fx, fy) in enumerate(corners):
        _CORNERS.append(
            f"select code, name, cast({part} as int) as part, cast({ring} as int) as ring, cast({corner} as int) as corner, "
            f"{r6(f'x0 + {fx}::double * w + {shift}::double')} as x, {r6(f'y0 + {fy}::double * h')} as y from t_reg where {condition}"
        )
check("region_parts_readback", " union all ".join(_CORNERS))
check(
    "point_lines_readback",
    "with l as (select c_custkey as k, c_name as n, '{\"type\":\"Feature\",\"properties\":{\"name\":\"' || c_name || '\"},\"geometry\":' || "
    "case when c_custkey % 13 = 0 then 'null' else '{\"type\":\"Point\",\"coordinates\":[' || (c_custkey % 180) || ',' || (c_custkey % 90) || ']}' end "
    "|| '}' as whole from customer) "
    "select case when k % 7 <> 0 and k % 11 <> 0 then n end as name, case when k % 7 <> 0 and k % 11 <> 0 then cast(k % 90 as double) end as lat, "
    "case when k % 7 <> 0 and k % 11 <> 0 then cast(k % 180 as double) end as lon, case when k % 7 = 0 then substr(whole, 1, 40) "
    "when k % 11 = 0 then 'remark ' || k end as rejected from l where k % 7 = 0 or k % 11 = 0 or k % 13 <> 0",
)
CHECKS["observed_funnel"] = CHECKS["row_funnel"]
check(
    "clustered_readback",
    f"select place_id, {r6('lat')} as lat, {r6('lon')} as lon, coalesce(country, 'none') as country, "
    f"case when country = 'NZ' then 'rewritten' else locality end as locality from t_places where {box(WEST)}",
)
check("compacted_shards", "select country, count(*) as n, count(distinct place_id) as ids from t_places group by country")
