"""Points in polygons, polygon centroids, box overlap.

The join is an equi-join on grid cells. Each polygon has a cover: cells of a grid level that
fits its size and its number of edges. A cell wholly inside is a hit without any test; a cell
on the border keeps only the edges that reach into it. What the edges to the right of a cell
add to the ray-cast parity is worked out when the cover is built: inside a run of such edges
every corner counts twice and drops out, so only the run's two ends remain. An end above the
cell flips a constant, one below does nothing, and one level with it stays as a number. The
answer is that of a ray cast over all edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.config import BoundingBox
from sitegrain.functions.geometry import covers_from

BASE_DEGREES = 0.01
MIN_LEVEL, MAX_LEVEL = -8, 16
#: A border cell of a polygon with many edges holds about so many.
CELL_EDGES = 16
#: Edges this close to a cell's side belong to the cell, so rounding of a crossing cannot matter.
MARGIN = 1e-9


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / (F.lit(BASE_DEGREES) * F.pow(F.lit(2.0), level)))


def grid_level(edges: Column, extent: Column) -> Column:
    """The level whose cells are as large as the box, finer by one for every fourfold of ``CELL_EDGES`` edges."""
    whole = F.ceil(F.log2(F.greatest(extent, F.lit(1e-12)) / F.lit(BASE_DEGREES)))
    finer = F.ceil(F.log2(F.greatest(F.size(edges) / F.lit(float(CELL_EDGES)), F.lit(1.0))) / 2)
    return F.least(F.greatest(whole - finer, F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL)).cast("int")


def region_level() -> Column:
    """The grid level of an indexed region's cover."""
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return grid_level(F.col("edges"), extent)


def cover_index(indexed: DataFrame) -> DataFrame:
    """The cover of every region: ``region_order``, its cells, and per cell ``odd``, ``own`` edges and ``ends``.

    All of it is made row by row from the edge list: nothing is shuffled, and a region of n edges
    gets about n / ``CELL_EDGES`` cells. Cells wholly outside are left out.
    """
    level = F.col("grid_level")

    def cell(value: Column) -> Column:
        return _cell(value, level)

    def placed(e: Column) -> Column:
        low, high = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
        return F.struct(
            *[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
            cell(low - MARGIN).alias("c0"), cell(high + MARGIN).alias("c1"), cell(e["px"] - MARGIN).alias("before"),
            cell(F.least(e["y1"], e["y2"])).alias("r0"), cell(F.greatest(e["y1"], e["y2"])).alias("r1"),
        )

    # A corner is the end of a run for the columns that have one of its two edges on the right and the other not.
    ends = F.filter(
        F.transform(
            "placed",
            lambda e: F.struct(
                F.least(e["c0"], e["before"]).alias("k0"), F.greatest(e["c0"], e["before"]).alias("k1"),
                F.floor(e["y1"] / (F.lit(BASE_DEGREES) * F.pow(F.lit(2.0), level))).alias("row"), e["y1"].alias("y"),
            ),
        ),
        lambda v: v["k0"] < v["k1"],
    )
    regions = (
        indexed.filter(F.col("min_x").isNotNull())
        .withColumn("grid_level", region_level())
        .select(
            "region_order", "grid_level", F.transform("edges", placed).alias("placed"),
            F.sequence(cell(F.col("min_x")), cell(F.col("max_x"))).alias("columns"),
            F.sequence(cell(F.col("min_y")), cell(F.col("max_y"))).alias("rows"),
        )
        .withColumn("ends", ends)
    )
    x, y = F.col("grid_x"), F.col("grid_y")
    columns = regions.select("region_order", "grid_level", "placed", "ends", "rows", F.explode("columns").alias("grid_x")).select(
        "region_order", "grid_level", "grid_x", "rows",
        F.filter("placed", lambda e: (e["c0"] <= x) & (e["c1"] >= x)).alias("placed"),
        F.filter("ends", lambda v: (v["k0"] <= x) & (v["k1"] > x)).alias("ends"),
    )
    own = F.filter("placed", lambda e: (e["r0"] <= y) & (e["r1"] >= y))
    cells = columns.select("*", F.explode("rows").alias("grid_y")).select(
        "region_order", "grid_level", "grid_x", "grid_y",
        (F.size(F.filter("ends", lambda v: v["row"] > y)) % 2 == 1).alias("odd"),
        F.transform(own, lambda e: F.struct(*[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("own"),
        F.transform(F.filter("ends", lambda v: v["row"] == y), lambda v: v["y"]).alias("ends"),
    )
    return cells.filter(F.col("odd") | (F.size("own") > 0) | (F.size("ends") > 0))


def locate(
    points: DataFrame,
    indexed: DataFrame,
    id_col: str,
    lat: str,
    lon: str,
    code: str,
    name: str,
    cover: DataFrame | None = None,
) -> DataFrame:
    """(id, code, name) of the polygon around each point; nulls where there is none.

    Where polygons overlap the one with the lowest ``region_order`` wins; it is what tells regions
    apart, and rows that share one are named after the smallest. Points with null coordinates
    match nothing. The grid join is left to the optimizer: it broadcasts the cover while it is
    small and shuffles by grid cell beyond that. ``cover`` is a kept ``cover_index(indexed)``.
    """
    cells = cover_index(indexed) if cover is None else cover
    # At most one integer per level, from the boxes: the cover itself is built once, for the join.
    levels = indexed.filter(F.col("min_x").isNotNull()).agg(F.collect_set(region_level()).alias("levels")).scalar()
    p = points.select(
        F.col(id_col).alias("_id"),
        F.col(lon).alias("_x"),
        F.col(lat).alias("_y"),
        F.explode_outer(levels).alias("_level"),
    )
    x, y, level = F.col("_x"), F.col("_y"), F.col("_level")
    p = p.withColumns({"_gx": _cell(x, level), "_gy": _cell(y, level)})
    same_cell = (level == F.col("grid_level")) & (F.col("_gx") == F.col("grid_x")) & (F.col("_gy") == F.col("grid_y"))
    tried = p.join(cells, same_cell & covers_from(F.col("own"), F.col("ends"), F.col("odd"), x, y), "left")
    hit = tried.groupBy("_id").agg(F.min("region_order").alias("region_order"))
    names = indexed.groupBy("region_order").agg(F.array_min(F.collect_list(F.struct("code", "name"))).alias("_hit"))
    return hit.join(names, "region_order", "left").select(
        F.col("_id").alias(id_col), F.col("_hit.code").alias(code), F.col("_hit.name").alias(name)
    )


def region_centroids(indexed: DataFrame) -> DataFrame:
    """Area-weighted centroid per region from shoelace sums over its edges."""
    e = F.col("e")
    cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
    sums = indexed.select("code", F.explode("edges").alias("e")).groupBy("code").agg(
        F.sum(cross).alias("a"),
        F.sum((e["x1"] + e["x2"]) * cross).alias("mx"),
        F.sum((e["y1"] + e["y2"]) * cross).alias("my"),
    )
    area = F.nullif(F.col("a") * 3.0, F.lit(0.0))
    return sums.select("code", (F.col("my") / area).alias("lat"), (F.col("mx") / area).alias("lon"))


def centroid_region_map(source: DataFrame, target: DataFrame, code: str, name: str) -> DataFrame:
    """The target region that holds each source region's centroid."""
    return locate(region_centroids(source), target, "code", "lat", "lon", code, name)


def regions_in_bbox(indexed: DataFrame, bbox: BoundingBox) -> DataFrame:
    """Regions whose bounding box touches the given box."""
    return indexed.filter(
        (F.col("max_x") >= bbox.min_lon)
        & (F.col("min_x") <= bbox.max_lon)
        & (F.col("max_y") >= bbox.min_lat)
        & (F.col("min_y") <= bbox.max_lat)
    )
