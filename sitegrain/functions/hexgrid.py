"""Hexagonal cells as plain column arithmetic.

Points are projected with a cylindrical equal-area projection and dropped into a
pointy-top hexagonal lattice. A cell is one bigint while data is grouped (cheap to hash
and to shuffle) and becomes a readable id afterwards. Nothing here leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0072
# Target cell area in square kilometres per resolution.
CELL_AREA_KM2 = {6: 36.129, 7: 5.161, 8: 0.737, 9: 0.105, 10: 0.0150}
_HALF = 1 << 24
_SPAN = 1 << 25


def edge_km(resolution: int) -> float:
    if resolution not in CELL_AREA_KM2:
        raise ValueError(f"resolution must be one of {sorted(CELL_AREA_KM2)}")
    return math.sqrt(CELL_AREA_KM2[resolution] * 2.0 / (3.0 * math.sqrt(3.0)))


def on_globe(lat: str = "lat", lon: str = "lon") -> Column:
    """True for usable coordinates; plain comparisons that a scan can apply."""
    return F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0)


def with_hex_key(
    df: DataFrame, resolution: int = 8, out: str = "area_key", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add the packed cell number of each row, null when the coordinates are not usable.

    The steps are separate projections on purpose: every intermediate value is used several
    times, and one nested expression would repeat the trigonometry in each use.
    """
    size = edge_km(resolution)
    x, y, q, r, s, rq, rr, rs = (F.col(f"_hex_{n}") for n in ("x", "y", "q", "r", "s", "rq", "rr", "rs"))
    steps = (
        {
            "_hex_x": F.lit(EARTH_KM) * F.radians(lon),
            "_hex_y": F.lit(EARTH_KM) * F.sin(F.radians(lat)),
        },
        {
            "_hex_q": (F.lit(math.sqrt(3.0) / 3.0) * x - y / F.lit(3.0)) / F.lit(size),
            "_hex_r": (F.lit(2.0 / 3.0) * y) / F.lit(size),
        },
        {"_hex_s": -q - r},
        {"_hex_rq": F.floor(q + 0.5), "_hex_rr": F.floor(r + 0.5), "_hex_rs": F.floor(s + 0.5)},
        {"_hex_dq": F.abs(rq - q), "_hex_dr": F.abs(rr - r), "_hex_ds": F.abs(rs - s)},
    )
    for step in steps:
        df = df.withColumns(step)
    # Of the three rounded axes, the one that moved the most follows from the other two.
    dq, dr, ds = F.col("_hex_dq"), F.col("_hex_dr"), F.col("_hex_ds")
    off_q = (dq > dr) & (dq > ds)
    column = F.when(off_q, -rr - rs).otherwise(rq)
    row = F.when(~off_q & (dr > ds), -rq - rs).otherwise(rr)
    packed = (column + F.lit(_HALF)) * F.lit(_SPAN) + row + F.lit(_HALF)
    return df.withColumn(out, F.when(on_globe(lat, lon), packed)).drop(
        *[f"_hex_{n}" for n in ("x", "y", "q", "r", "s", "rq", "rr", "rs", "dq", "dr", "ds")]
    )


def _axes(key: Column) -> tuple[Column, Column]:
    return (
        F.shiftright(key, 25) - F.lit(_HALF),
        key.bitwiseAND(F.lit(_SPAN - 1)) - F.lit(_HALF),
    )


def key_to_id(key: Column, resolution: int = 8) -> Column:
    q, r = _axes(key)
    return F.concat(F.lit(f"hx{resolution}_"), q.cast("string"), F.lit("_"), r.cast("string"))


def cell_center(cell_id: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a cell; null for text that is no cell id."""
    q = F.regexp_extract(cell_id, r"^hx\d+_(-?\d+)_(-?\d+)$", 1).try_cast("double")
    r = F.regexp_extract(cell_id, r"^hx\d+_(-?\d+)_(-?\d+)$", 2).try_cast("double")
    resolution = F.regexp_extract(cell_id, r"^hx(\d+)_", 1)
    size = F.lit(None).cast("double")
    for level in CELL_AREA_KM2:
        size = F.when(resolution == F.lit(str(level)), F.lit(edge_km(level))).otherwise(size)
    x = size * (F.lit(math.sqrt(3.0)) * q + F.lit(math.sqrt(3.0) / 2.0) * r)
    y = size * F.lit(1.5) * r
    ratio = y / F.lit(EARTH_KM)
    lat = F.degrees(F.asin(F.when(F.abs(ratio) <= 1.0, ratio)))
    return lat, F.degrees(x / F.lit(EARTH_KM))
