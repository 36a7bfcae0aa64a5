"""Orders, ranks and top lists.

Top lists use ``limit`` or a ranked window with a small bound, both of which Spark prunes
inside each task. A full rank has no bound, so it is not a window: rows are range-sorted
over the cluster and numbered from per-partition counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.runtime import cut_lineage


#: Decimals of a score that decide an order. Beyond them only the order of summation shows, so such scores are tied.
SCORE_DECIMALS = 9


def by_score(score: str = "opportunity_score", id_col: str = "area_id") -> list[Column]:
    """Best first by ``SCORE_DECIMALS`` decimals, missing scores last, ties by id."""
    return [F.round(score, SCORE_DECIMALS).desc_nulls_last(), F.col(id_col).asc()]


def top_k(df: DataFrame, k: int, by: str = "opportunity_score", id_col: str = "area_id") -> DataFrame:
    return df.orderBy(*by_score(by, id_col)).limit(k)


def bottom_k(df: DataFrame, k: int, by: str, id_col: str = "area_id") -> DataFrame:
    return df.orderBy(F.col(by).asc_nulls_last(), F.col(id_col).asc()).limit(k)


def head_per_group(
    df: DataFrame, group: Sequence[str] | str, n: int, order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per group with their position."""
    groups = [group] if isinstance(group, str) else list(group)
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col(out) <= n)


_ROW_BITS = 33


def full_rank(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    out: str = "rank",
) -> DataFrame:
    """Every row's 1-based position in an order, over all rows or per group.

    The sort is a range exchange, so one huge group spreads over many tasks. Row numbers
    inside a partition come with the row; the offsets are one count per partition.
    """
    spread = df.orderBy(*[F.col(c) for c in by], *order)
    numbered = cut_lineage(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    # One row per sort partition: the only data this window ever sees.
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    placed = (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_row", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1)
        .drop("_part", "_before", "_at")
    )
    if not by:
        return placed.withColumnRenamed("_row", out)
    starts = placed.groupBy(*by).agg((F.min("_row") - 1).alias("_start"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = placed.alias("p").join(starts.alias("s"), condition)
    return joined.select("p.*", F.col("s._start").alias("_start")).withColumn(
        out, F.col("_row") - F.col("_start")
    ).drop("_row", "_start")
