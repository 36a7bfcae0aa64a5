"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every shard draws a number from the hash of (record key, shard) and bids ``-weight / ln(number)``;
the highest bid wins. Only the key and the shard list decide, so one more shard takes rows only
into itself, and a changed weight moves rows only to or from that shard.

Slots number the rows of a shard without gaps. They are counted per input part and shard and
shifted by the counts of the parts before, so a shard with a third of all rows is numbered by as
many tasks as it has parts.

Nulls: a null key is a key of its own; a null text has no bytes (size 16, checksum 0). Repeated
keys go to the same shard and get different slots. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.llm.common import Shielded
from sitegrain.runtime import cut_lineage

_PART_BITS = 33


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard, from 0. Equal bids go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    known = F.coalesce(key.cast("string"), F.lit("\u0000null"))

    def bid(weight: Column, shard: Column) -> Column:
        # 52 hash bits as a number strictly between 0 and 1.
        draw = (F.shiftrightunsigned(F.xxhash64(known, shard.cast("int")), 12).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-weight / F.log(draw)).alias("bid"), (-shard).alias("shard"))

    return (-F.array_max(F.transform(F.array(*[F.lit(float(w)) for w in weights]), bid))["shard"]).cast("int")


def with_slots(df: DataFrame, shard: str, out: str) -> DataFrame:
    """``df`` with gapless numbers from 0 within each shard."""
    named = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART_BITS)
    sizes = named.groupBy(F.col(shard).alias("_shard"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per shard and input part.
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_at"))
    numbered = named.withColumns({"_shard": F.col(shard), "_part": part}).withColumn("_row", local)
    placed = numbered.join(before, ["_shard", "_part"]).withColumn(out, (F.col("_before") + F.col("_row") - 1).cast("long"))
    return placed.drop("_shard", "_part", "_row", "_before", "_at")


def assign_shards(docs: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``docs`` with ``_s_shard``, ``_s_slot`` and, for a second shard list, ``_s_grown``."""
    shield = Shielded(docs)
    k = F.col(shield.of(key))
    placed = shield.df.withColumn("_s_shard", rendezvous(k, weights))
    if grown is not None:
        placed = placed.withColumn("_s_grown", rendezvous(k, grown))
    return shield.back(with_slots(placed, "_s_shard", "_s_slot"))


def size_of(text: Column, overhead: int = 16) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def checksum_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
