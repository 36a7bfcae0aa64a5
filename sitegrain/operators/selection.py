"""The first ``n`` rows of a huge table in the order of a hash, without sorting it.

The hash is an MD5 in hex, which any engine can compute, so a selection can be repeated elsewhere.
A histogram over the next few digits finds the range that holds row ``n``; inside it the following
digits are looked at, until the range ends at row ``n`` exactly or is one single hash. Each round
sends at most 16**4 counts to the driver, whatever the number of rows. Rows that share the last
hash are told apart by a second hash, of the whole row; rows equal in that too are copies, and so
many copies are made as are missing. A row repeated very often costs no task more than others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 4
HASH_DIGITS = 32
#: Copies of one row that a task makes.
COPIES = 100_000


def seeded_hash(parts: Sequence[Column], seed: int) -> Column:
    """MD5 of the parts and the seed, joined by bars; nulls count as blanks."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))))


def _cut(df: DataFrame, key: str, n: int) -> tuple[str, int, int] | None:
    """(prefix, rows below it, rows that have it) of the range in which row ``n`` falls; ``None`` if there are fewer rows."""
    prefix, below = "", 0
    while True:
        digits = len(prefix) + DIGITS
        here = df.filter(F.col(key).startswith(prefix)) if prefix else df
        bins = here.groupBy(F.substring(key, 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        size = 0
        for row in sorted(bins):
            prefix, size = row.p, row.n
            if below + size >= n:
                break
            below += size
        else:
            return None
        if below + size == n or digits >= HASH_DIGITS:
            return prefix, below, size


def first_by_hash(df: DataFrame, n: int, by: Sequence[str], seed: int = 42, tie: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows of ``df`` (all, if it has fewer): those whose ``by`` columns have the smallest hashes.

    ``tie`` is a text that tells rows with equal ``by`` columns apart; the whole row as JSON by default.
    """
    if n <= 0:
        return df.limit(0)
    columns = df.columns
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}) if tie is None else tie
    keyed = df.select("*", seeded_hash([F.col(f"`{c}`") for c in by], seed).alias("_hash"), row.alias("_row"))
    parts: list[DataFrame] = []
    for key in ("_hash", "_row"):
        if key == "_row":
            keyed = keyed.withColumn("_row", seeded_hash([F.col("_row")], seed))
        cut = _cut(keyed, key, n)
        if cut is None:
            return df
        prefix, below, size = cut
        start = F.substring(key, 1, len(prefix))
        if below + size == n:
            parts.append(keyed.filter(start <= prefix))
            break
        parts.append(keyed.filter(start < prefix))
        keyed, n = keyed.filter(start == prefix), n - below
    else:
        tasks = -(-n // COPIES)
        dealt = keyed.limit(1).withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition("_task")
        own = F.least(F.lit(COPIES), F.lit(n) - F.col("_task") * COPIES).cast("int")
        parts.append(dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), own))))
    picked = [p.select(*[F.col(f"`{c}`") for c in columns]) for p in parts]
    return reduce(DataFrame.unionByName, picked)
