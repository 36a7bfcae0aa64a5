"""What several operators share: Arrow batches of texts as byte arrays, word spans and 64-bit hashes.

Hashes are sums of products modulo 2**64 over fixed pseudo-random tables, followed by a mixing
step, so every task and every run gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.runtime import new_folder

#: Bytes of text that one step of an array computation handles; a longer single text is handled alone.
BLOCK_BYTES = 512 << 10
#: Bytes of one batch between Spark and Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python hold a bounded number of bytes, not of rows, unless the session says how many itself."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as compressed columns in the shared folder; several reads see the same rows."""
    folder = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Shielded:
    """A table under neutral column names, so that an operator's own columns clash with none of its."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def of(self, name: str) -> str:
        """The neutral name of a column."""
        return f"c{self.names.index(name)}"

    def back(self, out: DataFrame) -> DataFrame:
        """``out`` under the given names again. A given column named like an added one gives way to it."""
        own = {f"c{i}": n for i, n in enumerate(self.names) if f"c{i}" in out.columns}
        added = [c for c in out.columns if c not in own]
        given = [F.col(c).alias(n) for c, n in own.items() if n not in added]
        return out.select(*given, *[F.col(c) for c in added])


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixing step (the finaliser of SplitMix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table_of(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mixed(np.arange(n, dtype=np.uint64), seed) | np.uint64(1)


BYTE = table_of(256, 1)


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) per run of rows with about ``limit`` bytes of text. Null: no bytes."""
    column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of all words ``[^\\x20\\x09-\\x0D]+``; words do not cross texts."""
    if not data.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    cut = np.zeros(data.size, dtype=bool)
    inner = offsets[:-1][offsets[:-1] < data.size]
    cut[inner] = True
    begins = inside & cut
    begins[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(begins)
    stops = inside & np.append(cut[1:], True)
    stops[:-1] |= inside[:-1] & ~inside[1:]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash per word; ``fold`` takes A-Z as a-z."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    at = within + np.repeat(starts, lengths)
    terms = BYTE[LOWER[data[at]] if fold else data[at]] * table_of(int(lengths.max()), 2)[within]
    return mixed(np.add.reduceat(terms, firsts))


def gram_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word) of every run of ``n`` words inside one text."""
    if words.size < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = words.size - n + 1
    total = np.zeros(m, np.uint64)
    for j, k in enumerate(table_of(n, 3)):
        total += words[j : j + m] * k
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return mixed(total[at]), at


def group_key(*columns: str) -> Column:
    """One string per combination of values; nulls are a value of their own."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))
