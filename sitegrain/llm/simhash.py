"""SimHash near-dedup with a vantage-point tree over the distinct fingerprints.

Texts become 64-bit fingerprints; equal fingerprints are one point from there on, so thousands of
copies cost one row. A vantage-point tree built on a sample partitions the points by Hamming
distance: each node has a vantage point and a radius, and a point at distance d lives inside
(d <= radius) or outside. The number of leaves follows the number of points: a tree has up to
``LEAVES`` leaves, and a leaf that is still too full gets a tree of its own in the next level,
shaped by ``PER_LEAF`` sampled points a leaf, until no leaf can be split further. By the
triangle inequality a partner within k bits can be on the other side only if d is within k of the
radius; only then a copy of the point also visits that side. One crossing per pair is enough, so
points cross from inside to outside only, and a visiting copy follows every branch it may have a
partner in. Every shard compares its own points with each other and with its visitors, again
behind distances to vantage points, so the pairs are exact.

A shard reports a spanning forest of what it linked instead of all pairs, which keeps the
components and is never more than one row per point. Components follow by large-star and
small-star rounds in Spark.

Nulls: a null text has no words (fingerprint zero, linked like any other). Null ids are carried;
a component's id is its smallest non-null one. Repeated rows share a fingerprint. Columns of the
input keep their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import Shielded, written
from sitegrain.llm.components import components
from sitegrain.runtime import cut_lineage

#: Points that live in one shard. Every level of a tree adds visitors, so shards are large and split by shells inside a task.
SHARD_POINTS = 65_536
LEAVES = 1_024
#: Sampled points that shape a tree, per leaf. They go to the driver: one of ``SHARD_POINTS / PER_LEAF`` fingerprints.
PER_LEAF = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of one text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins, count = np.cumsum(sizes) - sizes, len(words)
    del words
    n = max(1, count - shingle + 1)
    ends = (begins + sizes - 1)[-n:] if count >= shingle else np.array([len(joined)])
    ones = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 16):
        # Only one step's places become Python numbers: a long text has millions of shingles.
        part = zip(begins[:n][first : first + (1 << 16)].tolist(), ends[first : first + (1 << 16)].tolist())
        h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in part), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "_fp") -> DataFrame:
    """``docs`` without ``text`` plus the fingerprint as a signed 64-bit number."""
    kept = [c for c in docs.columns if c != text]
    fields = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, "long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in b.column(text).cast(pa.large_binary())]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [prints], names=kept + [out])

    return docs.mapInArrow(add, fields)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class VantageTree:
    """A binary tree of (vantage point, radius); leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves = 0
        self.root = self._grow(sample, max(1, leaves))

    def _grow(self, points: np.ndarray, leaves: int):
        if leaves > 1 and points.size >= 4:
            vantage = points[0]
            d = _bits(points ^ vantage)
            radius = int(np.median(d))
            inside, outside = points[d <= radius], points[d > radius]
            if inside.size and outside.size:
                half = leaves // 2
                return (vantage, radius, self._grow(inside[1:], leaves - half), self._grow(outside, half))
        self.leaves += 1
        return self.leaves - 1

    def route(self, points: np.ndarray, k: int, lives: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the point, leaf, lives there) for every leaf that a point lives in or has to visit.

        ``lives``: whether each point lives in this tree at all; the others are visitors in it.
        """
        rows, leaves, homes = [], [], []
        stack = [(self.root, np.arange(points.size), np.ones(points.size, dtype=bool) if lives is None else lives)]
        while stack:
            node, at, home = stack.pop()
            if not at.size:
                continue
            if isinstance(node, int):
                rows.append(at), leaves.append(np.full(at.size, node)), homes.append(home)
                continue
            vantage, radius, inside, outside = node
            d = _bits(points[at] ^ vantage)
            near = np.where(home, d <= radius, d <= radius + k)
            # A point that lives inside visits the outside if a partner can be there.
            far = d > radius - k
            stack.append((inside, at[near], home[near]))
            stack.append((outside, at[far], (home & (d > radius))[far]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype=bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def close_pairs(homes: np.ndarray, visitors: np.ndarray, k: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, visitor) at ``k`` or fewer differing bits.

    Distances to a vantage point split both sides into shells; only shells within ``k`` of each
    other can hold a pair. Small products are compared directly.
    """
    if not homes.size or not visitors.size:
        return
    if homes.size * visitors.size <= 1 << 16 or depth == 24:
        step = max(1, (1 << 22) // homes.size)
        for first in range(0, visitors.size, step):
            v, h = np.nonzero(np.bitwise_count(visitors[first : first + step, None] ^ homes[None, :]) <= k)
            yield h, v + first
        return
    vantage = homes[(depth * 7919) % homes.size]
    dh, dv = _bits(homes ^ vantage), _bits(visitors ^ vantage)
    for shell in np.unique(dh):
        hs, vs = np.flatnonzero(dh == shell), np.flatnonzero(np.abs(dv - shell) <= k)
        for h, v in close_pairs(homes[hs], visitors[vs], k, depth + 1):
            yield hs[h], vs[v]


def shard_forest(points: np.ndarray, home: np.ndarray, k: int) -> list[tuple[int, int]]:
    """A spanning forest over the points of one shard that are linked to one living there."""
    parent = np.arange(points.size)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = np.flatnonzero(home)
    forest = []
    for h, v in close_pairs(points[own], points, k):
        h = own[h]
        for i, j in zip(h[h != v].tolist(), v[h != v].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                forest.append((i, j))
    return forest


def _split_full(routed: DataFrame, tried: set[int], max_bits: int, shard_points: int, leaves: int) -> DataFrame | None:
    """``routed`` with a tree for every shard in which more than ``shard_points`` points live; None if there is none left to split."""
    sizes = routed.filter("home").groupBy("shard").count().filter(F.col("count") > shard_points)
    full = {r["shard"]: r["count"] for r in sizes.toLocalIterator() if r["shard"] not in tried}
    if not full:
        return None
    rank = F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(max(1, shard_points // PER_LEAF)))
    mine = routed.filter("home").filter(rank == 0)
    picked = mine.join(sizes.select("shard"), "shard", "left_semi").select("shard", "fp").toPandas()
    trees = {}
    for shard, points in picked.sort_values("fp").groupby("shard")["fp"]:
        if shard in full:
            trees[shard] = VantageTree(points.to_numpy(np.int64).view(np.uint64), min(leaves, 1 + full[shard] // shard_points))
    # A shard whose sample cannot be split stays as it is; its leaves get numbers of their own otherwise.
    trees = {shard: tree for shard, tree in trees.items() if tree.leaves > 1}
    tried |= full.keys() - trees.keys()
    if not trees:
        return None

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp, home = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp", "home"))
            for own in np.unique(shard).tolist():
                at = np.flatnonzero(shard == own)
                tree = trees.get(own)
                if tree is None:
                    columns = [pa.array(shard[at]), pa.array(fp[at]), pa.array(home[at])]
                else:
                    row, leaf, lives = tree.route(fp[at].view(np.uint64), max_bits, home[at])
                    columns = [pa.array(own * (leaves + 1) + 1 + leaf), pa.array(fp[at][row]), pa.array(lives)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "fp", "home"])

    return written(routed.mapInArrow(route, "shard long, fp long, home boolean"))


def fingerprint_links(points: DataFrame, fp: str = "_fp", max_bits: int = 2, shard_points: int = SHARD_POINTS, leaves: int = LEAVES) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``max_bits`` of each other.

    ``points`` holds distinct fingerprints. Which pairs are found does not depend on the trees.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["fp"].to_numpy(np.int64)
        found = shard_forest(values.view(np.uint64), pdf["home"].to_numpy(bool), max_bits)
        i = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": values[i[:, 0]], "b": values[i[:, 1]]})

    routed = points.select(F.lit(0).cast("long").alias("shard"), F.col(fp).cast("long").alias("fp"), F.lit(True).alias("home"))
    tried: set[int] = set()
    while (split := _split_full(routed, tried, max_bits, shard_points, leaves)) is not None:
        routed = split
    return routed.groupBy("shard").applyInPandas(search, "a long, b long")


def fingerprint_classes(prints: DataFrame, doc_id: str, fp: str = "_fp", max_bits: int = 2) -> DataFrame:
    """(fp, component_id): the smallest id reachable from each distinct fingerprint."""
    points = cut_lineage(prints.groupBy(fp).agg(F.min(F.col(f"`{doc_id}`")).alias("_least")))
    roots = cut_lineage(components(fingerprint_links(points, fp, max_bits)))
    grouped = points.join(roots.withColumnRenamed("node", fp), fp, "left").withColumn("root", F.coalesce("root", fp))
    # Only linked fingerprints need their component's smallest id.
    least = grouped.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("_least").alias("_all"))
    return grouped.join(least, "root", "left").select(fp, "root", F.coalesce("_all", "_least").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, _fp, component_id): one row per document."""
    prints = cut_lineage(with_fingerprints(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), text, shingle))
    return prints.join(fingerprint_classes(prints, doc_id, max_bits=max_bits).drop("root"), "_fp", "left")


def row_key(columns: list[str]) -> list[Column]:
    """128 bits of a whole row; nulls count."""
    parts = [F.col(f"`{c}`") for c in columns] + [F.col(f"`{c}`").isNull() for c in columns]
    return [F.xxhash64(F.lit(1), *parts).alias("_ka"), F.xxhash64(F.lit("row"), *parts).alias("_kb")]


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of every component: the smallest id, then the smallest row key; of repeated rows one.

    The decision is joined back by the key of the whole row, so ids may be null or repeated.
    """
    shield = Shielded(docs)
    docs, doc_id, text = shield.df, shield.of(doc_id), shield.of(text)
    key = row_key(docs.columns)
    prints = cut_lineage(with_fingerprints(docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`"), *key), text, shingle))
    rows = prints.groupBy("_ka", "_kb", "_fp", "_id").agg(F.count(F.lit(1)).alias("_n"))
    classes = fingerprint_classes(prints, "_id", max_bits=max_bits)
    placed = rows.join(classes.select("_fp", "root"), "_fp")
    order = F.struct(F.col("_id").isNull(), F.col("_id"), "_ka", "_kb")
    first = placed.groupBy("root").agg(F.min(order).alias("_first"))
    wins = (F.col("_first._ka") == F.col("_ka")) & (F.col("_first._kb") == F.col("_kb"))
    # Losers, and winners that are there more than once; all other rows stay as they are.
    marks = cut_lineage(placed.join(first, "root").select("_ka", "_kb", wins.alias("_wins"), "_n").filter(~F.col("_wins") | (F.col("_n") > 1)))
    keyed = docs.select("*", *key)
    kept = keyed.join(marks, ["_ka", "_kb"], "left_anti").drop("_ka", "_kb")
    again = marks.filter("_wins")
    if again.isEmpty():
        return shield.back(kept)
    once = keyed.join(again.select("_ka", "_kb"), ["_ka", "_kb"], "left_semi").dropDuplicates(["_ka", "_kb"]).drop("_ka", "_kb")
    return shield.back(kept.unionByName(once))
