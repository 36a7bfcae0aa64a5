"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some word positions out of a window and ignore the others, so a seed still
matches when an ignored word was replaced. The seed hashes of the test items and of the training
texts meet in a Spark join; every (text, item) pair with an equal seed is then compared word by
word along the diagonals of its seeds. A stretch scores +1 for an equal word and -4 for a replaced
one, so at least four of five words are equal, and must have ``min_words`` equal words. All such
stretches are returned; of two that overlap in the text, the one with more equal words, then the
first, then the shorter.

Before the join a bit table of all item seeds, of at most ``2 ** MAX_BITS`` bits, sorts out almost
all training seeds inside the scan, so what is shuffled grows with the overlaps, not with the
corpus. A larger benchmark fills the table and more seeds reach the join; results stay the same.
Equal texts and equal items are one each until the last join; keys are dealt to ``SPLIT`` tasks,
and one task compares a text with at most about ``GROUP`` items at a time. Hits are held as one flag per diagonal.

Nulls: null texts and items have no words; null ids are carried. Items or texts with fewer than
``min_words`` words match nothing. Repeated rows are judged each. Very long texts are compared
whole. An empty table on either side gives no overlaps. Ids may be of any type and extra columns
have any names. A-Z count as a-z.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import Shielded, blocks, mixed, table_of, word_hashes, word_spans, written

#: Kept positions of each mask; the gaps are ignored.
MASKS = ((0, 1, 2, 4, 6), (0, 1, 3, 5, 6, 7), (0, 2, 3, 4, 7, 8))
MIN_WORDS = 10
MISMATCH = 4
MAX_BITS = 27
SPLIT = 8
GROUP = 1_000


def seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The mask's hash at every position that has room for it."""
    m = words.size - mask[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for offset, k in zip(mask, table_of(len(mask), 11)):
        total += words[offset : offset + m] * k
    return mixed(total, number + 1)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal words) of the stretch with the highest score, the longest one that ends first."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISMATCH))))
    lowest = np.minimum.accumulate(sums)
    end = int(np.argmax(sums[1:] - lowest[:-1])) + 1
    start = int(np.argmin(sums[:end]))
    return start, end - start, int(equal[start:end].sum())


def stretches(equal: np.ndarray, min_words: int) -> Iterator[tuple[int, int, int]]:
    """The best stretch, then those of what lies before and behind it, as far as they have ``min_words`` equal words."""
    open_ = [(0, equal.size)]
    while open_:
        low, high = open_.pop()
        if high - low < min_words or int(equal[low:high].sum()) < min_words:
            continue
        start, length, n = best_stretch(equal[low:high])
        if n >= min_words:
            yield low + start, length, n
            open_ += [(low, low + start), (low + start + length, high)]


class Text:
    """One text's words and its seeds in order of their hashes."""

    def __init__(self, words: np.ndarray):
        self.words, self.sorted = words, []
        for number, mask in enumerate(MASKS):
            keys = seeds(words, mask, number)
            order = np.argsort(keys, kind="stable")
            self.sorted.append((keys[order], order))

    def diagonals(self, item: np.ndarray) -> np.ndarray:
        """All (text position - item position) at which a seed is equal. One flag per diagonal, however many seeds hit it."""
        hit = np.zeros(self.words.size + item.size, dtype=bool)
        for number, (mask, (keys, order)) in enumerate(zip(MASKS, self.sorted)):
            own = seeds(item, mask, number)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for j in np.flatnonzero(high > low).tolist():
                hit[order[low[j] : high[j]] - j + item.size] = True
        return np.flatnonzero(hit) - item.size

    def overlaps(self, item: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
        """(start, words, equal words) of the stretches shared with ``item``; no two overlap in the text."""
        found = []
        for d in self.diagonals(item).tolist():
            a, b = max(0, -d), min(item.size, self.words.size - d)
            if b - a >= min_words:
                for start, length, n in stretches(item[a:b] == self.words[a + d : b + d], min_words):
                    found.append((-n, a + d + start, length))
        taken: list[tuple[int, int]] = []
        out = []
        for n, start, length in sorted(found):
            at = bisect_left(taken, (start, 0))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= start + length):
                insort(taken, (start, start + length))
                out.append((start, length, -n))
        return sorted(out)


def _hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, data.size]))
    return word_hashes(data, starts, ends)


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with (ta, tb, text): 128 hash bits of the text's bytes, and the bytes. Rows without a text go."""
    raw = F.col(f"`{text}`").cast("binary")
    own = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.filter(raw.isNotNull()).select(*own, F.xxhash64(raw).alias("ta"), F.xxhash64(F.lit("t"), raw).alias("tb"), raw.alias("text"))


def _emit_seeds(min_words: int, seen: np.ndarray | None = None, bits: int = 0):
    """(ta, tb, k) for the different seeds of every text of ``min_words`` words; those in the bit table only, if there is one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ta", "tb"))
            for first, _, data, offsets in blocks(b, "text"):
                starts, ends, owner = word_spans(data, offsets)
                words = word_hashes(data, starts, ends)
                long = np.bincount(owner, minlength=offsets.size - 1) >= min_words
                texts, keys = [], []
                for number, mask in enumerate(MASKS):
                    k = seeds(words, mask, number)
                    if not k.size:
                        continue
                    ok = (owner[: k.size] == owner[mask[-1] :]) & long[owner[: k.size]]
                    if seen is not None:
                        slot = k >> np.uint64(64 - bits)
                        ok &= (seen[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                    texts.append(owner[: k.size][ok]), keys.append(k[ok])
                if texts:
                    t, k = np.concatenate(texts), np.concatenate(keys)
                    order = np.lexsort((k, t))
                    t, k = t[order], k[order]
                    new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))[: t.size]
                    at = t[new] + first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ta[at]), pa.array(tb[at]), pa.array(k[new].view(np.int64))], names=["ta", "tb", "k"]
                    )

    return emit


_SEEDS = "ta long, tb long, k long"


def _bit_table(item_seeds: DataFrame) -> tuple[np.ndarray, int]:
    """(words of 64 bits, log2 of the bits) of a table of the seeds' first bits, about 256 bits a seed and ``MAX_BITS`` at most."""
    n = item_seeds.count()
    bits = min(MAX_BITS, max(16, (256 * n).bit_length()))
    slot = F.shiftrightunsigned("k", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    rows = item_seeds.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(one).alias("w")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["at"].to_numpy(np.int64)] = rows["w"].to_numpy(np.int64)
    return table.view(np.uint64), bits


def _compare(min_words: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ta, tb, text, items in zip(*(b.column(c) for c in ("ta", "tb", "text", "items"))):
                whole, rows = Text(_hashes(text.as_py())), []
                for item in items.values:
                    ia, ib, words = (item[c].as_py() for c in ("ia", "ib", "text"))
                    rows += [(ta.as_py(), tb.as_py(), ia, ib, *o) for o in whole.overlaps(_hashes(words), min_words)]
                if rows:
                    kinds = [pa.int64()] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=_LINK)

    return compare


_LINK = ["ta", "tb", "ia", "ib", "start", "words", "equal"]


def text_overlaps(texts: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(ta, tb, ia, ib, start, words, equal) over the different texts and items, both keyed by ``_keyed``."""
    narrow = ["ta", "tb", "text"]
    items = written(items.groupBy("ta", "tb").agg(F.min("text").alias("text")))
    item_seeds = written(items.select(*narrow).mapInArrow(_emit_seeds(min_words), _SEEDS))
    seen, bits = _bit_table(item_seeds)
    salt: Column = F.pmod(F.xxhash64("ta", "tb"), F.lit(SPLIT)).cast("int")
    hits = texts.select(*narrow).mapInArrow(_emit_seeds(min_words, seen, bits), _SEEDS).distinct().withColumn("salt", salt)
    theirs = item_seeds.select("k", F.col("ta").alias("ia"), F.col("tb").alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("salt"))
    pairs = written(hits.join(theirs, ["k", "salt"]).select("ta", "tb", "ia", "ib").distinct())
    size = pairs.groupBy("ta", "tb").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    named = items.select(F.col("ta").alias("ia"), F.col("tb").alias("ib"), "text")
    grouped = (
        pairs.join(size, ["ta", "tb"])
        .join(named, ["ia", "ib"])
        .groupBy("ta", "tb", F.pmod(F.xxhash64("ia", "ib"), F.col("groups")).alias("part"))
        .agg(F.collect_list(F.struct("ia", "ib", "text")).alias("items"))
    )
    held = texts.select(*narrow).join(size.select("ta", "tb"), ["ta", "tb"], "left_semi").groupBy("ta", "tb").agg(F.min("text").alias("text"))
    kinds = ", ".join(f"{c} long" for c in _LINK)
    return written(held.join(grouped, ["ta", "tb"]).select("ta", "tb", "text", "items").mapInArrow(_compare(min_words), kinds))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                 item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, start, words, equal): every overlap of every document with every item."""
    mine = _keyed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    theirs = _keyed(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")), "text")
    links = text_overlaps(mine, theirs, min_words)
    names = theirs.select("item_id", F.col("ta").alias("ia"), F.col("tb").alias("ib"))
    return mine.drop("text").join(links, ["ta", "tb"]).join(names, ["ia", "ib"]).select("doc_id", "item_id", "start", "words", "equal")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that overlap no item, in their own columns."""
    shield = Shielded(docs)
    own = F.coalesce(F.col(shield.of(text)), F.lit("")).cast("binary")
    mine = _keyed(shield.df.select(F.col(shield.of(text)).alias("text")), "text")
    bad = text_overlaps(mine, _keyed(items.select(F.col(f"`{item_text}`").alias("text")), "text"), min_words).select("ta", "tb").distinct()
    marked = shield.df.withColumns({"ta": F.xxhash64(own), "tb": F.xxhash64(F.lit("t"), own)})
    return shield.back(marked.join(bad, ["ta", "tb"], "left_anti").drop("ta", "tb"))
