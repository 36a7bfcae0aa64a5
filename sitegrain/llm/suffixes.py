"""Suffix-array dedup by a depth-limited radix sort: bytes covered by repeated 200-byte windows are removed.

Every suffix is ordered by its first ``depth`` bytes only, by most-significant-digit passes, and
leaves the sort as soon as its bucket holds no other suffix; suffixes that are still together
after all digits are exactly the repeated windows.

1. *Anchor digit.* The first digit of a window is its smallest ``GRAM``-byte string (by a fixed
   hash; the leftmost on ties). Equal windows have equal anchors at equal places, and neighbouring
   windows share theirs, so this digit is one row per run of suffixes, not per suffix. Runs whose
   anchor occurs once are done.
2. *Run digit.* Runs with the same anchor and the same bytes around it are repeated as a whole.
3. *Slice digit.* What is left are runs whose anchor is shared by runs with other bytes. Their
   suffixes are cut into ``SLICES`` slices by their distance to the anchor; all suffixes of a slice
   have most of their bytes in common, and slices whose common bytes occur once are done.
4. *Depth digit.* The other slices are the borders of repeated passages: their suffixes are told
   apart by all ``depth`` bytes.

Buckets are aggregates with partial sums and joins that Spark can split; no bucket is gathered in
one task. Texts are keyed by 128 hash bits of their bytes, so ids may be null or repeated, and
results are the same for equal texts.

Nulls: a null text is an empty one. Texts shorter than ``depth`` lose nothing. Repeated rows are
repeats of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import BYTE, mixed, written

DEPTH = 200
GRAM = 48
SLICES = 4
#: Bytes of one array computation; longer texts are handled in overlapping parts.
PART_BYTES = 1 << 20
_POSITION = np.uint64((1 << 22) - 1)
_BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Roller:
    """Hashes of any byte range of one array in constant time per range."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = data.size + 1
        if Roller._up.size < n:
            Roller._up, Roller._down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data] * Roller._up[: data.size])))

    def ranges(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[first]) * Roller._down[first])

    def all(self, length: int) -> np.ndarray:
        m = max(0, self.sums.size - length)
        return mixed((self.sums[length:] - self.sums[:m]) * Roller._down[:m])


def parts(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, part borders, row of each part, offset of each part in its text), about ``PART_BYTES`` at a time.

    Parts of one text overlap by ``depth`` - 1 bytes, so every window lies in exactly one part.
    """
    chunks, rows, bases, total = [], [], [], 0
    for row, text in enumerate(texts):
        for base in range(0, len(text) - depth + 1, PART_BYTES):
            chunk = text[base : base + PART_BYTES + depth - 1]
            chunks.append(chunk), rows.append(row), bases.append(base)
            total += len(chunk)
            if total >= PART_BYTES:
                yield _joined(chunks, rows, bases)
                chunks, rows, bases, total = [], [], [], 0
    if chunks:
        yield _joined(chunks, rows, bases)


def _joined(chunks, rows, bases):
    borders = np.concatenate(([0], np.cumsum([len(c) for c in chunks]))).astype(np.int64)
    return np.frombuffer(b"".join(chunks), np.uint8), borders, np.array(rows, np.int64), np.array(bases, np.int64)


def suffix_runs(data: np.ndarray, borders: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(part, first, last, anchor place, anchor hash, run hash): runs of windows that share an anchor. Places are in ``data``."""
    roll = Roller(data)
    grams = roll.all(GRAM)
    width = depth - GRAM + 1
    least = (grams & ~_POSITION) | np.arange(grams.size, dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = data.size - depth + 1
    least = np.minimum(least[:m], least[width - size : width - size + m])
    anchor = (least & _POSITION).astype(np.int64)
    at = np.arange(m)
    owner = np.searchsorted(borders, at, "right") - 1
    valid = at + depth <= borders[owner + 1]
    at, anchor, owner = at[valid], anchor[valid], owner[valid]
    new = np.ones(at.size, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    first, last, place = at[begin], at[np.append(begin[1:], at.size) - 1], anchor[begin]
    run = mixed(roll.ranges(first, last + depth) + ((place - first) * 1024 + (last - first)).astype(np.uint64), 5)
    return owner[begin], first, last, place, grams[place], run


_RUNS = "ta long, tb long, first int, last int, place int, k long, h long"


def _emit_runs(depth: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ta", "tb"))
            for data, borders, rows, bases in parts([t or b"" for t in b.column("text").to_pylist()], depth):
                part, first, last, place, k, h = suffix_runs(data, borders, depth)
                shift = bases[part] - borders[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ta[rows[part]]), pa.array(tb[rows[part]]), pa.array((first + shift).astype(np.int32)),
                     pa.array((last + shift).astype(np.int32)), pa.array((place + shift).astype(np.int32)),
                     pa.array(k.view(np.int64)), pa.array(h.view(np.int64))],
                    names=["ta", "tb", "first", "last", "place", "k", "h"],
                )

    return emit


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint, non-touching spans that cover the same bytes."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    begins = np.flatnonzero(np.append(first.size > 0, first[1:] > reach[:-1])) if first.size else np.zeros(0, np.int64)
    ends = np.append(begins[1:], first.size)[: begins.size] - 1
    return list(zip(first[begins].tolist(), reach[ends].tolist()))


def _lists(column: pa.ListArray, *fields: str) -> Iterator[list[np.ndarray]]:
    """The named fields of each row's list of structs as arrays; a null list is empty."""
    values = [column.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in fields]
    offsets, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i, ok in enumerate(there):
        x, y = (offsets[i], offsets[i + 1]) if ok else (0, 0)
        yield [v[x:y] for v in values]


def digest(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """(bytes, removed, spans, SHA-256 of the rest)."""
    rest, at = hashlib.sha256(), 0
    for a, b in spans:
        rest.update(text[at:a])
        at = b
    rest.update(text[at:])
    return len(text), sum(b - a for a, b in spans), len(spans), rest.hexdigest()


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its spans."""
    ends = [0] + [b for _, b in spans]
    return b"".join(text[a:b] for a, b in zip(ends, [a for a, _ in spans] + [len(text)]))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), raw.alias("text"), F.xxhash64(raw).alias("ta"), F.xxhash64(F.lit("t"), raw).alias("tb")
    )


def run_digits(keyed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(ta, tb, first, last, place, whole, split): runs left after the first two digits.

    ``whole``: every window of the run is repeated. ``split``: the run has to be told apart from
    others with its anchor by further digits. Runs of equal texts come once per copy.
    """
    runs = keyed.filter(F.octet_length("text") >= depth).select("ta", "tb", "text").mapInArrow(_emit_runs(depth), _RUNS)
    often = runs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    left = written(runs.join(often, "k"))
    me = F.xxhash64("ta", "tb", "first")
    alike = written(left.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("one")))
    kinds = alike.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    judged = alike.filter("n > 1").join(kinds, "k", "left").unionByName(alike.filter("n = 1").join(kinds, "k"))
    return left.join(judged, ["k", "h"]).select(
        "ta", "tb", "first", "last", "place", (F.col("n") > 1).alias("whole"), (F.col("kinds").isNotNull() & (me == F.col("one"))).alias("split")
    )


def _part_of(text: bytes, low: int, depth: int) -> Roller:
    """The bytes that runs beginning in one part of a text can reach."""
    return Roller(np.frombuffer(text[low : low + PART_BYTES + 2 * depth], np.uint8))


def _emit_slices(depth: int):
    """(ta, tb, low, high, w) per slice: its first and last suffix and the hash of the bytes that all its suffixes share."""
    step = -(-(depth - GRAM + 1) // SLICES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ta", "tb"))
            row, low, high, w = [], [], [], []
            for i, (t, (first, last, place)) in enumerate(zip(b.column("text").to_pylist(), _lists(b.column("more"), "first", "last", "place"))):
                for base in np.unique(first // PART_BYTES * PART_BYTES).tolist():
                    roll, own = _part_of(t, base, depth), first // PART_BYTES * PART_BYTES == base
                    f, l, p = first[own], last[own], place[own]
                    for j in range(SLICES):
                        near, far = step * j, min(step * (j + 1) - 1, depth - GRAM)
                        x, y = np.maximum(f, p - far), np.minimum(l, p - near)
                        ok = x <= y
                        row.append(np.full(int(ok.sum()), i)), low.append(x[ok]), high.append(y[ok])
                        w.append(mixed(roll.ranges(p[ok] - near - base, p[ok] - far + depth - base), 7 + j))
            if row:
                at = np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ta[at]), pa.array(tb[at]), pa.array(np.concatenate(low).astype(np.int32)),
                     pa.array(np.concatenate(high).astype(np.int32)), pa.array(np.concatenate(w).view(np.int64))],
                    names=["ta", "tb", "low", "high", "w"],
                )

    return emit


def _emit_suffixes(depth: int):
    """(ta, tb, at, w) per suffix of the open slices: its place and the hash of its first ``depth`` bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ta", "tb"))
            for i, (t, (low, high)) in enumerate(zip(b.column("text").to_pylist(), _lists(b.column("more"), "low", "high"))):
                at = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(low.tolist(), high.tolist())]))
                for base in np.unique(at // PART_BYTES * PART_BYTES).tolist():
                    own = at[at // PART_BYTES * PART_BYTES == base]
                    w = _part_of(t, base, depth).ranges(own - base, own - base + depth)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(own.size, ta[i])), pa.array(np.full(own.size, tb[i])), pa.array(own.astype(np.int32)),
                         pa.array(w.view(np.int64))], names=["ta", "tb", "at", "w"],
                    )

    return emit


def _shared(rows: DataFrame, place: str) -> DataFrame:
    """The rows whose ``w`` occurs at two different places. Copies of a text are one place."""
    me = F.xxhash64("ta", "tb", place)
    often = rows.groupBy("w").agg(F.min(me).alias("a"), F.max(me).alias("b")).filter("a <> b").select("w")
    return rows.join(often, "w")


_OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the texts without open parts (``more``); the others are kept for the next digit."""
    for b in batches:
        more, spans, texts = b.column("more"), b.column("spans"), b.column("text")
        open_ = pc.greater(pc.fill_null(pc.list_value_length(more), 0), 0)
        rows = [
            (None,) * 4 if o else digest(t.as_py(), merged(first, end))
            for o, t, (first, end) in zip(open_.to_pylist(), texts, _lists(spans, "first", "end"))
        ]
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        kept = [pc.if_else(open_, c, pa.scalar(None, c.type)) for c in (texts, spans, more)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("ta"), b.column("tb"), *counts, pa.array([r[3] for r in rows], pa.string()), *kept],
            names=["doc_id", "ta", "tb", *_OUT[1:], "text", "spans", "more"],
        )


def _looked(texts: DataFrame, more: str) -> DataFrame:
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, ta long, tb long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, "
        f"spans array<struct<first:int,end:int>>, more array<struct<{more}>>"
    )
    return texts.select("doc_id", "ta", "tb", "text", "spans", "more").mapInArrow(_look, schema)


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per document."""
    keyed = _keyed(docs, doc_id, text)
    span = lambda first, end: F.struct(first.alias("first"), end.alias("end"))
    fields = [F.col(c) for c in ("first", "last", "place", "whole", "split")]
    per_text = run_digits(keyed, depth).groupBy("ta", "tb").agg(F.collect_set(F.struct(*fields)).alias("runs"))
    none = F.array().cast("array<struct<first:int,end:int>>")
    whole = F.transform(F.filter("runs", lambda r: r["whole"]), lambda r: span(r["first"], r["last"] + depth))
    split = F.transform(
        F.filter("runs", lambda r: r["split"]), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), r["place"].alias("place"))
    )
    texts = keyed.join(per_text, ["ta", "tb"], "left").withColumns({"spans": F.coalesce(whole, none), "more": split})
    seen = written(_looked(texts, "first:int,last:int,place:int"))
    pending = seen.filter(F.col("text").isNotNull())

    slices = _shared(pending.select("ta", "tb", "text", "more").mapInArrow(_emit_slices(depth), "ta long, tb long, low int, high int, w long"), "low")
    open_ = slices.groupBy("ta", "tb").agg(F.collect_set(F.struct("low", "high")).alias("more"))
    sliced = written(_looked(pending.drop("more").join(open_, ["ta", "tb"], "left"), "low:int,high:int"))
    pending = sliced.filter(F.col("text").isNotNull())

    suffixes = _shared(pending.select("ta", "tb", "text", "more").mapInArrow(_emit_suffixes(depth), "ta long, tb long, at int, w long"), "at")
    found = suffixes.groupBy("ta", "tb").agg(F.collect_set("at").alias("at"))
    more = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda x: span(x, x + depth))
    ended = pending.join(found, ["ta", "tb"], "left").withColumns(
        {"spans": F.concat("spans", more), "more": F.lit(None).cast("array<struct<low:int,high:int>>")}
    )
    done = seen.filter(F.col("text").isNull()).select(*_OUT).unionByName(sliced.filter(F.col("text").isNull()).select(*_OUT))
    return done.unionByName(_looked(ended, "low:int,high:int").select(*_OUT))
