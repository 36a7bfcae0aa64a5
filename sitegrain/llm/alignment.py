"""Cross-tokenizer alignment counts through minimal perfect hashing of distinct token pairs.

Two tokenizers cut the same bytes. Offsets where tokens of both end cut a text into groups, and
every token of the one is linked with every token of the other in its group. The count of an id
pair is the number of documents that hold it linked.

1. Every document is aligned once. Its numbers are a row, and its links are kept beside it as byte
   strings of a bounded number of links.
2. Each task over the links hands on the distinct pairs of its part with the number of its
   documents that hold them. The distinct pairs are dealt into slices of bounded size. Each slice gets a minimal perfect
   hash: levels of bits, a pair sits on the first level where it collides with no other, and its
   slot is the number of set bits before it. The pairs are kept in slot order, so every look-up
   is verified.
3. The partial counts of a few tasks become one dense vector per slice, indexed by the hash;
   vectors are summed up a tree with a fixed fan-in.
4. The second pass over the links deals them by slice. Bounded groups of links meet their slice,
   look up its counts and return sums per document.

Nothing is collected but the highest count per id of the first tokenizer, one number per entry of
its vocabulary. A pair in a third of all documents is one row per task; a document copied often is
dealt by row, not by value. Texts are cut into segments where both tokenizers end a token anyway;
each distinct segment is aligned once per task while it is remembered.

Nulls: null and empty texts, and texts that one tokenizer does not give back byte for byte, have
no tokens and get zeros; a null id is carried. Repeated rows count as documents of their own. Ties
for the highest count all count as best. Texts of any length are aligned whole, in bounded steps.
An empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.bpe import STEP_CHARS, ArrayMerger, segments, steps
from sitegrain.llm.common import mixed, written

#: Bytes of texts that are aligned together; a longer text makes a group of its own.
GROUP_BYTES = 2 << 20
#: Segments, characters of them and links of them that a task remembers before it starts afresh.
REMEMBERED, REMEMBERED_CHARS, REMEMBERED_LINKS = 400_000, 8 << 20, 4 << 20
#: Links of one kept byte string.
STORED_LINKS = 1 << 16
#: Distinct pairs that a task of the first pass holds before it hands them on.
HELD_PAIRS = 1 << 20
#: Pairs are filed under so many fixed buckets; a slice is a run of buckets.
BUCKET_BITS = 12
#: About so many pairs make a slice.
SLICE_PAIRS = 1 << 17
#: Vectors that one task of the tree adds up.
FAN_IN = 16
#: About so many links of documents are looked up together.
LOOKUP_LINKS = 1 << 20
#: Pairs of a step when groups are multiplied out.
STEP_LINKS = 4 << 20
SPACE = "▁"


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64), 7) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: about three bits a key, checked against the keys by its user."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before: list[np.ndarray] = []
        total = 0
        for bits in levels:
            sums = np.cumsum(bits, dtype=np.int64)
            self.before.append(sums + (total - 1))
            total = int(sums[-1] + total) if bits.size else total
        self.size = total

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        rest, levels = keys.astype(np.uint64), []
        while rest.size:
            width = max(64, 2 * rest.size)
            at = mixed(rest, 100 + len(levels)) % np.uint64(width)
            alone = np.bincount(at.astype(np.int64), minlength=width) == 1
            levels.append(alone)
            rest = rest[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that the hash was not built of."""
        out = np.full(keys.size, -1, np.int64)
        rest, who = keys.astype(np.uint64), np.arange(keys.size)
        for n, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = (mixed(rest, 100 + n) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at]
            out[who[hit]] = before[at[hit]]
            rest, who = rest[~hit], who[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *[b.size for b in self.levels]], "<i8").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        widths, at, levels = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * n, []
        for w in widths.tolist():
            size = (w + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=w).astype(bool))
            at += size
        return cls(levels)


class Aligner:
    """Groups and links of texts under a byte-level vocabulary (A) and a piece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = ArrayMerger(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{path_b}: a piece goes on after a word's end, so texts cannot be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a.token_bytes, self.b_bytes))
        self.b_flat = Ragged.of(self.b_bytes)
        # Every id as text with the sign that follows it, for A before A, A before B, B before B, B at the end of a group.
        self.signed = [Ragged.of([f"{i}{sign}".encode() for i in range(max(n, self.a.width))]) for sign in ",|,;"]
        self.blank = self.b.piece_to_id(SPACE)
        self.width = n
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.shown, self.shown_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.numbers = np.zeros((0, 5), np.int64)  # valid, n_a, n_b, n_groups, n_links of each segment
        self.begins = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cut_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Every part starts with the space that the model itself puts in front of a text."""
        cut = self.b.encode([p[1:] for p in parts], num_threads=1)
        cut = [own if len(p) > 1 else [self.blank] for own, p in zip(cut, parts)]
        sizes = np.array([len(own) for own in cut], np.int64)
        return np.fromiter(chain.from_iterable(cut), np.int64, int(sizes.sum())), sizes

    def learn(self, parts: list[str]) -> None:
        a, a_n = self.a.tokenize(parts)
        b, b_n = self._cut_b(parts)
        # The bytes of A are those of the text by construction; those of B are compared.
        raw = [p.encode() for p in parts]
        size = np.array([len(r) for r in raw], np.int64)
        b_of = np.repeat(np.arange(len(parts)), b_n)
        valid = np.bincount(b_of, weights=self.b_size[b], minlength=len(parts)).astype(np.int64) == size
        given = np.frombuffer(b"".join(r for r, v in zip(raw, valid.tolist()) if v), np.uint8)
        wrong = np.flatnonzero(self.b_flat.take(b[valid[b_of]]) != given)
        valid[np.flatnonzero(valid)[np.searchsorted(np.cumsum(size[valid]), wrong, "right")]] = False
        # Only valid segments are aligned: there both token rows cover the same bytes.
        a_of, b_of = np.repeat(np.arange(len(parts)), a_n), np.repeat(np.arange(len(parts)), b_n)
        a_on, b_on = valid[a_of], valid[b_of]
        a, b, a_of, b_of = a[a_on], b[b_on], a_of[a_on], b_of[b_on]
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        a_in, b_in = np.bincount(a_group, minlength=shared.size), np.bincount(b_group, minlength=shared.size)
        group_of = a_of[np.cumsum(a_in) - 1] if shared.size else np.zeros(0, np.int64)
        n = len(parts)
        numbers = np.stack([
            valid.astype(np.int64), np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n),
            np.bincount(group_of, minlength=n), np.bincount(group_of, weights=a_in * b_in, minlength=n).astype(np.int64),
        ], axis=1)
        owner, pairs, times = self._links(a, a_group, b, b_group, group_of)
        self._show(n, a, a_group, b, b_group, group_of)
        first = len(self.known)
        self.known.update(zip(parts, range(first, first + n)))
        self.chars += sum(map(len, parts))
        self.numbers = np.concatenate((self.numbers, numbers))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(np.bincount(owner, minlength=n))))
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))

    def _links(self, a, a_group, b, b_group, group_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, pair, times) of all links, each pair once a segment, by segment."""
        wide = max(self.width, self.a.width)
        (a_key, a_times), (b_key, b_times) = (_counted(g * wide + x) for x, g in ((a, a_group), (b, b_group)))
        a_n, b_n = np.bincount(a_key // wide, minlength=group_of.size), np.bincount(b_key // wide, minlength=group_of.size)
        a_first, b_first = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
        done = np.concatenate(([0], np.cumsum(a_n * b_n)))
        out: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < group_of.size:
            end = max(at + 1, int(np.searchsorted(done, done[at] + STEP_LINKS, "right")) - 1)
            sizes = np.diff(done[at : end + 1])
            group = np.repeat(np.arange(at, end), sizes)
            k = np.arange(group.size) - np.repeat(done[at:end] - done[at], sizes)
            x, y = a_first[group] + k // b_n[group], b_first[group] + k % b_n[group]
            pair = (a_key[x] % wide) * self.width + b_key[y] % wide
            out.append(_summed(group_of[group], pair, a_times[x] * b_times[y]))
            at = end
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return _summed(*(np.concatenate(x) for x in zip(*out))) if len(out) > 1 else out[0]

    def _show(self, n: int, a, a_group, b, b_group, group_of) -> None:
        """The groups of each segment as text, ``a1,a2|b1;...``, with a sign after the last one too."""
        a_kind, b_kind = (np.append(g[1:] != g[:-1], True) if g.size else g.astype(bool) for g in (a_group, b_group))
        kind = np.concatenate((a_kind.astype(np.int64), 2 + b_kind.astype(np.int64)))
        ids, group = np.concatenate((a, b)), np.concatenate((a_group, b_group))
        order = np.argsort(group * 2 + (kind > 1), kind="stable")
        ids, kind, group = ids[order], kind[order], group[order]
        sizes = np.zeros(ids.size, np.int64)
        for k, table in enumerate(self.signed):
            sizes[kind == k] = table.sizes(ids[kind == k])
        ends = np.cumsum(sizes)
        out = np.zeros(int(sizes.sum()), np.uint8)
        for k, table in enumerate(self.signed):
            own = kind == k
            out[_spans(ends[own] - sizes[own], sizes[own])] = table.take(ids[own])
        lengths = np.bincount(group_of[group], weights=sizes, minlength=n).astype(np.int64)
        self.shown_at = np.concatenate((self.shown_at, self.shown_at[-1] + np.cumsum(lengths)))
        self.shown = np.concatenate((self.shown, out))

    def codes(self, parts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS or self.pairs.size > REMEMBERED_LINKS:
            self.clear()
        out = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            unknown = [parts[i] for i in missing]
            self.learn(list(set(unknown)))
            out[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        return out

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(numbers per text, digest per text, text number, pair, times): the links by text and pair, each once a text."""
        n = len(texts)
        numbers = np.zeros((n, 4), np.int64)
        valid = np.array([bool(t) for t in texts], dtype=bool)
        digests = [hashlib.sha256() for _ in texts]
        begun = [False] * n
        links: list[tuple[np.ndarray, ...]] = []
        waiting: list[tuple[int, list[str]]] = []

        def settle() -> None:
            if not waiting:
                return
            who, sizes = np.array([i for i, _ in waiting], np.int64), np.array([len(own) for _, own in waiting], np.int64)
            flat = self.codes(list(chain.from_iterable(own for _, own in waiting)))
            codes = np.split(flat, np.cumsum(sizes)[:-1])
            found = np.add.reduceat(self.numbers[flat], np.cumsum(sizes) - sizes, axis=0)
            np.logical_and.at(valid, who, found[:, 0] == sizes)
            np.add.at(numbers, who, found[:, 1:])
            who = np.repeat(who, sizes)
            for (i, _), own in zip(waiting, codes):
                first = self.shown_at[own]
                shown = self.shown[_spans(first, self.shown_at[own + 1] - first)]
                digests[i].update((b";" if begun[i] else b"") + shown[:-1].tobytes())
                begun[i] = True
            sizes = self.begins[flat + 1] - self.begins[flat]
            take = _spans(self.begins[flat], sizes)
            links.append(_summed(np.repeat(who, sizes), self.pairs[take], self.times[take]))
            waiting.clear()

        size = 0
        for i, raw in enumerate(texts):
            for part in steps(" " + raw.decode("utf-8", "replace")) if raw else ():
                waiting.append((i, segments(part)))
                size += len(part)
                if size >= STEP_CHARS:
                    settle()
                    size = 0
        settle()
        none = np.zeros(0, np.int64)
        owner, pairs, times = _summed(*(np.concatenate(x) for x in zip(*links))) if len(links) > 1 else links[0] if links else (none,) * 3
        numbers[~valid] = 0
        on = valid[owner]
        return numbers, [d.hexdigest() if v else "" for d, v in zip(digests, valid)], owner[on], pairs[on], times[on]


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``first``, ``first + 1`` and so on of every span in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(int(ends[-1]) if ends.size else 0)


class Ragged:
    """Byte strings by number in one array."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    @classmethod
    def of(cls, strings: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)]))

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.at[numbers + 1] - self.at[numbers]

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[_spans(self.at[numbers], self.sizes(numbers))]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often each occurs), sorted."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, keys.size))


def _summed(owner: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``times`` added up per owner and pair, sorted by both."""
    if not owner.size:
        return owner, pairs, times
    wide = int(pairs.max()) + 1
    if int(owner.max()) < (1 << 62) // wide:
        key = owner * wide + pairs
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(new)
        return key[at] // wide, key[at] % wide, np.add.reduceat(times[order], at)
    order = np.lexsort((pairs, owner))
    owner, pairs, times = owner[order], pairs[order], times[order]
    at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])))
    return owner[at], pairs[at], np.add.reduceat(times, at)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner, kept from one task to the next within its bounds."""
    return Aligner(path_a, path_b)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of whole rows with about ``GROUP_BYTES`` bytes."""
    own: list[bytes] = []
    first = size = 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        own.append(t or b"")
        size += len(own[-1])
        if size >= GROUP_BYTES:
            yield first, own
            own, first, size = [], i + 1, 0
    if own:
        yield first, own


def pair_counts(rows: DataFrame) -> DataFrame:
    """First pass over ``links``: (part, bucket, pair, docs), the distinct pairs of each task with its number of documents."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            pairs, times = (np.concatenate(x) for x in zip(*held))
            _, pairs, times = _summed(np.zeros(pairs.size, np.int64), pairs, times)
            return pairs, times

        def handed(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            columns = [np.full(pairs.size, part, np.int64), bucket_of(pairs), pairs, times]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "bucket", "pair", "docs"])

        waiting: list[np.ndarray] = []
        for raw in chain.from_iterable(b.column("links").to_pylist() for b in batches):
            # A pair stands once for each document that holds it.
            waiting.append(unpacked(raw)[1])
            if sum(w.size for w in waiting) < LOOKUP_LINKS:
                continue
            held.append(_counted(np.concatenate(waiting)))
            waiting = []
            if len(held) > 4:
                held = [joined()]
                if held[0][0].size > HELD_PAIRS:
                    yield handed(*held[0])
                    held = []
        if waiting:
            held.append(_counted(np.concatenate(waiting)))
        if held:
            yield handed(*joined())

    return rows.select("links").mapInArrow(gather, "part long, bucket long, pair long, docs long")


def perfect_hashes(pairs: DataFrame, slices: int) -> DataFrame:
    """(slice, hash, pairs): one minimal perfect hash per slice of ``pairs``, and its pairs in slot order."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["pair"].to_numpy()
        made = PerfectHash.of(own)
        ordered = np.empty_like(own)
        ordered[made.slots(own)] = own
        return pd.DataFrame({"slice": [key[0]], "hash": [made.to_bytes()], "pairs": [ordered.tobytes()]})

    dealt = pairs.select(_slice(slices), "pair")
    return dealt.groupBy("slice").applyInPandas(build, "slice long, hash binary, pairs binary")


def _slice(slices: int):
    return F.expr(f"bucket * {slices} div {1 << BUCKET_BITS}").cast("long").alias("slice")


class Table:
    """One slice: its hash, its pairs in slot order and, once summed, their counts."""

    def __init__(self, row):
        self.hash = PerfectHash.from_bytes(row["hash"])
        self.pairs = np.frombuffer(row["pairs"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64) if "counts" in row else None

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        at = self.hash.slots(pairs)
        if (at < 0).any() or (self.pairs[at] != pairs).any():
            raise ValueError("a pair that the first pass did not see: the documents changed between the passes")
        return at


def count_vectors(partial: DataFrame, hashes: DataFrame, slices: int, parts: int) -> DataFrame:
    """(slice, counts): dense vectors in slot order, from the partial counts of a few tasks each, summed up a tree."""

    def dense(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        own = Table(table.iloc[0])
        out = np.zeros(own.pairs.size, np.int64)
        np.add.at(out, own.slots(rows["pair"].to_numpy()), rows["docs"].to_numpy())
        return pd.DataFrame({"slice": [key[0]], "branch": [key[1]], "counts": [out.tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["counts"].iloc[0], np.int64).copy()
        for raw in pdf["counts"].iloc[1:]:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"slice": [key[0]], "branch": [key[1]], "counts": [total.tobytes()]})

    branches = -(-parts // FAN_IN)
    kind = "slice long, branch long, counts binary"
    rows = partial.select(_slice(slices), F.expr(f"part div {FAN_IN}").alias("branch"), "pair", "docs")
    tables = hashes.withColumn("branch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))))
    vectors = rows.groupBy("slice", "branch").cogroup(tables.groupBy("slice", "branch"))
    # Slots without a row in a branch are zeros, a branch without rows adds nothing.
    vectors = vectors.applyInPandas(lambda k, r, t: dense(k, r, t) if len(t) and len(r) else pd.DataFrame(columns=["slice", "branch", "counts"]), kind)
    while branches > 1:
        branches = -(-branches // FAN_IN)
        vectors = vectors.withColumn("branch", F.expr(f"branch div {FAN_IN}")).groupBy("slice", "branch").applyInPandas(add, kind)
    return vectors.select("slice", "counts")


def _best(tables: DataFrame, width: int) -> dict[int, int]:
    """The highest count per id of the first tokenizer: one number per entry of its vocabulary at most."""

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pairs, counts in zip(pdf["pairs"], pdf["counts"]):
                own = pd.Series(np.frombuffer(counts, np.int64)).groupby(np.frombuffer(pairs, np.int64) // width).max()
                yield pd.DataFrame({"a": own.index.to_numpy(), "most": own.to_numpy()})

    found = tables.mapInPandas(highest, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))
    return {r.a: r.most for r in found.collect()}


def packed(base: int, owner: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Links of one group of documents: the number of its first row, then rows after it, pairs and times."""
    return b"".join((np.int64(base).tobytes(), pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes(), owner.astype("<i4").tobytes()))


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = (len(raw) - 8) // 20
    base, pairs, times = (np.frombuffer(raw, "<i8", m, k) for m, k in ((1, 0), (n, 8), (n, 8 + 8 * n)))
    return np.frombuffer(raw, "<i4", n, 8 + 16 * n) + base, pairs, times


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def document_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document (links null), and rows with the links of bounded runs of documents, each pair once a document."""
    kind = docs.schema["doc_id"].dataType
    schema = f"row long, doc_id {kind.simpleString()}, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string, links binary"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = aligner(path_a, path_b), TaskContext.get().partitionId()
        names = ["row", "doc_id", *_NUMBERS, "groups_sha256", "links"]
        row = 0
        for b in batches:
            ids = b.column("doc_id")
            for first, texts in _groups(b):
                numbers, digests, owner, pairs, times = own.align(texts)
                at = np.arange(row, row + len(texts)) + (part << 40)
                n, none = len(texts), pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), ids.slice(first, n), *[pa.array(numbers[:, k]) for k in range(4)], pa.array(digests, pa.string()),
                     none(n, pa.binary())], names=names)
                rows = [
                    packed(row + (part << 40), owner[k : k + STORED_LINKS], pairs[k : k + STORED_LINKS], times[k : k + STORED_LINKS])
                    for k in range(0, pairs.size, STORED_LINKS)
                ]
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [none(m, pa.int64()), none(m, ids.type), *[none(m, pa.int64())] * 4, none(m, pa.string()), pa.array(rows, pa.binary())], names=names)
                row += n

    return docs.select("doc_id", "text").mapInArrow(align, schema)


def dealt_links(rows: DataFrame, slices: int, salts: int) -> DataFrame:
    """Second pass over ``links``: (slice, salt, links), those of a few byte strings by slice."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            # Numbers of rows are kept as distances, and those of one task of the alignment are near each other.
            for _, held in groupby(map(unpacked, b.column("links").to_pylist()), lambda x: x[0][0] >> 40):
                at, pairs, times = (np.concatenate(x) for x in zip(*held))
                slice_of = bucket_of(pairs) * slices >> BUCKET_BITS
                order = np.argsort(slice_of, kind="stable")
                cuts = np.searchsorted(slice_of[order], np.arange(slices + 1))
                base = int(at.min())
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[s] : cuts[s + 1]]
                    # A row of links stays far below the size limit of a cell.
                    for k in range(0, mine.size, LOOKUP_LINKS):
                        piece = mine[k : k + LOOKUP_LINKS]
                        salt = int(mixed(np.array([(part << 20) + run], np.uint64), s)[0] % np.uint64(salts))
                        out.append((s, salt, packed(base, at[piece] - base, pairs[piece], times[piece])))
                        run += 1
            if out:
                columns = zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names=["slice", "salt", "links"])

    return rows.select("links").mapInArrow(deal, "slice long, salt long, links binary")


def look_up(links: DataFrame, tables: DataFrame, best: dict[int, int], width: int, salts: int) -> DataFrame:
    """(row, n_best, count_sum) per document and slice."""
    known = np.zeros(max(best, default=0) + 1, np.int64)
    known[list(best)] = list(best.values())

    def sums(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["row", "n_best", "count_sum"])
        own = Table(table.iloc[0])
        at, pairs, times = (np.concatenate(x) for x in zip(*map(unpacked, rows["links"])))
        count = own.counts[own.slots(pairs)]
        who, place = np.unique(at, return_inverse=True)
        n_best, total = np.zeros(who.size, np.int64), np.zeros(who.size, np.int64)
        np.add.at(n_best, place, times * (count == known[pairs // width]))
        np.add.at(total, place, times * count)
        return pd.DataFrame({"row": who, "n_best": n_best, "count_sum": total})

    salted = tables.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = links.groupBy("slice", "salt").cogroup(salted.groupBy("slice", "salt"))
    return met.applyInPandas(sums, "row long, n_best long, count_sum long")


def align_counts(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: tokens of both sides, groups, links, links of the best count, sum of counts, digest of the groups."""
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=path_b).get_piece_size()
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = written(document_links(narrow, path_a, path_b))
    linked = rows.filter("links is not null")
    partial = written(pair_counts(linked))
    pairs = written(partial.select("bucket", "pair").distinct())
    n_pairs = pairs.count()
    total = partial.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("links"), F.coalesce(F.max("part"), F.lit(0)).alias("part")).first()
    slices = min(1 << BUCKET_BITS, max(1, -(-n_pairs // SLICE_PAIRS)))
    salts = max(1, -(-total.links // (slices * LOOKUP_LINKS)))
    hashes = written(perfect_hashes(pairs, slices))
    tables = written(hashes.join(count_vectors(partial, hashes, slices, total.part + 1), "slice"))
    found = look_up(dealt_links(linked, slices, salts), tables, _best(tables, width), width, salts)
    sums = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = rows.filter("links is null").select("row", "doc_id", *_NUMBERS, "groups_sha256")
    return own.join(sums, "row", "left").select(
        "doc_id", *_NUMBERS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256"
    )
