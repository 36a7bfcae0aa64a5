"""Best-fit packing into sequences of a fixed token length by the sum-of-squares rule.

Each text becomes token ids plus a closing id; texts longer than a sequence are cut into pieces.
A piece goes where the sum over residual gaps of (open sequences with that gap) squared becomes
smallest: into an open sequence, or into a new one. Pieces are dealt over groups of a bounded
number of pieces, and each group is packed by one task with counters per gap, never with a list
to search; only the last, partly filled sequences of a group are lost to its border (far below a
thousandth at the default group size). The number of groups grows with the corpus.

Tokens of a text do not depend on what lies beyond its white space, so each task encodes every
white-space separated string once and looks it up afterwards. Of the strings seen so far it keeps
those that came again when there are too many of them.

Nulls: a null text is packed like an empty one, as its closing id alone; a null id is carried.
Repeated rows are packed each on their own. An empty table gives no sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.bpe import byte_alphabet
from sitegrain.runtime import cut_lineage

LENGTH = 2048
#: Pieces that one task packs.
GROUP_PIECES = 50_000
#: Distinct strings, and bytes of them, that a task remembers before it drops those seen once.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64 << 20
#: Texts encoded together: about so many bytes.
STEP_BYTES = 4 << 20


class WordEncoder:
    """Token ids of texts through a table of the white-space separated strings seen so far.

    A string of plain letters and closing punctuation is made of the ids of both parts, as the
    tokenizer separates letters from punctuation in any case; so forms of a word share its work.
    Plain letters are those of the oldest alphabets, which stay letters in any version of Unicode
    and through the tokenizer's normal form and lower case; where the tokenizer cuts at nothing but
    letters, digits and other signs, its model gets their bytes at once. Other strings are encoded whole.
    """

    #: What a tokenizer does to a string before its model: letters in a row are one pre-token, by their bytes.
    _KNOWN = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    )

    _POINTS = b".,;:!?|"
    _MARK = "\x01"
    #: Letters below U+0500 (Latin, Greek, Cyrillic) without the one whose lower case holds a combining mark.
    _PLAIN = re.compile(r"(?:(?![\u0130\d_])[A-Za-z\u00c0-\u02af\u0370-\u04ff])+")

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        mark = self._plain(self._MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters: dict[int, str] | None = None
        if (spec["normalizer"], spec["pre_tokenizer"]) == self._KNOWN and not any(map(str.isalpha, (t["content"] for t in spec["added_tokens"]))):
            alphabet = byte_alphabet()
            own = (c for c in map(chr, range(0x500)) if self._plain_letters(c))
            self.letters = {ord(c): "".join(alphabet[b] for b in self.tokenizer.normalizer.normalize_str(c).encode()) for c in own}
        self.clear()

    def clear(self) -> None:
        """Code 0 is the empty string."""
        self.codes: dict[bytes, int] = {b"": 0}
        self.held = 0
        self.flat, self.begins = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.uses = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Drop the strings seen once at most; all, if most came again."""
        again = np.zeros(len(self.codes), dtype=bool)
        again[: self.uses.size] = self.uses[: again.size] > 1
        again[0] = False
        kept = [w for w, a in zip(self.codes, again.tolist()) if a]
        ids, sizes = self._gather(np.flatnonzero(again))
        self.clear()
        strings, size = self._limits()
        if len(kept) <= strings // 2 and sum(map(len, kept)) <= size // 2:
            self._add(kept, ids, sizes)

    def _limits(self) -> tuple[int, int]:
        """Strings, and bytes of them, that may be held; fewer strings, fewer bytes."""
        strings = self.remembered or REMEMBERED
        return strings, REMEMBERED_BYTES * strings // REMEMBERED

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.codes)
        self.codes.update(zip(words, range(first, first + len(words))))
        self.held += sum(map(len, words))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, ids))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of all codes in turn."""
        begins = self.begins[codes]
        sizes = self.begins[codes + 1] - begins
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if ends.size else 0)], sizes

    def _encode_letters(self, words: list[bytes]) -> None:
        """Strings of plain letters, by the model alone."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids: list[int] = []
        ends = [0]
        for w in words:
            ids += [t.id for t in tokenize(w.decode().translate(letters))]
            ends.append(len(ids))
        self._add(words, np.array(ids, np.uint32), np.diff(ends))

    def _encode_new(self, words: list[bytes]) -> None:
        """Many strings in one call, with a mark of one id between them."""
        all_ids, all_sizes = [], []
        for first in range(0, len(words), 2_000):
            texts = [w.decode("utf-8", "replace") for w in words[first : first + 2_000]]
            joined = f" {self._MARK} ".join(texts)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark) if self.mark is not None else ids[:0]
            if cuts.size == len(texts) - 1:
                all_sizes.append(np.diff(np.concatenate(([-1], cuts, [ids.size]))) - 1)
                all_ids.append(np.delete(ids, cuts))
            else:  # a string holds the mark itself
                each = [self._plain(t) for t in texts]
                all_sizes.append(np.array([len(e) for e in each], np.int64))
                all_ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
        if words:
            self._add(words, np.concatenate(all_ids), np.concatenate(all_sizes))

    def _plain_letters(self, text: str) -> bool:
        return text.isalpha() and self._PLAIN.fullmatch(text) is not None

    def _learn(self, words: list[bytes]) -> None:
        letters = [w.rstrip(self._POINTS).lower() for w in words]
        shaped = [x.isalpha() or (not x.isascii() and self._plain_letters(x.decode("utf-8", "replace"))) for x in letters]
        bases = set(compress(letters, shaped)).difference(self.codes)
        others = {w[len(x) :] if s else w for w, x, s in zip(words, letters, shaped)}.difference(self.codes, bases)
        if self.letters is None:
            others |= bases
        else:
            self._encode_letters(list(bases))
        self._encode_new(list(others))
        new = [s and w not in self.codes for w, s in zip(words, shaped)]
        made, bases = list(compress(words, new)), list(compress(letters, new))
        parts = np.empty((len(made), 2), np.int64)
        parts[:, 0] = np.fromiter(map(self.codes.__getitem__, bases), np.int64, len(made))
        parts[:, 1] = np.fromiter((self.codes[w[len(x) :]] for w, x in zip(made, bases)), np.int64, len(made))
        ids, sizes = self._gather(parts.ravel())
        self._add(made, ids, sizes[0::2] + sizes[1::2])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        strings, size = self._limits()
        if len(self.codes) > strings or self.held > size:
            self.forget()
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            unknown = [words[i] for i in missing]
            self._learn(list(set(unknown)))
            codes[missing] = np.fromiter(map(self.codes.__getitem__, unknown), np.int64, len(unknown))
        uses = np.bincount(codes, minlength=self.uses.size)
        uses[: self.uses.size] += self.uses
        self.uses = uses
        ids, sizes = self._gather(codes)
        borders = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:])]


def _encoder(path: str, remembered: int | None = None) -> WordEncoder:
    """The worker's encoder, kept from one task to the next, with the bound of the task at hand."""
    import tokenizers

    known = tokenizers.__dict__.setdefault("_sitegrain_encoders", {})
    if path not in known:
        known[path] = WordEncoder(path)
    known[path].remembered = remembered
    return known[path]


def pieces_of(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, closing: int = 0, remembered: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row per piece of at most ``length`` ids.

    ``remembered`` bounds the strings that a worker remembers (``REMEMBERED``), and with them its memory, not the result.
    """
    kind = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, remembered)
        step_bytes = max(1, STEP_BYTES * (remembered or REMEMBERED) // REMEMBERED)
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            steps = np.cumsum([len(t) for t in texts]) // step_bytes
            steps = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(texts)] if texts else [0]
            rows, piece, start, size, crc = [], [], [], [], []
            encoded = chain.from_iterable(encoder.encode(texts[x:y]) for x, y in zip(steps, steps[1:]))
            for i, own in enumerate(encoded):
                ids = np.append(own, np.uint32(closing)).astype("<u4")
                for k, at in enumerate(range(0, ids.size, length)):
                    part = ids[at : at + length]
                    rows.append(i), piece.append(k), start.append(at), size.append(part.size), crc.append(zlib.crc32(part.tobytes()))
            columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int64()) for x in (start, size, crc)], names=names)

    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) per size, larger sizes first.

    Among the choices that add least to the sum of squared counts the smallest gap wins, so ties
    go to the fullest sequence; a new sequence is the choice with the whole capacity as its gap.
    """
    count = np.zeros(capacity + 1, np.int64)  # open sequences per gap; gap 0 is closed and does not count
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(sizes.size, np.int64), np.zeros(sizes.size, np.int64)
    opened = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        # Taking gap g changes the sum by 2*(count[g - s] - count[g]) + 2; a new sequence by 2*count[capacity - s] + 1.
        change = np.where(count[s:] > 0, 2 * (count[: capacity + 1 - s] - count[s:]) + 2, np.iinfo(np.int64).max)
        if count[s] > 0:
            change[0] = 1 - 2 * count[s]  # the sequence is full then and leaves the sum
        change[-1] = 2 * count[capacity - s] + 1 if s < capacity else 0
        gap = s + int(np.argmin(change))
        if gap == capacity:
            b, opened = opened, opened + 1
        else:
            b = waiting[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            waiting[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; ``pieces`` needs a column ``length``."""
    kept = cut_lineage(pieces.withColumn("_at", F.monotonically_increasing_id()))
    groups = kept.agg(F.ceil(F.count(F.lit(1)) / group_pieces).cast("long").alias("n")).select(F.greatest("n", F.lit(1)).alias("n"))
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64("_at"), groups.scalar()))
    fields = kept.drop("_at").schema.add("sequence_id", "long").add("offset", "long")
    names = kept.drop("_at").columns

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        where, offset = sum_of_squares(pdf["length"].to_numpy(), length)
        out = pdf[names].copy()
        # A group opens at most one sequence per piece.
        out["sequence_id"], out["offset"] = where * groups_total(pdf) + key[0], offset
        return out

    def groups_total(pdf: pd.DataFrame) -> int:
        return int(pdf["_groups"].iloc[0])

    return dealt.withColumn("_groups", groups.scalar()).groupBy("_group").applyInPandas(place, fields)
