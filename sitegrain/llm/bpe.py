"""Token counts by rank-synchronous array merging of byte-level BPE.

Pre-tokens of many texts are held as one ragged array of symbol ids. In each round every sequence
finds the lowest rank among its neighbouring pairs and merges all places of that pair at once;
sequences without a mergeable pair leave the arrays, and what survives are the tokens. A merge
can only make pairs of higher rank (checked when a vocabulary is loaded), so a round of a sequence
equals the merges that a one-at-a-time tokenizer makes before the next rank.

Texts are cut in front of spaces that follow another character, where a token always ends, and
each distinct segment is merged once per task while it is remembered. Long texts go through in
bounded steps, so memory follows the step and the longest segment, not the text.

Nulls: a null text counts like an empty one, with 0 bytes and 0 tokens; a null id is carried.
Repeated rows are counted each on their own, in any order. Texts of any length are counted whole.
An empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that one step of an array computation handles.
STEP_CHARS = 2 << 20
#: Characters of segments that a task remembers before it starts afresh.
REMEMBERED_CHARS = 32 << 20
NEVER = np.iinfo(np.int32).max

# A space after a character that is no white space (U+180E was white space in older Unicode).
_CUT = re.compile(r"(?<=[^\s\u180e]) ")
_AWKWARD = re.compile(r"[\s\u180e] ")
# The usual byte-level pre-tokens of ASCII text, where no version of Unicode matters; other text goes through the library.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Parts that are cut together.
_TOGETHER = 20_000
_SEPARATORS = "\x00\x01\x02\x03\ufffe\uffff"


def segments(text: str) -> list[str]:
    """``text`` cut in front of every space that follows a character other than white space."""
    mark = next((m for m in _SEPARATORS if m not in text), None)
    if mark is None:
        return [text]
    cut = _CUT.sub(mark + " ", text) if _AWKWARD.search(text) else text.replace(" ", mark + " ")
    out = cut.split(mark)
    return out if out[0] or len(out) == 1 else out[1:]


def steps(text: str, limit: int = STEP_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut only where ``segments`` cuts as well."""
    at = 0
    while len(text) - at > limit:
        found = _CUT.search(text, at + limit)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    own = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [own[b] for b in range(256)]


class ArrayMerger:
    """Symbols and merge ranks of one vocabulary file, and the merging of ragged arrays with them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.symbol = np.array([vocab[c] for c in alphabet], np.int64)
        code = {ord(c): b for b, c in enumerate(alphabet)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.width + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        born = np.full(self.width, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge comes before the merge that makes one of its parts")
        self.token_bytes: list[bytes] = [b""] * self.width
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(code[ord(c)] for c in token) if all(ord(c) in code for c in token) else token.encode()
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or spec["normalizer"]:
            raise ValueError(f"{path}: only plain added tokens and no normalizer are supported")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path}: only the usual byte-level pre-tokenizer is supported")
        # Ranks of all pairs of single bytes, for the first round.
        self.first = self.ranks(np.repeat(self.symbol, 256), np.tile(self.symbol, 256))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER).astype(np.int32)

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all sequences in turn, tokens per sequence); ``raw`` holds the bytes of all, ``lengths`` of each."""
        raw = raw.astype(np.int64)
        ids = self.symbol[raw]
        owner = np.repeat(np.arange(lengths.size), lengths)
        rank = np.full(ids.size, NEVER, np.int32)
        if ids.size > 1:
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.first[raw[:-1] * 256 + raw[1:]], NEVER)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.size:
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, ids.size))
            open_ = lowest < NEVER
            if not open_.all():
                stay = np.repeat(open_, sizes)
                done.append((owner[~stay], ids[~stay]))
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                lowest, sizes = lowest[open_], sizes[open_]
                if not ids.size:
                    break
            here = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Overlapping places of one pair stand in a row: every other one from the left is taken.
            first = np.concatenate(([True], np.diff(here) > 1))
            here = here[(np.arange(here.size) - np.maximum.accumulate(np.where(first, np.arange(here.size), 0))) % 2 == 0]
            ids[here] = self.made[rank[here]]
            keep = np.ones(ids.size, dtype=bool)
            keep[here + 1] = False
            at = (np.cumsum(keep) - 1)[here]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            touched = np.zeros(ids.size + 1, dtype=bool)
            touched[at] = touched[at - 1] = True  # the last place takes what lies before the first
            changed = np.flatnonzero(touched[:-1])
            last = changed[changed == ids.size - 1]
            changed = changed[changed < ids.size - 1]
            rank[last] = NEVER
            same = owner[changed] == owner[changed + 1]
            rank[changed] = np.where(same, self.ranks(ids[changed], ids[changed + 1]), NEVER)
        if not done:
            return np.zeros(0, np.int64), np.zeros(lengths.size, np.int64)
        owner, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=lengths.size)

    def _lengths(self, texts: list[str]) -> np.ndarray:
        """Bytes of every pre-token of ``texts`` in turn."""
        found = [_ASCII.findall(t) if t.isascii() else [x for x, _ in self.pre_tokenizer.pre_tokenize_str(t)] for t in texts]
        return np.fromiter(map(len, chain.from_iterable(found)), np.int64)

    def tokenize(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all parts in turn, tokens per part); strings of added tokens are plain text here."""
        whole = [i for i, p in enumerate(parts) if p]
        if len(whole) < len(parts):
            ids, own = self.tokenize([parts[i] for i in whole])
            sizes = np.zeros(len(parts), np.int64)
            sizes[whole] = own
            return ids, sizes
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([len(p) if p.isascii() else len(p.encode()) for p in parts], np.int64)
        raw = np.frombuffer("".join(parts).encode(), np.uint8)
        ends = np.cumsum(sizes)
        last = raw[ends - 1]
        # A pre-token ends between a part that ends with no white space and one that begins with a space. So
        # such parts are cut together, ASCII ones apart from others, and the few remaining ones each alone.
        alone = (raw[ends - sizes] != 32) | (last <= 32)
        for i in np.flatnonzero(last > 127).tolist():
            alone[i] |= parts[i][-1].isspace() or parts[i][-1] == "\u180e"
        kind = np.where(alone, 2, np.maximum.reduceat(raw, ends - sizes) > 127)
        order = np.argsort(kind, kind="stable")
        lengths: list[np.ndarray] = []
        first = 0
        for k, n in enumerate(np.bincount(kind, minlength=3).tolist()):
            own = [parts[i] for i in order[first : first + n].tolist()]
            first += n
            step = n if k == 2 else _TOGETHER
            lengths += [self._lengths(own[at : at + step] if k == 2 else ["".join(own[at : at + step])]) for at in range(0, n, max(1, step))]
        cut = np.concatenate(lengths)
        placed = sizes[order]
        begins = (ends - sizes)[order]
        stops = np.cumsum(placed)
        ids, tokens = self.merge(raw[np.repeat(begins - stops + placed, placed) + np.arange(raw.size)], cut)
        per_part = np.diff(np.concatenate(([0], np.cumsum(tokens)))[np.searchsorted(np.cumsum(cut), stops, "right")], prepend=0)
        back = np.empty_like(order)
        back[order] = np.arange(order.size)
        own, begins = per_part[back], (np.cumsum(per_part) - per_part)[back]
        stops = np.cumsum(own)
        return ids[np.repeat(begins - stops + own, own) + np.arange(ids.size)], own


class Counter:
    """Token counts of whole texts, with the segments seen so far."""

    def __init__(self, path: str):
        self.merger = ArrayMerger(path)
        self.known: dict[str, int] = {}
        self.chars = 0

    def _learn(self, lists: list[list[str]]) -> None:
        if self.chars > REMEMBERED_CHARS:
            self.known, self.chars = {}, 0
        new = list(set(chain.from_iterable(lists)).difference(self.known))
        _, sizes = self.merger.tokenize(new)
        self.known.update(zip(new, sizes.tolist()))
        self.chars += sum(map(len, new))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the string of an added token inside a text is that one token."""
        totals = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            split = self.merger.special.split(text) if self.merger.special else [text]
            totals[i] += len(split) - 1
            for part in chain.from_iterable(map(steps, split)):
                waiting.append((i, segments(part)))
                size += len(part)
                if size >= STEP_CHARS:
                    self._add(waiting, totals)
                    waiting, size = [], 0
        self._add(waiting, totals)
        return totals

    def _add(self, waiting: list[tuple[int, list[str]]], totals: list[int]) -> None:
        self._learn([own for _, own in waiting])
        for i, own in waiting:
            totals[i] += sum(map(self.known.__getitem__, own))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker's counter, kept from one task to the next within its bounds."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per row of ``docs``, whole texts, nothing shuffled."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for b in batches:
            raw = b.column("text").to_pylist()
            sizes = pa.array([len(t or b"") for t in raw], pa.int64())
            tokens = pa.array(own.count([(t or b"").decode("utf-8", "replace") for t in raw]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, tokens], names=["doc_id", "n_bytes", "n_tokens"])

    return narrow.mapInArrow(tally, f"doc_id {kind}, n_bytes long, n_tokens long")
