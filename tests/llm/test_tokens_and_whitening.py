"""Token counts, cross-tokenizer links and whitening against plain versions, and on awkward tables."""

import bisect
import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helpers import SMALL
from sitegrain.llm import alignment, bpe, whitening
from sitegrain.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES

A, B = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
POOL = "ab 'sS'll  \n\t\r  ᠎\x1c\x85 é日本́İ😀123#|<>\x00\x01\x02"
ODD = "doc_id long, text string, n_tokens string, row long, pair long, slice int, x long, vector string"


def fuzz(n):
    rng = random.Random(5)
    out = ["".join(rng.choice(POOL) for _ in range(rng.randrange(50))) for _ in range(n)]
    out += [x + rng.choice(["▁", " ", "<|endoftext|>", " <s><unk><0x41> "]) + y for x, y in zip(out, reversed(out))]
    return out + ["a" * k for k in range(60)] + [" " * k for k in range(60)] + ["", "<|endoftext|>"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def library_a(plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = plain
    return t


def test_counts_equal_the_library(spark, documents):
    t = library_a(False)
    rows = QUERIES["op12_array_merging"](spark, SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_counts_of_strange_texts_equal_the_library(monkeypatch):
    t, texts = library_a(False), fuzz(3000)
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert bpe.Counter(A).count(texts) == want
    monkeypatch.setattr(bpe, "STEP_CHARS", 7)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 100)
    monkeypatch.setattr(bpe.steps, "__defaults__", (7,))
    assert bpe.Counter(A).count(texts[:500] + [" ".join(texts)]) == want[:500] + [len(t.encode(" ".join(texts), add_special_tokens=False).ids)]


def test_merging_keeps_the_ids():
    t = library_a(True)
    ids, sizes = bpe.ArrayMerger(A).tokenize([" some words, and x", "aaaaaaaaa", "", " é日"])
    want = [t.encode(x, add_special_tokens=False).ids for x in (" some words, and x", "aaaaaaaaa", "", " é日")]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def plain_links(texts):
    """(numbers and digest, links) per text by whole-text encoding."""
    from sentencepiece import SentencePieceProcessor

    ta, sp = library_a(True), SentencePieceProcessor(model_file=B)
    from tokenizers import decoders

    alphabet = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    assert decoders.ByteLevel().decode(["".join(bpe.byte_alphabet()[b] for b in "é \n".encode())]) == "é \n"
    out = []
    for x in texts:
        a = ta.encode(" " + x, add_special_tokens=False).ids if x else []
        b = sp.encode(x) if x else []
        a_bytes = [bytes(alphabet[c] for c in ta.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (x or "")).encode()
        if not x or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append(((0, 0, 0, 0, ""), {}))
            continue
        a_end, b_end = np.cumsum([len(y) for y in a_bytes]).tolist(), np.cumsum([len(y) for y in b_bytes]).tolist()
        shared = sorted(set(a_end) & set(b_end))
        groups = [([], []) for _ in shared]
        for side, ids, ends in ((0, a, a_end), (1, b, b_end)):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(shared, e)][side].append(i)
        links = collections.Counter((i, j) for g, h in groups for i in g for j in h)
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append(((len(a), len(b), len(shared), sum(links.values()), hashlib.sha256(shown.encode()).hexdigest()), links))
    return out


def counted(texts):
    """The whole result per text."""
    own = plain_links(texts)
    docs = collections.Counter(p for _, links in own for p in links)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (*r[:4], sum(m for p, m in links.items() if docs[p] == best[p[0]]), sum(m * docs[p] for p, m in links.items()), r[4])
        for r, links in own
    ]


def of_rows(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_links_equal_whole_text_encoding(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = QUERIES["op13_perfect_hash_links"](spark, SMALL).collect()
    assert {r.doc_id: x for r, x in zip(rows, of_rows(rows))} == dict(zip(texts, counted(list(texts.values()))))


def test_links_of_strange_texts_with_small_bounds(spark, monkeypatch):
    """Many slices, salts, levels of the tree, flushes and steps give the same result as none."""
    for name, value in (("SLICE_PAIRS", 64), ("FAN_IN", 2), ("LOOKUP_LINKS", 16), ("HELD_PAIRS", 50), ("GROUP_BYTES", 300), ("STEP_LINKS", 5)):
        monkeypatch.setattr(alignment, name, value)
    texts = fuzz(150) + [None] * 3 + ["same text here"] * 40
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = sorted(alignment.align_counts(table, A, B).collect(), key=lambda r: r.doc_id)
    assert of_rows(rows) == counted(texts)


def test_both_passes_read_the_links_of_one_alignment(spark, monkeypatch):
    texts = ["to be or not to be", "to be", None, "", "éa ▁ b" * 9, "to be or not to be"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.col("text").cast("binary"))
    monkeypatch.setattr(alignment, "STORED_LINKS", 3)
    rows = alignment.document_links(table, A, B).collect()
    linked = spark.createDataFrame([r for r in rows if r.links is not None], "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")
    assert max(alignment.unpacked(r.links)[0].size for r in rows if r.links is not None) == 3
    own = alignment.Aligner(A, B)
    want = collections.Counter(x for t in texts for x in own.align([(t or "").encode()])[3].tolist())
    got = collections.Counter()
    for r in alignment.pair_counts(linked).collect():
        got[r.pair] += r.docs
    assert got == want
    dealt = [(r.slice, *map(np.ndarray.tolist, alignment.unpacked(r.links))) for r in alignment.dealt_links(linked, 4, 2).collect()]
    assert all((alignment.bucket_of(np.array(pairs)) * 4 >> alignment.BUCKET_BITS == s).all() for s, _, pairs, _ in dealt)
    both = [sorted(x for r in rows if r.links is not None for x in zip(*map(np.ndarray.tolist, alignment.unpacked(r.links))))]
    assert both == [sorted(x for _, *links in dealt for x in zip(*links))]


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**40, 20_000))
    made = alignment.PerfectHash.from_bytes(alignment.PerfectHash.of(keys).to_bytes())
    assert made.size == keys.size and sorted(made.slots(keys).tolist()) == list(range(keys.size))
    assert len(made.to_bytes()) * 8 < 6 * keys.size
    table = alignment.Table({"hash": made.to_bytes(), "pairs": keys[np.argsort(made.slots(keys))].tobytes()})
    assert (table.pairs[table.slots(keys)] == keys).all()
    with pytest.raises(ValueError):
        table.slots(np.array([keys[0], 2**41 + 1]))


def test_tokens_of_awkward_and_empty_tables(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)) + "y" * 5_000
    rows = [(None,) * 8] * 2 + [(1, "", "a", 1, 1, 1, 1, "v"), (2, " \n\t ", None, None, None, None, None, None)]
    rows += [(3, long, "a", 1, 1, 1, 1, "v")] * 2 + [(4, "é 日本\x01 <|endoftext|>", "a", 1, 1, 1, 1, "v")]
    table = spark.createDataFrame(rows, ODD)
    t = library_a(False)
    got = bpe.count_tokens(table, A).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((r[0] or 0, len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert bpe.count_tokens(table.limit(0), A).collect() == []
    got = alignment.align_counts(table, A, B).collect()
    assert sorted((r.doc_id or 0, x) for r, x in zip(got, of_rows(got))) == sorted(zip([r[0] or 0 for r in rows], counted([r[1] for r in rows])))
    assert alignment.align_counts(table.limit(0), A, B).collect() == []


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n = len(x)
    away = n * x - x.sum(axis=0)
    values, unit = np.linalg.eigh((away / n).T @ (away / n) / n)
    values, unit = values[::-1][:k], unit[:, ::-1][:, :k]
    return (away**2).sum(axis=1), (away / n) @ unit / np.sqrt(values), values


def test_whitening_equals_a_full_decomposition(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, values = plain_whitening([r.embedding for r in table])
    at = {r.vec_id: i for i, r in enumerate(table)}
    rows = QUERIES["op11_jacobi_davidson"](spark, SMALL).collect()
    assert len(rows) == 8 * len(table)
    got = np.full(white.shape, np.nan)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and r.n == len(table) and r.identity_error < 1e-10
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-9
    trace = np.var(np.floor(1024 * np.array([r.embedding for r in table], float)), axis=0).sum()
    assert np.allclose([next(r.explained for r in rows if r.component == c) for c in range(1, 9)], values / trace, rtol=1e-12)


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 1.02, 40), np.concatenate((np.ones(9), np.zeros(31))), 1 / np.arange(1, 301.0),
    np.concatenate(([1e6, 1e3], np.linspace(1, 1.001, 200))), np.zeros(12), np.array([3.0, 2.0, 1.0]), np.array([2.0]),
])
def test_pairs_reach_double_precision(spectrum):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((spectrum.size, spectrum.size)))
    matrix = (q * spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_pairs(lambda x: matrix @ x, spectrum.size, 8)
    top = max(spectrum.max(), 1e-300)
    assert np.abs(values - np.sort(spectrum)[::-1][:8]).max() / top < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() / top < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(values.size)).max() < 1e-13


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(6)
    matrix = rng.standard_normal((30, 30))
    matrix = matrix + matrix.T
    right, shifts = rng.standard_normal((30, 3)), np.array([0.3, -1.0, 2.5])
    got = whitening.minres(lambda x: matrix @ x, shifts, lambda x: x, right, 60)
    for j in range(3):
        assert np.allclose((matrix - shifts[j] * np.eye(30)) @ got[:, j], right[:, j], atol=1e-6)


def test_whitening_of_awkward_and_empty_tables(spark):
    rng = np.random.default_rng(9)
    good = [[float(v) for v in row] for row in rng.standard_normal((40, 3)).astype(np.float32)]
    good[5] = good[6] = good[7]
    rows = [(i, v, "n", "w", 1) for i, v in enumerate(good)] + [(None, good[0], None, None, None)]
    bad = [(90, None, "n", "w", 1), (91, [1.0, None, 2.0], "n", "w", 1), (92, [1.0, float("nan"), 2.0], "n", "w", 1)]
    bad += [(93, [1.0, float("inf"), 2.0], "n", "w", 1), (94, [], "n", "w", 1), (95, [1.0, 2.0], "n", "w", 1)]
    kind = "vec_id long, vector array<float>, x string, whitened string, n int"
    got = whitening.whiten(spark.createDataFrame(rows + bad, kind), "vec_id", "vector").collect()
    assert collections.Counter(r.component for r in got) == {c: 41 for c in (1, 2, 3)}
    assert {r.vec_id for r in got} == {*range(40), None} and max(r.identity_error for r in got) < 1e-9
    deviation, white, _ = plain_whitening(good + [good[0]], 3)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r.whitened) for r in got), np.sort(np.abs(white).ravel()), atol=1e-9)
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, vector array<float>"), "vec_id", "vector").collect()
    assert len(flat) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in flat)
    assert whitening.whiten(spark.createDataFrame(bad[:5], kind), "vec_id", "vector").collect() == []
    with_more = whitening.whiten(spark.createDataFrame(rows, kind).withColumn("vec", F.lit(1)), "vec_id", "vector")
    assert with_more.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("scale, kind", [(1.0, "bigint"), (3e6, "decimal(38,0)"), (2.0**41, "decimal(38,0)")])
def test_deviations_beyond_a_long_are_exact(spark, scale, kind):
    """Far entries stand for many rows: the squares of both are as large as those of millions of vectors."""
    vectors = [[scale * v for v in row] for row in np.random.default_rng(2).standard_normal((30, 5)).tolist()]
    vectors[3] = [0.0] * 5
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, vector array<double>"), "vec_id", "vector")
    assert dict(got.dtypes)["deviation"] == kind
    x = [[math.floor(1024 * v) + 100_000 for v in row] for row in vectors]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((len(x) * v - s) ** 2 for v, s in zip(row, total)) for i, row in enumerate(x)}
    rows = got.collect()
    assert len(rows) == 150 and all(int(r.deviation) == want[r.vec_id] for r in rows) and max(r.identity_error for r in rows) < 1e-9
    assert (max(want.values()) >= 2**63) == (kind != "bigint")


def test_entries_too_far_from_their_mean_are_an_error(spark):
    table = spark.createDataFrame([(i, [2.0**50 * (i == 0), 1.0]) for i in range(20)], "vec_id long, vector array<double>")
    with pytest.raises(OverflowError):
        whitening.whiten(table, "vec_id", "vector")


def test_a_deviation_takes_a_long_as_long_as_it_fits():
    assert whitening._deviation_type(9.2e18) == "long" and whitening._deviation_type(9.3e18) == "decimal(38,0)"
    far = 6 * 10**18 + 1
    x = np.array([[far, 0], [-far, far]], np.int64)
    assert [int(v.as_py()) for v in whitening._squares(x, np.zeros(2, np.int64), 1, "decimal(38,0)")] == [far**2, 2 * far**2]
    with pytest.raises(OverflowError):
        whitening._deviation_type(1e38)
