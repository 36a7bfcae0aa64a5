"""The training-data operators against brute force, checking SQL and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sitegrain.llm import licenses, lines, packing, quality, sharding, simhash, spaced, suffixes, urls, windows
from sitegrain.llm.queries import CHECKS, QUERIES, TOKENIZER, URL_RULES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _x0 string, shard int, n string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(None, None, None, None, None, None, None, None)] * 2
    rows += [(1, "", "en", "s", 0, "a", 1, "b"), (2, " \n\t ", "en", "s", 4, None, None, None)]
    rows += [(3, long, "en", "s", len(long), "a", 1, "b")] * 2 + [(4, long, None, None, None, "a", 1, "b")]
    return rows + [(5, "é ñ ß 日本語 \x01 one two", "de", None, 9, "a", 1, "b")]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    from compare import connect, differences

    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), CHECKS[name]) == []


def test_quality_counts(docs, texts):
    got = {r.doc_id: r for r in quality.robust_outliers(docs, min_rows=5).collect()}
    for i, t in texts.items():
        words = WORD.findall(t)
        grams = collections.Counter(tuple(words[p : p + 5]) for p in range(len(words) - 4))
        covered = {p + j for p in range(len(words) - 4) if grams[tuple(words[p : p + 5])] > 1 for j in range(5)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered))
        r = got[i]
        assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words) == want
        assert r._q_base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_outliers_are_rejected_and_clean_rows_stay(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * 13) % 501}" for j in range(40 + i % 30)), "en", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(f"ab{i}{j}###" for j in range(40)), "en", "s") for i in range(5)]
    rows = quality.robust_outliers(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in rows if not r._q_kept} == {b[0] for b in bad}


def plain_mcd(x):
    """Squared distances of the rows of ``x`` (thousandths) from the robust estimate of all of them, with numpy alone."""
    x = np.asarray(x, float) / 1000
    floor, keep = np.diag([0.10**2, 0.15**2, 0.10**2, 0.05**2]), 0.75

    def squared(center, cov):
        d = x - center
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    def moments(rows):
        return rows.mean(axis=0), np.cov(rows.T, bias=True)

    median = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - median), axis=0)
    found = []
    for center, cov in (moments(x), (median, np.diag(spread**2))):
        cov = cov + floor
        for _ in range(4):
            bins = np.floor(np.log1p(squared(center, cov)) * 40)
            # The nearest three quarters, and whoever shares the last bin with them.
            last = np.sort(bins)[int(np.ceil(keep * len(x))) - 1]
            center, cov = moments(x[bins <= last])
            cov = cov + floor
        found.append((np.linalg.slogdet(cov)[1], center, cov))
    _, center, cov = min(found, key=lambda f: f[0])
    d = squared(center, cov)
    bins = np.floor(np.log1p(d) * 40)
    edge = np.expm1((np.sort(bins)[int(np.ceil(keep * len(x))) - 1] + 1) / 40)
    cov = (cov - floor) * max(1.0, edge / 5.385269) + floor
    bins = np.floor(np.log1p(squared(center, cov)) * 40)
    near = np.expm1((bins + 1) / 40) <= 11.143287
    center, cov = moments(x[near if near.any() else bins == bins.min()])
    return squared(center, cov + floor)


def test_distances_equal_a_plain_estimate_at_every_level(spark, docs):
    """All documents of a language, of one large source, and of a table too small for either."""
    table = docs.select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, F.lit("big")).otherwise(F.col("source")).alias("source"))
    rows = {r.doc_id: r for r in quality.robust_outliers(table, min_rows=20).collect()}
    stats = quality.with_statistics(table).select("doc_id", "lang", "source", quality.base_failed().alias("bad"), *quality.vector()).collect()
    good = [r for r in stats if not r.bad]
    x = {r.doc_id: [r[f"_q_x{i}"] for i in range(4)] for r in stats}
    sizes = collections.Counter((r.lang, r.source) for r in good)
    langs = collections.Counter(r.lang for r in good)
    known = {}
    for r in good:
        level = 2 if sizes[r.lang, r.source] >= 20 else 1 if langs[r.lang] >= 20 else 0
        judge = (r.lang, r.source)[:level]
        if judge not in known:
            group = [q.doc_id for q in good if (q.lang, q.source)[:level] == judge]
            known[judge] = dict(zip(group, np.sqrt(plain_mcd([x[i] for i in group]))))
        row, distance = rows[r.doc_id], known[judge][r.doc_id]
        assert row._q_level == level and row._q_kept == (distance <= 23.512742**0.5)
        assert abs(row._q_distance - distance) < 1e-6 * (1 + distance)
    assert {len(judge) for judge in known} == {0, 1, 2}
    few = quality.robust_outliers(table.filter("doc_id < 7")).collect()
    assert {r._q_level for r in few if not r._q_base_failed} == {0} and all(r._q_distance is not None for r in few if not r._q_base_failed)


def test_shards(spark, docs):
    placed = sharding.assign_shards(docs, "doc_id", [1.0] * 40, [1.0] * 41)
    rows = placed.collect()
    assert len(rows) == docs.count() and all(r._s_grown in (r._s_shard, 40) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r._s_shard].append(r._s_slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    spread = spark.range(40_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs(dict(map(tuple, spread))[1] / 40_000 - 0.75) < 0.02


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    packed = packing.pack(packing.pieces_of(docs, public_tokenizers.path(TOKENIZER)), group_pieces=100).collect()
    own, room = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        own[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[i]) == want
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(room) <= -(-sum(r.length for r in packed) // 2048) + 12


def test_word_ids_equal_the_tokenizer_on_letters_of_all_kinds():
    """Letters that change under the normal form or lower case, newer letters, combining marks, closing punctuation."""
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rng = random.Random(3)
    special = "\u0130\u0958\u095c\u0344\u0387\u1e9e\ufb01\u01c5\u0345\u2126\u212b\u0300\u1c90\ua7c2\u03a3\u00df\u0149"
    letters = [chr(c) for c in range(0x250, 0x2FFFF) if chr(c).isalpha()]
    low = [chr(c) for c in range(0x41, 0x600) if chr(c).isalpha()]
    texts = ["\u0130.", "\u0958.", "\u03a3\u03a3!", "\u0149?"] + [chr(c) + "." for c in range(0x80, 0x600)]
    for _ in range(4_000):
        words = ["".join(rng.choice(rng.choice([special, letters, low, "abc", "abc"])) for _ in range(rng.randrange(1, 6))) for _ in range(3)]
        texts.append(" ".join(w + rng.choice(["", ".", ",", "!?", "|", "'s", "\u0301."]) for w in words))
    got = packing.WordEncoder(public_tokenizers.path(TOKENIZER)).encode([x.encode() for x in texts])
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_that_came_again_are_kept_when_too_many_are_remembered(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    t, rng = Tokenizer.from_file(path), random.Random(8)
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    encoder = packing.WordEncoder(path)
    for step in range(8):
        once = ["".join(rng.choice("abcdeéßж") for _ in range(9)) + "." for _ in range(100)]
        texts = ["common Words, the same; " + " ".join(once), "the common words"]
        assert [g.tolist() for g in encoder.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert b"Words," in encoder.codes and len(encoder.codes) < 700
        encoder.forget()
        # What came once is gone, what came again stays with its ids.
        assert b"common" in encoder.codes and once[0].encode() not in encoder.codes
    monkeypatch.setattr(packing, "REMEMBERED", 4)
    encoder.forget()
    assert list(encoder.codes) == [b""]


def test_packing_remembers_as_many_words_as_it_is_told(spark):
    """A bound lower than that of the module holds fewer words and gives the same ids; the pipeline's stage has one."""
    path, rng = public_tokenizers.path(TOKENIZER), random.Random(9)
    few, many = packing.WordEncoder(path, 200), packing.WordEncoder(path)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(40)) for _ in range(60)]
    for t in texts:
        assert [g.tolist() for g in few.encode([t.encode()])] == [g.tolist() for g in many.encode([t.encode()])]
        assert len(few.codes) <= 250
    assert len(many.codes) > 2_000
    assert corpus_pipeline.REMEMBERED <= packing.REMEMBERED // 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert packing.pieces_of(docs, path, remembered=200).collect() == packing.pieces_of(docs, path).collect()


def test_simhash_components(docs, texts):
    want = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        s = [b" ".join(w[p : p + 3]) for p in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in want}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(want):
        for j in sorted(want):
            if i < j and (want[i] ^ want[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r._fp % 2**64, r.component_id) for r in got} == {i: (want[i], find(i)) for i in want}


def test_vantage_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    points = np.unique(np.concatenate([b := rng.integers(0, 2**63, 1500).astype(np.uint64), b[:300] ^ np.uint64(5), b[:200] ^ np.uint64(1 << 40)]))
    tree = simhash.VantageTree(points[::3], 16)
    assert tree.leaves > 8
    row, leaf, home = tree.route(points, 2)
    assert sorted(row[home].tolist()) == list(range(points.size))
    linked = set()
    for n in range(tree.leaves):
        mine = row[leaf == n]
        h = np.flatnonzero(home[leaf == n])
        for x, y in simhash.close_pairs(points[mine[h]], points[mine], 2):
            linked |= {tuple(sorted(p)) for p in zip(mine[h][x].tolist(), mine[y].tolist()) if p[0] != p[1]}
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert linked == {(i, j) for i, j in zip(*np.nonzero(close)) if i < j}


@pytest.mark.parametrize("bounds", [(4096, 1024), (60, 4), (16, 3)])
def test_trees_of_trees_link_all_pairs(spark, bounds):
    """Full leaves get trees of their own: the links join exactly what lies within two bits, however small the leaves."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 250, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, base.size, dtype=np.uint64) for _ in range(4)]
    points = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1], base ^ flips[1] ^ flips[2] ^ flips[3], base[:1] ^ np.arange(200, dtype=np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "_fp long")
    got = simhash.fingerprint_links(table, shard_points=bounds[0], leaves=bounds[1]).collect()
    at = {int(x): i for i, x in enumerate(points.view(np.int64))}

    def classes(pairs):
        parent = list(range(points.size))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            parent[max(root(i), root(j))] = min(root(i), root(j))
        return [root(i) for i in range(points.size)]

    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert all(close[at[r.a], at[r.b]] for r in got)
    assert classes([(at[r.a], at[r.b]) for r in got]) == classes(zip(*np.nonzero(close)))


def test_spaced_seeds_tolerate_substitutions(spark):
    item = [f"item{i}" for i in range(30)]
    swapped = [w if i % 9 != 4 else "other" for i, w in enumerate(item)]
    noise = [f"noise{i}" for i in range(50)]
    rows = [(1, " ".join(noise + item + noise)), (2, " ".join(noise + swapped)), (3, " ".join(noise)), (4, None), (5, " ".join(item[:8] + noise))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.words, r.equal) for r in spaced.contaminated(table, bench).collect()}
    assert got == {(1, 7): (50, 30, 30), (2, 7): (50, 30, 27)}
    assert {r.doc_id for r in spaced.drop_contaminated(table, bench).collect()} == {3, 4, 5}


def plain_overlaps(text, item, least):
    """Overlaps of two word lists by comparing every alignment that holds a mask, with plain loops."""
    found = []
    for d in range(-len(item) + 1, len(text)):
        same = {j: text[j + d] == item[j] for j in range(len(item)) if 0 <= j + d < len(text)}
        if not any(all(same.get(j + o, False) for o in m) and j + m[-1] in same for m in spaced.MASKS for j in same):
            continue
        todo = [(min(same), max(same) + 1)]
        while todo:
            low, high = todo.pop()
            best, run, begin = (0, 0, 0), 0, low
            for j in range(low, high):
                if run < 0:
                    run, begin = 0, j
                run += 1 if same[j] else -spaced.MISMATCH
                if run > best[0]:
                    best = (run, begin, j + 1)
            equal = sum(same[j] for j in range(best[1], best[2]))
            if equal >= least:
                found.append((-equal, best[1] + d, best[2] - best[1]))
                todo += [(low, best[1]), (best[2], high)]
    taken = []
    for n, start, length in sorted(found):
        if all(start + length <= a or start >= a + b for a, b, _ in taken):
            taken.append((start, length, -n))
    return sorted(taken)


def test_overlaps_equal_plain_loops(spark):
    """Every passage of every pair, over few different words, repeats and replaced words; small bounds change nothing."""
    rng = np.random.default_rng(5)
    item = [f"x{i}" for i in range(25)]
    texts = [" ".join(rng.choice(list("abcdef"), size=n)) for n in (0, 9, 60, 200)] + ["a " * 90, " ".join(item + ["-"] * 9 + item), None]
    texts += [" ".join(w if rng.random() > 0.15 else "no" for w in item * 3) for _ in range(4)] + ["a " * 90]
    items = [" ".join(rng.choice(list("abcdef"), size=40)), "a " * 30, " ".join(item), texts[3][20:140], "a b", None, " ".join(item)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = sorted(
        (i, j, *o) for i, t in enumerate(texts) for j, u in enumerate(items) for o in plain_overlaps((t or "").split(), (u or "").split(), 10)
    )
    assert sum(1 for r in want if r[:2] == (5, 2)) == 2
    assert sorted(map(tuple, spaced.contaminated(docs, bench).collect())) == want
    kept = {i for i in range(len(texts))} - {r[0] for r in want}
    assert {r.doc_id for r in spaced.drop_contaminated(docs, bench).collect()} == kept


def test_repeated_words_need_no_pair_of_seeds():
    """A text of one word, many times over: one flag per diagonal, disjoint overlaps."""
    word = spaced._hashes(b"a")
    got = spaced.Text(np.repeat(word, 5000)).overlaps(np.repeat(word, 500), 10)
    assert got == [(i * 500, 500, 500) for i in range(10)]


def test_whole_items_are_found(spark, docs, texts):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {(i, b.item_id) for b in items.collect() for i, t in texts.items() if b.text in t}
    assert want <= {(r.doc_id, r.item_id) for r in spaced.contaminated(docs, items).collect()}


def test_repeated_windows(docs, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(t[p : p + 200] for t in raw.values() for p in range(len(t) - 199))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_windows(docs).collect()}
    for i, t in raw.items():
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p + 1 : p + 201] = True
        rest = bytes(c for c, g in zip(t, gone[1:]) if not g)
        assert got[i] == (len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest())


def test_long_repeats_are_found(docs, texts):
    places = collections.defaultdict(set)
    for i, t in texts.items():
        w = t.lower().split()
        for p in range(len(w) - 50):
            places[tuple(w[p : p + 51])].add(i)
    want = set().union(set(), *[v for v in places.values() if len(v) > 1])
    rows = windows.near_duplicate_passages(docs).collect()
    assert want <= {x for r in rows for x in (r.doc_id, r.partner_id)}
    assert all(r.similarity >= 0.8 and r.words >= 50 for r in rows)


def test_recall_of_near_passages(spark):
    """Passages of 60 words with one word replaced, inserted or left out, each pair on its own in unlike texts."""
    import random

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows, n = [], 240
    for i in range(n):
        passage = [word() for _ in range(60)]
        near, at = list(passage), rng.randrange(60)
        if i % 3 == 0:
            near[at] = word()
        elif i % 3 == 1:
            near.insert(at, word())
        else:
            del near[at]
        for k, p in enumerate((passage, near)):
            rows.append((2 * i + k, " ".join([word() for _ in range(rng.randrange(30, 90))] + p + [word() for _ in range(rng.randrange(30, 90))])))
    found = windows.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {tuple(sorted((r.doc_id, r.partner_id))) for r in found}
    assert all(a // 2 == b // 2 for a, b in pairs)
    assert len(pairs) >= 0.9 * n, len(pairs) / n


def _between(rng, passages, least=30, most=90):
    """One text around each passage, of words that no other text has."""
    word = lambda: f"w{rng.randrange(10**9)}"
    fill = lambda: [word() for _ in range(rng.randrange(least, most))]
    return [(i, " ".join(fill() + p + fill())) for i, p in enumerate(passages)]


def test_links_of_texts_unlike_the_leader_of_their_group(spark):
    """Variants of one passage that are unlike each other, each with a near copy: the near copies are linked, in groups of any size."""
    import random

    rng = random.Random(5)
    for n in (10, 60):  # below and above PAIRED texts a signature
        common = [f"c{i}" for i in range(30)]
        passages = []
        for i in range(n):
            own = common + [f"v{i}x{j}" for j in range(30)]
            near = list(own)
            near[rng.randrange(60)] = "changed"
            passages += [own, near]
        rows = windows.near_duplicate_passages(spark.createDataFrame(_between(rng, passages), "doc_id long, text string")).collect()
        assert {tuple(sorted((r.doc_id, r.partner_id))) for r in rows} == {(2 * i, 2 * i + 1) for i in range(n)}
        assert {(r.doc_id // 2 * 2, r.class_id) for r in rows} == {(2 * i, 2 * i) for i in range(n)}


def test_one_class_for_a_passage_in_many_texts(spark):
    """More texts with one passage than are paired each with each: one class, and few rows."""
    import random

    rows = _between(random.Random(6), [[f"c{i}" for i in range(70)]] * 100)
    found = windows.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in found for x in (r.doc_id, r.partner_id)} == set(range(100))
    assert {r.class_id for r in found} == {0} and len(found) < 300


def _made_between(spark, monkeypatch, rows):
    """The rows found, and the numbers of pairs compared and of shingles looked at near the signatures of larger groups."""
    made = []
    whole = windows.written
    monkeypatch.setattr(windows, "written", lambda df: made.append((df.columns, out := whole(df))) or out)
    found = windows.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs, near = (sum(df.count() for names, df in made if names == kind) for kind in (["ta", "tb"], ["k", "ta", "root", "s"]))
    return found, pairs, near


def test_a_short_common_line_in_many_texts_makes_no_rows(spark, monkeypatch):
    """A line shorter than a run in unlike texts: none are compared beyond the leader, and no shingles are listed near it."""
    rows = _between(random.Random(7), [[f"c{i}" for i in range(20)]] * 80)
    found, pairs, near = _made_between(spark, monkeypatch, rows)
    assert not found and pairs <= 400 and near == 0


def test_near_copies_unlike_their_leader_are_not_paired_each_with_each(spark, monkeypatch):
    """Many variants of one text, some far from each other: the classes of all pairs, by far fewer comparisons."""
    rng = random.Random(11)
    base, n = [f"b{i}" for i in range(200)], 90
    passages = []
    for _ in range(n):
        own = list(base)
        for p in rng.sample(range(200), 6):
            own[p] = f"x{rng.randrange(10**9)}"
        passages.append(own)
    rows = _between(rng, passages)
    grams = [windows._text_shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)], np.int64))[0] for _, t in rows]
    least = list(range(n))
    for i in range(n):
        for j in range(i):
            if least[i] != least[j] and windows.similar_passages(grams[i], grams[j], 46, 0.8):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    found, pairs, _ = _made_between(spark, monkeypatch, rows)
    got = {x: r.class_id for r in found for x in (r.doc_id, r.partner_id)}
    assert all(got.get(i, i) == c for i, c in enumerate(least))
    assert max(collections.Counter(least).values()) > n // 2 and pairs < n * n / 4, pairs


def test_further_links_join_the_classes_found_before(spark, monkeypatch):
    """After the first classes only the classes that further links connect are looked at, not all links again."""
    seen, whole = [], windows.components
    monkeypatch.setattr(windows, "components", lambda links: seen.append(links.count()) or whole(links))
    rng = random.Random(11)
    base, passages = [f"b{i}" for i in range(200)], []
    for _ in range(90):
        own = list(base)
        for p in rng.sample(range(200), 10):
            own[p] = f"x{rng.randrange(10**9)}"
        passages.append(own)
    found = windows.near_duplicate_passages(spark.createDataFrame(_between(rng, passages), "doc_id long, text string")).collect()
    links = spark.createDataFrame([(r.doc_id, r.partner_id) for r in found], "a long, b long")
    want = {r.node: r.root for r in whole(links).collect()}
    assert {x: r.class_id for r in found for x in (r.doc_id, r.partner_id)} == want
    assert len(seen) > 1 and sum(seen) == len(found), (seen, len(found))


def test_pairs_compared_at_once_give_the_passages_of_each():
    rng = np.random.default_rng(8)
    words = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    edited = words.copy()
    edited[120:125] = rng.integers(1, 1 << 60, 5).astype(np.uint64)
    none = words[:0]
    repeated = np.concatenate((np.tile(words[:30], 9), words[100:200]))
    pairs = [(words, edited), (words, none), (none, words), (repeated, words), (repeated, repeated[7:]), (words, words[::-1].copy()), (edited, words[50:140])]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    cuts = [np.append(0, np.cumsum([p[i].size for p in pairs])) for i in (0, 1)]
    got = list(windows.similar_passages_of(a, b, *cuts, 46, 0.8))
    assert got == [(p, *f) for p, (x, y) in enumerate(pairs) for f in windows.similar_passages(x, y, 46, 0.8)]
    assert (0, 0, 300, 0, 300) in {f[:5] for f in got} and {f[0] for f in got} == {0, 3, 4, 6}


def test_similar_passages_of_moved_blocks_and_longer_insertions():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 1 << 60, 100)
    grams = lambda w: np.array([hash(tuple(w[i : i + 5].tolist())) for i in range(w.size - 4)], np.int64).view(np.uint64)
    swapped = np.concatenate((words[50:], words[:50]))
    longer = np.concatenate((words[:40], rng.integers(1, 1 << 60, 9), words[40:]))
    for other in (words, swapped, longer):
        assert windows.similar_passages(grams(words), grams(other), 46, 0.8)
    assert not windows.similar_passages(grams(words[:60]), grams(np.concatenate((words[:30], rng.integers(1, 1 << 60, 30)))), 46, 0.8)


def test_repetitive_pairs_are_not_compared_part_by_part(monkeypatch):
    rng = np.random.default_rng(12)
    words = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    a = np.tile(words[:40], 12)
    a[::37] = words[41 : 41 + a[::37].size]
    b = np.concatenate((np.tile(words[:40], 8), words[60:120], a[100:300]))
    plain = lambda p, q: len(set(p) & set(q)) / len(set(p) | set(q))
    for start in (0, 70):
        end = np.arange(start + 20, start + 200, 7)
        low, high = np.maximum(0, 200 - np.arange(end.size) * 5), 210 + np.arange(end.size) * 3
        number = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
        got = windows._shares(number[: a.size], number[a.size :], number.max() + 1, start, end, low, high)
        assert got.tolist() == [plain(a[start:e].tolist(), b[x:y].tolist()) for e, x, y in zip(end, low, high)]
    compared, whole = [], windows._shares
    monkeypatch.setattr(windows, "_shares", lambda *x: compared.append(1) or whole(*x))
    found = windows.similar_passages(a, b, 46, 0.8)
    assert found and len(compared) <= windows._runs(a, b)[0].size
    for a0, a1, b0, b1, share in found:
        assert share >= 0.8 and share == plain(a[a0:a1].tolist(), b[b0:b1].tolist())


def _all_runs(a, b):
    """(start in a, start in b, size) of the common runs near a diagonal with a long one, match by match."""
    runs, same = [], a[:, None] == b[None, :]
    for d in range(1 - b.size, a.size):
        x = np.arange(max(0, d), min(a.size, b.size + d))
        edge = np.diff(np.concatenate(([0], same[x, x - d].astype(int), [0])))
        runs += [(x[0] + i, x[0] + i - d, j - i) for i, j in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0))]
    strong = {x - y for x, y, n in runs if n > windows.RUN - windows.SHINGLE}
    return sorted(r for r in runs if any(x in strong for x in range(r[0] - r[1] - windows.SHIFT, r[0] - r[1] + windows.SHIFT + 1)))


@pytest.mark.parametrize("step", [37, windows.STEP_ENDS])
def test_all_runs_of_repetitive_pairs_are_found(monkeypatch, step):
    monkeypatch.setattr(windows, "STEP_ENDS", step)
    rng = np.random.default_rng(14)
    u = rng.integers(1, 1 << 60, 40).astype(np.uint64)
    coin = rng.choice(u[:2], 300), rng.choice(u[:2], 280)
    coin[1][50:90] = coin[0][100:140]
    lines = [np.tile(u, 60) for _ in range(2)]
    for v in lines:
        v[rng.integers(0, v.size, 50)] = rng.integers(1, 1 << 60, 50)
    pairs = [(np.repeat(u[:4], 50), np.repeat(u[1:6], 60)), (np.tile(u[:2], 100), np.concatenate((u[5:9], np.tile(u[:2], 90), u[:3]))), coin, lines, (u[:30], u)]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    cuts = [np.append(0, np.cumsum([p[i].size for p in pairs])) for i in (0, 1)]
    pair, x, y, size, _, _, dense = windows._common_runs(a, b, *cuts)
    assert dense.tolist() == [True] * 4 + [False]
    for p, (own, other) in enumerate(pairs):
        assert sorted(zip(x[pair == p], y[pair == p], size[pair == p])) == _all_runs(own, other)


def test_passages_at_all_places_of_repetitive_pairs():
    """Each of many near copies in one text meets each of those in the other, not only the first and the last."""
    rng = np.random.default_rng(21)
    unit, n = rng.integers(1, 1 << 60, 60), 60
    texts = []
    for _ in range(2):
        parts = []
        for _ in range(n):
            own = unit.copy()
            own[rng.integers(10, 50)] = rng.integers(1, 1 << 60)
            parts += [own, rng.integers(1, 1 << 60, 10)]
        texts.append(np.concatenate(parts).astype(np.uint64))
    a, b = texts
    assert windows._common_runs(a, b, np.array([0, a.size]), np.array([0, b.size]))[6].all()
    found = windows.similar_passages(a, b, 46, 0.8)
    plain = lambda p, q: len(set(p) & set(q)) / len(set(p) | set(q))
    met = np.zeros((n, n), dtype=bool)
    for a0, a1, b0, b1, share in found:
        assert share == plain(a[a0:a1].tolist(), b[b0:b1].tolist()) >= 0.8
        i, j = ([k for k in range(v0 // 70, v1 // 70 + 1) if min(v1, 70 * k + 60) - max(v0, 70 * k) >= 40] for v0, v1 in ((a0, a1), (b0, b1)))
        met[np.ix_(i, j)] = True
    assert met.all()


def test_texts_that_share_a_repeated_word_are_linked(spark):
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate([("la", 700), ("la", 650), ("la", 80), ("le li", 400), ("le li", 390), ("lo", 30)])]
    rows.append((6, "a text of its own that has one word many times " + "la " * 60 + "and ends so"))
    found = windows.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x, r.class_id) for r in found for x in (r.doc_id, r.partner_id)} == {(0, 0), (1, 0), (2, 0), (6, 0), (3, 3), (4, 3)}
    whole = {tuple(sorted((r.doc_id, r.partner_id))): {r.words, r.partner_words} for r in found}
    assert whole[(0, 1)] == {700, 650} and whole[(3, 4)] == {800, 780}


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(2)
    values = np.concatenate(([0], rng.permutation(1 << 12)[:300] + 1)).astype(np.uint64) << np.uint64(40)
    got = set(zip(*(x.tolist() for x in windows.compact_windows(values, np.array([0]), 20))))
    want = set()
    for c in range(1, 301):
        a, b = c, c
        while values[a - 1] > values[c]:
            a -= 1
        while b < 300 and values[b + 1] > values[c]:
            b += 1
        if b - a + 1 >= 20:
            want.add((a, c, b))
    assert got == want


def test_url_parts(spark):
    given = [None, "", "nohost", "HTTP://WWW.Example.NET/en/a?q=/x#y", "http://example.com/de", "x://a.org?/fr/", "x://é.ORG/fr/É#", "x://net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    listed = urls.listed_urls(pages.filter("page_id = 4"))
    got = {r.page_id: (r._u_host, r._u_path, r._u_rule, r._u_verdict) for r in urls.judge(pages, listed, URL_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("www.example.net", "/en/a", "example.net/en/", "allow"), 4: ("example.com", "/de", None, "block"),
        5: ("a.org", "", None, "allow"), 6: ("é.org", "/fr/É", "org/fr/", "allow"), 7: ("net", "/", "net/", "block"),
    }


OPERATORS = {
    "op1": lambda d: quality.robust_outliers(d),
    "op1 drop": lambda d: quality.drop_outliers(d),
    "op2": lambda d: lines.drop_boilerplate(d),
    "op3": lambda d: windows.near_duplicate_passages(d),
    "op4": lambda d: sharding.assign_shards(d, "doc_id", [1.0, 2.0]),
    "op5": lambda d: packing.pack(packing.pieces_of(d, public_tokenizers.path(TOKENIZER))),
    "op6": lambda d: simhash.near_duplicates(d),
    "op6 keep": lambda d: simhash.keep_one_of_each(d),
    "op7": lambda d: urls.judge(d, urls.listed_urls(d, "text"), URL_RULES, "text"),
    "op8": lambda d: licenses.scan(d, licenses.NOTICES),
    "op9": lambda d: spaced.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "op10": lambda d: suffixes.repeated_windows(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_and_empty_tables(spark, name):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    rows = OPERATORS[name](odd).collect()
    if name in ("op1", "op2", "op4", "op6", "op7", "op10"):
        assert len(rows) == 8
    if name == "op6 keep":
        # Null, empty and blank texts are one group, the three long ones another.
        assert len(rows) == 3
    if name == "op10":
        assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (3, 4))
    assert OPERATORS[name](odd.limit(0)).collect() == []


CLASHING = ("_at", "_site", "_drop", "_kept", "_canon", "_key", "_block", "_w0", "_n", "_ka", "_fp", "_id", "_row", "_part", "_shard", "_q_grp", "root", "grp")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_change_nothing(spark, name):
    """Columns named like an operator's own: same rows, and operators that hand on the input keep them."""
    plain = spark.createDataFrame(odd_rows(), DOCS).drop("_x0", "n")
    more = plain.withColumns({c: F.lit("mine") for c in CLASHING})
    got, want = OPERATORS[name](more), OPERATORS[name](plain)
    shared = [c for c in want.columns if c not in CLASHING]
    assert sorted(map(str, got.select(*shared).collect())) == sorted(map(str, want.select(*shared).collect()))
    if name in ("op1 drop", "op2", "op4", "op6 keep", "op7"):
        assert all(r[c] == "mine" for r in got.collect() for c in CLASHING)


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_on_awkward_tables(spark, tmp_path, number):
    """Every stage takes nulls, blanks, long texts, repeated rows, clashing columns and an empty table."""
    name, stage = corpus_pipeline.STAGES[number]
    odd = spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit("mine") for c in CLASHING})
    out = stage(spark, odd, SMALL)
    rows = out.collect()
    if name != "best-fit packing":
        assert out.columns == odd.columns and all(r["_site"] == "mine" for r in rows)
    assert len(rows) == {"quality rules": 3, "line dedup": 8, "SimHash near-dedup": 3, "benchmark decontamination": 8}.get(name, len(rows))
    assert stage(spark, odd.limit(0), SMALL).collect() == []


def test_benchmark_ids_of_any_kind(spark):
    item = " ".join(f"item{i}" for i in range(30))
    table = spark.createDataFrame([("a", item)], "doc_id string, text string")
    items = spark.createDataFrame([("", item), (None, item), ("b", item)], "item_id string, text string")
    assert sorted(str(r.item_id) for r in spaced.contaminated(table, items).collect()) == ["", "None", "b"]


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert docs.count() > 0
        assert name == "best-fit packing" or docs.columns == columns
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
