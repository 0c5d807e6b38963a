"""Operators on texts against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, substring, tiling, weighted_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# Substring deduplication -----------------------------------------------------------------------


def brute_repeats(docs, width):
    first = {}
    for i, t in sorted(((i, t) for i, t in docs if i is not None), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [4, 13])
def test_remove_repeats_equals_brute_force(spark, width):
    rng = random.Random(width)
    common = [prose(rng, 30) for _ in range(4)]
    docs = [(i, "  ".join([prose(rng, rng.randrange(60)), rng.choice(common), prose(rng, rng.randrange(20))])) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[3][1].upper()), (102, None), (103, ""), (104, " \n"), (None, docs[3][1]), (7, docs[7][1]), (200, "x " * 5000), (201, "x " * 40), (202, "short text")]
    found = substring.remove_repeats(table(spark, docs).repartition(5), width, digest_only=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute_repeats(docs, width)


def test_remove_repeats_keeps_columns_and_spacing(spark):
    docs = spark.createDataFrame([(1, "a  b c d", "en", 9), (2, "x a  b c d", "fr", None)], "doc_id long, text string, lang string, n_words int")
    found = {r.doc_id: r for r in substring.remove_repeats(docs, 3).collect()}
    assert (found[1].text, found[1].lang, found[1].n_words) == ("a  b c d", "en", 4)
    assert (found[2].text, found[2].lang, found[2].n_removed) == ("x", "fr", 4)
    assert substring.remove_repeats(docs.limit(0), 3).count() == 0


@pytest.mark.parametrize("words", [64, 1024])
def test_windows_that_differ_in_a_word_stay(spark, words):
    """Two windows alike but for a word of the Thue-Morse sequence, which defeats polynomial hashes modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(words))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = [(i, " ".join(f"w{k}" for k in range(6)) + f" {x} " + " ".join(f"v{k}" for k in range(6))) for i, x in enumerate((one, other, one))]
    found = {r.doc_id: r.n_removed for r in substring.remove_repeats(table(spark, docs), digest_only=True).collect()}
    assert found == {0: 0, 1: 0, 2: 13}


def test_passes_over_shares_of_the_hashes_and_without_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    common = [prose(rng, 40) for _ in range(5)]
    docs = [(i, f"{prose(rng, rng.randrange(50))} {rng.choice(common)}") for i in range(80)]
    monkeypatch.setattr(substring, "CELL_BITS", 8)
    monkeypatch.setattr(substring, "PASSES", 3)
    monkeypatch.setattr(substring, "IDS", 2)
    frame = table(spark, docs).repartition(3)
    assert substring.plan(frame, "text") == (8, 3)
    found = substring.remove_repeats(frame, 6, digest_only=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute_repeats(docs, 6)


def test_sketch_parts_round_trip():
    rng = np.random.default_rng(0)
    cells = np.unique(rng.integers(0, 1 << 20, 5000))
    twice = rng.random(len(cells)) < 0.3
    counts = np.zeros(1 << 20, np.uint8)
    substring._add(substring._pack(cells, twice), counts)
    assert np.array_equal(np.flatnonzero(counts), cells) and np.array_equal(counts[cells] == 2, twice)
    substring._add(substring._pack(cells, np.zeros(len(cells), bool)), counts)
    assert (counts[cells] == 2).all()


# Byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_library(codec, reference, text):
    text = text.encode("utf-8", "replace").decode()
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(codec):
    tokens = codec.tokens
    assert codec.first_tier.n == len(tokens) and sorted(codec.first_tier.slot_key.tolist()) == list(range(len(tokens)))
    assert codec.first_tier.find(tokens) == list(range(len(tokens)))
    assert codec.first_tier.find([b"not a token at all", b""]) == [-1, -1]


def test_bpe_frame(spark, reference):
    texts = {1: "Hello  world", 2: None, 3: "", 4: "a" * 20000, 5: "<|endoftext|> é🙂"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "x")], "doc_id long, text string, ids string")
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(found) == 6
    for r in found:
        want = reference.encode_ordinary(texts[r.doc_id] or "")
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


# Decontamination -------------------------------------------------------------------------------


def brute_tiles(a, b, shortest):
    """Greedy string tiling by its definition: mark the longest unmarked common run, again and again; -1 is a gap."""
    fa, fb, out = [x >= 0 for x in a], [True] * len(b), []
    while True:
        best = 0, 0, 0
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = i, j, n
        i, j, n = best
        if n < shortest:
            return out
        fa[i : i + n] = fb[j : j + n] = [False] * n
        out.append(best)


def covered(found):
    return {k for i, _, n in found for k in range(i, i + n)}, {k for _, j, n in found for k in range(j, j + n)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=26), st.lists(st.integers(0, 3), max_size=16), st.integers(1, 5))
def test_tiles_equal_brute_force(a, b, shortest):
    found = tiling.tiles(a, b, shortest)
    assert found == brute_tiles(a, b, shortest)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
    assert [len(x) for x in covered(found)] == [sum(n for *_, n in found)] * 2


def test_tiles_of_long_repetitive_texts():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert sum(t[2] for t in tiling.tiles([1] * n, [1] * 150)) == 150
        assert sum(t[2] for t in tiling.tiles([1, 2, 3] * (n // 3), [3, 1, 2] * 50)) == 150
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(20_000) < 5


def test_tiles_find_distinct_words_as_brute_force_does():
    rng = random.Random(2)
    item = [rng.randrange(10**6) for _ in range(40)]
    text = item[20:] + [rng.randrange(10**6) for _ in range(9)] + item[:18]
    assert tiling.tiles(text, item) == brute_tiles(text, item, 5) and sum(t[2] for t in tiling.tiles(text, item)) == 38


def brute_contaminated(docs, bench, threshold=0.6):
    def words(text):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())

    out = []
    for (i, text), (item, own) in itertools.product(docs, bench):
        b = words(own)
        if item is not None and b and text is not None:
            place = {}
            n = sum(t[2] for t in brute_tiles([place.setdefault(w, len(place)) for w in words(text)], [place.setdefault(w, len(place)) for w in b], min(5, len(b))))
            if n >= threshold * len(b):
                out.append((i, item, round(n / len(b), 9)))
    return sorted(out, key=str)


def test_contaminated_equals_brute_force(spark):
    rng = random.Random(8)
    bench = [(i, prose(rng, rng.randrange(1, 22), 12)) for i in range(25)] + [(30, None), (31, "..."), (None, "w1 w2 w3"), (32, "w1")]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(12), 12)]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(bench[:25])[1]).split()
            at = rng.randrange(len(w))
            parts += [" ".join(w[at:] + w[:at]), prose(rng, rng.randrange(6), 12)]
        docs.append((i, ", ".join(parts)))
    docs += [(None, bench[3][1]), (5, docs[5][1]), (70, None), (71, ""), (5, "something else")]
    frame, items = table(spark, docs).repartition(3), table(spark, bench, "item_id long, text string")
    found = tiling.contaminated(frame, items).collect()
    want = brute_contaminated(docs, bench)
    assert sorted(((r.doc_id, r.item_id, round(r.coverage, 9)) for r in found), key=str) == want
    bad = {t for i, t in docs if any(x for x in brute_contaminated([(0, t)], bench))}
    assert sorted(((r.doc_id, r.text) for r in tiling.clean(frame, items).collect()), key=str) == sorted(((i, t) for i, t in docs if t not in bad), key=str)


def test_very_long_texts(spark):
    """A text of a million words and one long word beside short ones: each operator's own result for them is right."""
    rng = random.Random(6)
    item = prose(rng, 40, 10**6)
    docs = table(spark, [(1, "a " * 600_000 + item + " b" * 300_000), (2, "x" * 3_000_000), (3, item)])
    bench = table(spark, [(10, item), (11, "a " * 150)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in tiling.contaminated(docs, bench).collect()) == [(1, 10), (1, 11), (3, 10)]
    assert {r.doc_id: r.n_words for r in substring.remove_repeats(docs, digest_only=True).collect()} == {1: 900_040, 2: 1, 3: 40}
    assert {r.doc_id: r.class_id for r in weighted_minhash.classes(docs).collect()} == {1: 1, 2: 2, 3: 3}


def test_contaminated(spark):
    rng = random.Random(5)
    a, b = prose(rng, 40, 10**6), prose(rng, 30, 10**6)
    w = a.split()
    reordered = " ".join(w[27:] + w[12:27] + w[:12])
    docs = table(spark, [(1, prose(rng, 50) + " " + a + " " + prose(rng, 50)), (2, "x, " + reordered.upper() + "!"), (3, " ".join(w[:15])), (4, None), (5, ""), (6, prose(rng, 300)), (7, a + " " + b), (7, a + " " + b), (None, b)])
    bench = table(spark, [(10, a), (11, b), (12, None), (13, "too short here"), (14, b)], "item_id long, text string")
    found = sorted(((r.doc_id, r.item_id) for r in tiling.contaminated(docs, bench).collect()), key=str)
    assert found == sorted([(1, 10), (2, 10), (7, 10), (7, 11), (7, 14), (7, 10), (7, 11), (7, 14), (None, 11), (None, 14)], key=str)
    assert sorted(r.doc_id for r in tiling.clean(docs, bench).collect()) == [3, 4, 5, 6]
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 and tiling.contaminated(docs.limit(0), bench).count() == 0


# Near-duplicates -------------------------------------------------------------------------------


def brute_classes(docs, idf, threshold):
    sets = {i: weighted_minhash._one(t, idf) for i, t in docs if t}
    label = {i: i for i, _ in docs}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if dict(docs)[i] == dict(docs)[j] or (len(sets[i][0]) and weighted_minhash.similarity(sets[i], sets[j]) >= threshold):
            a, b = sorted((top(i), top(j)))
            label[b] = a
    return {i: top(i) for i, _ in docs}


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    docs, n = [], 0
    for size in (1, 2, 5, 30):
        w = prose(rng, 150, 10**5).split()
        for _ in range(size):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = f"z{rng.randrange(10**6)}"
            docs.append((n, " ".join(v)))
            n += 1
    docs += [(n, prose(rng, 80, 10**5) + " " + docs[0][1]) for n in range(n, n + 10)]
    docs += [(200, docs[5][1]), (201, docs[5][1].upper()), (202, None), (203, ""), (204, "..."), (205, "two words"), (206, "Two, words"), (207, None)]
    frame = table(spark, docs).repartition(4)
    found = {r.doc_id: r.class_id for r in weighted_minhash.classes(frame).collect()}
    assert found == brute_classes(docs, weighted_minhash.word_idf(frame), 0.8)


def test_star_of_copies_joins_through_its_centre(spark):
    """Altered copies that differ from each other more than from their original, which isn't the smallest id."""
    rng = random.Random(4)
    w = prose(rng, 300, 10**5).split()
    docs = []
    for i in range(150):
        v = list(w)
        for k in rng.sample(range(0, 300, 5), 5):
            v[k] = f"y{rng.randrange(10**7)}"
        docs.append((i, " ".join(v)))
    docs.append((500, " ".join(w)))
    found = weighted_minhash.classes(table(spark, docs)).collect()
    assert {r.class_id for r in found} == {0}


def test_pairs_that_share_a_template_are_all_measured(spark):
    """Pairs of near-duplicates behind one template: each that shares a bucket is found, though the bucket's hubs link to neither."""
    rng = random.Random(12)
    template = prose(rng, 300, 10**6)
    docs = []
    for g in range(120):
        own = prose(rng, 60, 10**6)
        docs += [(2 * g + k, f"{template} {own} {prose(rng, 28, 10**6)}") for k in range(2)]
    frame = table(spark, docs).repartition(4)
    idf = weighted_minhash.word_idf(frame)
    rows = weighted_minhash.band_keys(frame, spark.sparkContext.broadcast(idf)).collect()
    keys, marks = {r.doc: r.bands for r in rows}, {r.doc: r.samples for r in rows}
    sets = {i: weighted_minhash._one(t, idf) for i, t in docs}
    wanted = [i for i in range(0, 240, 2) if any(a == b for a, b in zip(keys[i], keys[i + 1])) and sum(a == b for a, b in zip(marks[i], marks[i + 1])) >= weighted_minhash.LEAST and weighted_minhash.similarity(sets[i], sets[i + 1]) >= 0.8]
    found = {r.doc_id: r.class_id for r in weighted_minhash.classes(frame).collect()}
    assert len(wanted) > 100 and [i for i in wanted if found[i + 1] != found[i]] == []


def test_no_link_is_lost_on_a_larger_fixture(spark):
    """Against all pairs of distinct texts of sf0.1 that share a rare shingle: at 0.8 or more they are of one class."""
    import collections

    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r.doc_id: r.class_id for r in weighted_minhash.classes(frame).collect()}
    idf = weighted_minhash.word_idf(frame)
    first = {}
    for r in frame.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    sets = {i: weighted_minhash._one(t, idf) for t, i in first.items() if t}
    holders = collections.defaultdict(list)
    for i, (h, _) in sets.items():
        for x in h.tolist():
            holders[x].append(i)
    shared = collections.Counter(p for own in holders.values() if 1 < len(own) <= 40 for p in itertools.combinations(own, 2))
    links = [p for p, n in shared.items() if n >= 0.5 * min(len(sets[i][0]) for i in p) and weighted_minhash.similarity(sets[p[0]], sets[p[1]]) >= 0.8]
    lost = [(a, b) for a, b in links if found[a] != found[b]]
    assert len(links) > 50 and len(lost) <= 0.002 * len(links)


@pytest.mark.parametrize("few", [0, 100])
def test_blocks_of_many_candidates(spark, monkeypatch, few):
    """Small blocks, verified by products alone or by pairs alone: the classes are those of brute force."""
    rng = random.Random(21)
    template = prose(rng, 200, 10**6)
    docs = [(i, f"{template} {prose(rng, 12 + i % 9, 10**6)}") for i in range(60)] + [(100 + i, f"{template} {prose(rng, 45, 10**6)}") for i in range(40)]
    frame = table(spark, docs).repartition(3)
    monkeypatch.setattr(weighted_minhash, "FEW", few)
    monkeypatch.setattr(weighted_minhash, "BLOCK", 16)
    monkeypatch.setattr(weighted_minhash, "CLIMBS", 0)
    assert {r.doc_id: r.class_id for r in weighted_minhash.classes(frame).collect()} == brute_classes(docs, weighted_minhash.word_idf(frame), 0.8)


def test_similarities_equal_one_by_one():
    rng = np.random.default_rng(4)
    weight = {h: np.float32(rng.uniform(1, 1.5)) for h in range(60)}

    def one():
        h = np.sort(rng.choice(60, rng.integers(1, 40), replace=False))
        times = rng.integers(1, 5, len(h)) + rng.choice([0, 0, 0, 0.37], len(h))
        return h.astype(np.uint64), np.array([weight[x] * t for x, t in zip(h.tolist(), times)], np.float32)

    left, right = [one() for _ in range(12)], [one() for _ in range(9)]
    want = [[weighted_minhash.similarity(a, b) for b in right] for a in left]
    assert np.allclose(weighted_minhash.similarities(left, right), want, atol=1e-5)


def test_classes_of_odd_tables(spark):
    docs = table(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, "a b c d e f")])
    assert sorted(((r.doc_id, r.class_id) for r in weighted_minhash.classes(docs).collect()), key=str) == [(1, 1), (1, 1), (3, 1), (None, None)]
    assert sorted((r.doc_id for r in weighted_minhash.keep_one(docs).collect()), key=str) == [1, 1, None]
    assert weighted_minhash.classes(docs.limit(0)).count() == 0


def test_samples_agree_as_the_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 3, 400).astype(np.float32), rng.uniform(0.5, 3, 400).astype(np.float32)
    a, b = (weighted_minhash.samples(h, w, np.array([0]), 1500)[0] for w in (wa, wb))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 0.05
