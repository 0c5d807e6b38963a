"""Ball-tree clustering, vector packing and the Merkle manifest against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ball_tree, merkle, packing, queries

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# Clusters ------------------------------------------------------------------------------------------


def clusters_by_brute_force(rows, k, rounds, width=64, scale=256.0):
    """{id: (cluster, distance)}, inertia of all, and the centroids, by Python integers."""
    own = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(own, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = np.array([v for _, v in first], dtype=np.int64)
    points = np.array([v for _, v in own], dtype=np.int64)
    for turn in range(rounds + 1):
        d = ((points[:, None, :] - centroids) ** 2).sum(2)
        to = d.argmin(1)
        if turn < rounds:
            for c in range(len(centroids)):
                if (to == c).any():
                    centroids[c] = points[to == c].sum(0) // (to == c).sum()
    return sorted((str(i), int(c), int(d[n, c])) for n, ((i, _), c) in enumerate(zip(own, to))), int(d.min(1).sum()), centroids


def found_clusters(df):
    rows = df.collect()
    return sorted((str(r[0]), r.cluster, r.distance) for r in rows), rows


@pytest.mark.parametrize("spread", [0.01, 3.0])
def test_clusters_equal_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 64)) * 2
    rows = [(int(i), [float(x) for x in centre[i % 12] + rng.normal(size=64) * spread]) for i in range(700)]
    rows += [(9000 + i, rows[3][1]) for i in range(300)]  # a large group of copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want, inertia, centroids = clusters_by_brute_force(rows, 9, 3)
    got, full = found_clusters(ball_tree.cluster(df, 9, 3))
    assert got == want and {r.inertia for r in full} == {inertia}
    for r in full[:50]:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    assert {r.cluster: r.cluster_inertia for r in full} == pd.DataFrame([(r.cluster, r.distance) for r in full]).groupby(0)[1].sum().to_dict()


def test_whole_balls_are_assigned():
    rng = np.random.default_rng(1)
    centre = rng.integers(-5000, 5000, (4, 64))
    points = (centre[np.arange(1000) % 4] + rng.integers(-3, 4, (1000, 64))).astype(np.int64)
    tree = ball_tree.Tree(points)
    read = ball_tree.Tree.read(tree.parts(), 64)
    whole, exact = [], []
    read.assign(centre.astype(np.int64), lambda n, lo, hi, c: whole.append((lo, hi, c)), lambda rows, c: exact.append(len(rows)))
    assert sum(hi - lo for lo, hi, _ in whole) + sum(exact) == 1000 and sum(exact) < 200
    for lo, hi, c in whole:
        assert (((read.points[lo:hi, None, :] - centre) ** 2).sum(2).argmin(1) == c).all()


def test_odd_vectors_take_no_part(spark):
    v = [0.5] * 64
    rows = [(1, v), (None, [1.5] * 64), (2, None), (3, []), (4, v[:63]), (5, [None, *v[1:]]), (6, [float("nan"), *v[1:]]), (7, [float("inf"), *v[1:]]), (8, [1e30, *v[1:]]), (1, v), (9, [3e5, *v[1:]])]
    df = spark.createDataFrame([(i, x, i) for i, x in rows], "vec_id long, embedding array<double>, cluster long")
    got, full = found_clusters(ball_tree.cluster(df, 2, 2))
    assert sorted(x[0] for x in got) == ["1", "1", "9", "None"]
    want, _, _ = clusters_by_brute_force([r for r in rows if r[0] != 8], 2, 2)
    assert got == want
    none = ball_tree.cluster(df.limit(0), 3, 2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.collect() == []


# Packing -------------------------------------------------------------------------------------------


TEXT = st.text(st.one_of(st.sampled_from("aB z'sZé Éñ1²½ \t\n\x85\xa0.,!-İßẖΣσςЖ日本́#<|>"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(WORDS)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def encoder():
    with open(WORDS, encoding="utf-8") as f:
        return packing.Encoder(f.read())


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_ids_equal_the_library(tokenizer, encoder, texts):
    texts += ["it's We'LL don't 'S x<|endoftext|>y H̱ KK", ""]
    ids, bounds = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def one_by_one(lengths, limits, rule):
    """Sequences used when pieces are placed one at a time."""
    full, room = limits.vector(), []
    for length in sorted(lengths, reverse=True):
        ask = np.array([length, 1, length**2])
        fits = [i for i, r in enumerate(room) if (r >= ask).all()]
        if fits:
            room[fits[rule.order(np.array([room[i] for i in fits]), ask, full)[0]]] -= ask
        else:
            room.append(full - ask)
    return len(room)


@settings(max_examples=150, deadline=None)
@given(lengths=st.lists(st.integers(1, 40), min_size=1, max_size=80), documents=st.one_of(st.none(), st.integers(1, 6)), attention=st.one_of(st.none(), st.integers(1, 1600)), kind=st.sampled_from(["norm", "dot"]))
def test_plan_fits_every_limit(lengths, documents, attention, kind):
    limits = packing.Limits(40, documents, attention)
    lengths = sorted((min(x, limits.longest()) for x in lengths), reverse=True)
    values, counts = np.unique(lengths, return_counts=True)
    weights = (1.0, 0.0, 0.0) if kind == "norm" else (1.0, 0.5, 0.25)
    rule = packing.Rule(kind, weights)
    runs = packing.plan(dict(zip(values.tolist(), counts.tolist())), limits, rule)
    sequence, offset = runs.find(np.arange(len(lengths)))
    bins = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths)):
        bins.setdefault(s, []).append((o, n))
    assert sorted(bins) == list(range(runs.sequences))
    for held in bins.values():
        at = 0
        for o, n in held:
            assert o == at
            at += n
        assert at <= 40 and len(held) <= (documents or 40) and sum(n * n for _, n in held) <= (attention or 1600)
    if kind == "norm" and documents is None and attention is None:
        assert runs.sequences == one_by_one(lengths, limits, rule)


def check_packing(rows, tokenizer, docs, most=2048):
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    seen = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.start == r.piece * most
        seen.setdefault(r.doc_id, []).append(r.length)
    assert {i: sum(v) for i, v in seen.items()} == {i: len(v) for i, v in ids.items()}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= most
    return len(places)


def test_packing_of_the_fixture(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = queries.queries()["op12_vector_packing"](spark, DATA).collect()
    used = check_packing(rows, tokenizer, docs)
    tokens = sum(r.length for r in rows)
    assert used <= -(-tokens // 2048) + 1


def test_packing_of_odd_rows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART", 1000)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "word's end 12 " * 900), (5, "ña" * 3000), (6, "x"), (None, "a b")]
    df = spark.createDataFrame([(i, t, 7, 7) for i, t in docs], "doc_id long, text string, piece int, sequence_id int")
    found = packing.pack(df, WORDS, 0, packing.Limits(64))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing(found.collect(), tokenizer, docs, 64)
    twice = packing.pack(df.where("doc_id = 6").union(df.where("doc_id = 6")), WORDS, 0, packing.Limits(64)).collect()
    assert [(r.sequence_id, r.offset, r.length) for r in sorted(twice, key=lambda r: r.offset)] == [(0, 0, 2), (0, 2, 2)]
    assert packing.pack(df.limit(0), WORDS, 0, packing.Limits(64)).collect() == []


def test_packing_does_not_hang_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, many = (sorted(map(tuple, packing.pack(d, WORDS, 0, packing.Limits(256, documents=5)).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many


# Manifest ------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([digest(*rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def beside(rows, at):
    out = []
    for level in rows[:-1]:
        lo = at - at % 3
        out.append((level[lo:at], level[at + 1 : lo + 3]))
        at //= 3
    return out


def manifest_by_brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [levels_of([leaf_of(r) for r in groups[s]]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            proof = beside(trees[k], i) + beside(top, k)
            even = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf_of((*r[:4], r[4].replace("\n", "")) if even else r)
            for a, b in proof:
                node = digest(*a, node, *b)
            out.append((r[0], leaf_of(r), trees[k][-1][0], top[-1][0], digest(*[x for a, b in proof for x in a + b]), node, node == top[-1][0]))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, source string, lang string, n_chars long, text string"


def built(df, **how):
    found = merkle.manifest(df, FIELDS, "doc_id", "source", merkle.without_newlines(), **how)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("levels,sizes", [(1, [1, 2, 3, 4, 30]), (2, [9, 10, 82, 1]), (7, [100, 5]), (2, [1] * 25), (1, [28]), (7, [1])])
def test_manifest_equals_brute_force(spark, levels, sizes):
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            i += 1
            rows.append((i * 37 % 1009, None if s == 2 else f"s{'é' if s == 1 else ''}{s}", ["de", None][i % 2], None if i % 5 == 0 else i, [f"line {i}\nnext\n", "no break", None, "", "é\n"][i % 5]))
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert built(df, levels=levels) == sorted(manifest_by_brute_force(rows), key=repr)


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", "x", 1, "t\n"), (None, "a", "x", 1, "t\n"), (4, "a", None, None, None), (4, "a", None, None, None), (4, "a", None, None, "other\n"), (5, None, None, None, "\n"), (6, "", None, None, "\n")]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("tree", "idx", "n", "digest", "shard", "id", "leaf")})
    assert built(df, levels=1) == sorted(manifest_by_brute_force(rows), key=repr)
    assert built(df.limit(0)) == []


@pytest.mark.parametrize("name", ["op11_ball_tree_clusters", "op13_merkle_manifest"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    mine = queries.queries()[name](spark, DATA).select(*columns)
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())
