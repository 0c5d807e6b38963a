"""Neighbour graphs, fuzzy weights and layouts against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding

DATA = "/root/testdata/sf0.01/embeddings.parquet"


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(parts)


def trustworthiness(x, y, k):
    """1 where all of a row's k neighbours in the layout are among its k in ``x``, lower by the ranks of those that aren't."""
    n = len(x)
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(far, -1)
    np.fill_diagonal(near, np.inf)
    rank = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
    shown = np.argsort(near, axis=1, kind="stable")[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, shown, 1) - k).sum()


def clusters(seed=3, each=60, size=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, size)) * 6
    return np.concatenate([c + draw.normal(size=(each, size)) for c in centres]), np.repeat(np.arange(4), each)


def test_curve_equals_published_values():
    assert embedding.curve(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)
    assert embedding.curve(0.001) == pytest.approx((1.929, 0.792), abs=2e-3)


def test_graph_is_exact_in_one_leaf_and_near_in_many(spark):
    x, _ = clusters(each=150)
    found = {}
    for leaf in (1024, 100):
        points, n, size = embedding.numbered(table(spark, x), "id", "v", leaf)
        assert (n, size) == (600, 16)
        rows = points.join(embedding.neighbour_graph(points, n, size, 10, leaf=leaf), "node").orderBy("node").collect()
        assert [r.node for r in rows] == list(range(600))
        v = np.array([r.v for r in rows])
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        best = np.argsort(d, axis=1, kind="stable")[:, :10]
        found[leaf] = np.mean([len(set(r.j) & set(b)) / 10 for r, b in zip(rows, best)])
        assert all(list(r.d) == sorted(r.d) and r.node not in r.j for r in rows)
    assert found[1024] == 1.0
    assert found[100] > 0.9


def test_fuzzy_weights_sum_to_log2_and_are_symmetric(spark):
    graph = spark.createDataFrame([(0, [1, 2], [1.0, 3.0]), (1, [0, 2], [1.0, 2.0]), (2, [1, 0], [2.0, 3.0]), (3, [], [])], "node long, j array<long>, d array<double>")
    found = {(r.i, r.j): r.w for r in embedding.fuzzy_weights(graph, 3).collect()}
    second = np.log2(3) - 1  # the nearest is sure, so the other has the rest
    assert found == pytest.approx({(0, 1): 1, (1, 0): 1, (1, 2): 1, (2, 1): 1, (0, 2): 2 * second - second**2, (2, 0): 2 * second - second**2})


def test_clusters_stay_apart_in_any_partitioning(spark):
    x, label = clusters()
    options = dict(neighbours=15, rounds=4, epochs=20)
    one = np.array([r[1:] for r in sorted(embedding.neighbour_embedding(table(spark, x), "id", "v", **options).collect())])
    two = np.array([r[1:] for r in sorted(embedding.neighbour_embedding(table(spark, x[::-1], 7).withColumn("id", 239 - F.col("id")), "id", "v", **options).collect())])
    np.testing.assert_allclose(one, two, atol=1e-3)
    d = ((one[:, None] - one[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    assert (label[near] == label[:, None]).mean() > 0.97
    assert trustworthiness(x, one, 10) > 0.85


def test_copies_nulls_odd_sizes_and_small_tables(spark):
    schema = "`a b` long, v array<double>"
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100 + i, [0.0, 0.0, 1.0]) for i in range(60)]
    odd = [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 0.0, 0.0]), (303, [1.0]), (304, []), (None, [0.0, 0.0, 1.0])]
    out = embedding.neighbour_embedding(spark.createDataFrame(rows + odd, schema), "a b", "v", neighbours=5, rounds=2, epochs=5)
    assert out.columns == ["a b", "e1", "e2"]
    found = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert len(found) == 126
    assert {found[i] for i in range(300, 305)} == {(None, None)}
    assert len({found[i] for i in [0, 35, *range(100, 160)]} | {found[None]}) == 1 and None not in found[0]
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [3.0, 4.0])]):
        assert embedding.neighbour_embedding(spark.createDataFrame(few, schema), "a b", "v").count() == len(few)


def test_many_parts_and_a_hub(spark, monkeypatch):
    """Parts of 64 nodes, of which one is linked to all others: places are finite and no task is given the hub's links."""
    monkeypatch.setattr(embedding, "PART", 64)
    monkeypatch.setattr(embedding, "REPELLING", 50)
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1, 399)]
    links = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "i long, j long, w double")
    start = spark.range(400).select(F.col("id").alias("node"), F.array(F.sin("id"), F.cos("id")).alias("at"))
    found = embedding.layout(links, start, 400, rounds=4, epochs=10, most=16).orderBy("node").collect()
    assert [r.node for r in found] == list(range(400))
    assert np.isfinite(np.array([r["at"] for r in found])).all()


def test_layout_of_the_fixture_and_its_components(spark):
    """The fixture's vectors have little structure (0.5 is chance, and components reach 0.62): the layout stays near that."""
    vectors = spark.read.parquet(DATA)
    x = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()])
    of = {m: np.array([r[1:] for r in sorted(embedding.reduce_dimensions(vectors, "vec_id", "embedding", m).collect())]) for m in ("umap", "PCA")}
    centred = x.astype(float) - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(np.abs(of["PCA"]), np.abs(centred @ axes[:2].T), atol=1e-6)
    assert trustworthiness(x, of["umap"], 15) > 0.58
    kept = trustworthiness(x, np.array([r[1:] for r in sorted(embedding.reduce_dimensions(vectors, "vec_id", "embedding", "tsne").collect())]), 15)
    assert kept > trustworthiness(x, of["PCA"], 15) + 0.05


def joint(d, perplexity):
    """The joint probabilities of all pairs from a matrix of distances, a row at a time by halving."""
    n = len(d)
    p = np.zeros((n, n))
    for i in range(n):
        others = np.arange(n) != i
        low, high = 0.0, 1e6
        for _ in range(200):
            rate = (low + high) / 2
            e = np.exp(-rate * (d[i, others] ** 2 - (d[i, others] ** 2).min()))
            e /= e.sum()
            low, high = (rate, high) if -(e * np.log(np.maximum(e, 1e-300))).sum() > np.log(perplexity) else (low, rate)
        p[i, others] = e
    return (p + p.T) / (2 * n)


def divergence(p, y):
    q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
    np.fill_diagonal(q, 0)
    q /= q.sum()
    some = p > 0
    return (p[some] * np.log(p[some] / np.maximum(q[some], 1e-300))).sum()


def links_of(spark, p):
    i, j = np.nonzero(p)
    return spark.createDataFrame([(int(a), int(b), float(p[a, b])) for a, b in zip(i, j)], "i long, j long, w double")


def test_affinities_equal_brute_force_over_all_points(spark):
    x = np.random.default_rng(5).normal(size=(40, 6)) + 3 * (np.arange(40) % 2)[:, None]
    points, n, size = embedding.numbered(table(spark, x), "id", "v")
    v = np.array([r.v for r in points.orderBy("node").collect()])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    found = np.zeros((n, n))
    for r in embedding.affinities(embedding.neighbour_graph(points, n, size, n - 1), n, 8).collect():
        found[r.i, r.j] = r.w
    np.testing.assert_allclose(found, joint(d, 8), atol=1e-9)
    assert found.sum() == pytest.approx(1)
    # Equal distances share alike, whatever the perplexity; a node without neighbours has no part.
    same = spark.createDataFrame([(0, [1, 2], [0.0, 0.0]), (1, [0, 2], [2.0, 2.0]), (2, [], [])], "node long, j array<long>, d array<double>")
    assert {(r.i, r.j): r.w for r in embedding.affinities(same, 3, 1.0).collect() if r.i < r.j} == pytest.approx({(0, 1): 1 / 6, (0, 2): 1 / 12, (1, 2): 1 / 12})


def test_descent_equals_its_formula(spark):
    """Epochs of one part against the gradient of the divergence taken by differences."""
    draw = np.random.default_rng(8)
    y, d = draw.normal(size=(30, 2)), np.abs(draw.normal(size=(30, 30))) + 0.1
    p = joint((d + d.T) / 2, 5)
    start = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(y)], "node long, at array<double>")
    moved = np.array([r["at"] for r in embedding.stochastic_layout(links_of(spark, p), start, 30, 2, rounds=1, epochs=3).orderBy("node").collect()])
    speed, gain, at = np.zeros_like(y), np.ones_like(y), y.copy()
    for epoch in range(3):
        early = epoch < embedding.EARLY * 3
        q = 1 / (1 + ((at[:, None] - at[None]) ** 2).sum(-1))
        np.fill_diagonal(q, 0)
        slope = 4 * (((p * (12 if early else 1) - q / q.sum()) * q)[:, :, None] * (at[:, None] - at[None])).sum(1)
        if not early:
            by_difference = np.zeros_like(at)
            for i, c in [(0, 0), (7, 1), (29, 0)]:
                up, down = at.copy(), at.copy()
                up[i, c] += 1e-5
                down[i, c] -= 1e-5
                by_difference[i, c] = (divergence(p, up) - divergence(p, down)) / 2e-5
                assert slope[i, c] == pytest.approx(by_difference[i, c], rel=1e-4, abs=1e-8)
        gain = np.maximum(np.where(slope * speed < 0, gain + 0.2, gain * 0.8), 0.01)
        speed = np.clip((0.5 if early else 0.8) * speed - 50 * gain * slope, -4, 4)
        at += speed
    np.testing.assert_allclose(moved, at, atol=1e-9)


def test_stochastic_clusters_stay_apart_in_any_partitioning_and_in_many_parts(spark, monkeypatch):
    x, label = clusters()
    reduce = lambda v, **more: np.array([r[1:] for r in sorted(embedding.reduce_dimensions(v, "id", "v", "tSNE", perplexity=15.0, **more).collect())])
    one = reduce(table(spark, x))
    monkeypatch.setattr(embedding, "BLOCK", 64)
    many = reduce(table(spark, x))
    few = [reduce(v, rounds=3) for v in (table(spark, x), table(spark, x[::-1], 7).withColumn("id", 239 - F.col("id")))]
    np.testing.assert_allclose(*few, atol=1e-6)
    p = joint(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 15)
    for y in (one, many):
        d = ((y[:, None] - y[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, :10]
        assert (label[near] == label[:, None]).mean() > 0.97
        assert trustworthiness(x, y, 10) > 0.85
    assert divergence(p, many) < divergence(p, one) * 1.25


def test_stochastic_copies_nulls_odd_sizes_and_small_tables(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100 + i, [0.0, 0.0, 1.0]) for i in range(60)]
    odd = [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 0.0, 0.0]), (303, [1.0]), (None, [0.0, 0.0, 1.0])]
    out = embedding.stochastic_embedding(spark.createDataFrame(rows + odd, "`a b` long, v array<double>"), "a b", "v", perplexity=5.0, epochs=3)
    assert out.columns == ["a b", "e1", "e2"]
    found = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert len(found) == 125 and {found[i] for i in range(300, 304)} == {(None, None)}
    assert len({found[i] for i in [0, 35, *range(100, 160)]} | {found[None]}) == 1 and None not in found[0]
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [3.0, 4.0])], [(i, [float(i), 1.0]) for i in range(4)]):
        assert embedding.stochastic_embedding(spark.createDataFrame(few, "id long, v array<double>"), "id", "v", epochs=2).count() == len(few)


def test_smallest_columns_are_those_of_a_stable_sort():
    draw = np.random.default_rng(5)
    for far in (draw.standard_normal((40, 30)), draw.integers(0, 4, (40, 30)).astype(float), np.full((3, 1), np.inf), np.where(draw.random((40, 30)) < 0.5, np.nan, 1.0)):
        for most in {0, min(7, far.shape[1] - 1), far.shape[1] - 1}:
            assert (np.sort(embedding._smallest(far, most), 1) == np.sort(np.argsort(far, axis=1, kind="stable")[:, :most], 1)).all()


def test_neighbours_of_all_leaves_are_merged_in_one_sort(spark):
    """Equal to a set sorted by distance and node; the plan compares no structs of an array with one another, which was quadratic."""
    draw = np.random.default_rng(9)
    rows = [(i, [int(x) for x in draw.integers(0, 12, m)]) for i, m in enumerate([0, 1, 30, 7, 0, 12])]
    rows = [(i, j, [float(x % 5) for x in j]) for i, j in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))], ["node", "j", "d"])
    found = [r for part in embedding._merged(batch, 4, rows=4) for r in part.to_pylist()]
    assert [(r["node"], list(zip(r["d"], r["j"]))) for r in found] == [(i, sorted(set(zip(d, j)))[:4]) for i, j, d in rows]
    points, n, size = embedding.numbered(table(spark, draw.normal(size=(40, 3))), "id", "v", 16)
    graph = embedding.neighbour_graph(points, n, size, 5, trees=3, leaf=16)
    assert "array_distinct" not in graph._jdf.queryExecution().optimizedPlan().toString() and graph.count() == 40


def test_a_pair_repels_both_ways_at_once():
    draw = np.random.default_rng(10)
    for n, k in ((1, 2), (128, 2), (300, 3)):
        at, mean, count = draw.normal(size=(n, k)), draw.normal(size=(17, k)), draw.integers(1, 5, 17).astype(float)
        for others, weights, same in ((at, np.ones(n), True), (mean, count, False)):
            q = 1 / (1 + ((at[:, None] - others[None]) ** 2).sum(-1))
            if same:
                np.fill_diagonal(q, 0)
            z, push = embedding._repulsion(at, others, weights, same)
            np.testing.assert_allclose(z, q @ weights, atol=1e-12)
            np.testing.assert_allclose(push, ((q * q * weights)[:, :, None] * (at[:, None] - others[None])).sum(1), atol=1e-10)
