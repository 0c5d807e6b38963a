"""Communities, batches, streams that are summed once, and early stopping."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import graph, metrics, pairs, sampling
from tessera.streaming import PairSums


def quality(edges, group):
    """Modularity by hand."""
    total = 2 * sum(w for *_, w in edges)
    degree, inside = {}, 0
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
        inside += 2 * w if group[a] == group[b] else 0
    sums = {}
    for n, k in degree.items():
        sums[group[n]] = sums.get(group[n], 0) + k
    return inside / total - sum(s * s for s in sums.values()) / total**2


def best_by_brute_force(edges):
    nodes, best = sorted({n for a, b, _ in edges for n in (a, b)}), -1.0

    def parts(i, count):
        nonlocal best
        if i == len(nodes):
            best = max(best, quality(edges, group))
            return
        for g in range(count + 1):
            group[nodes[i]] = g
            parts(i + 1, max(count, g + 1))

    group = {}
    parts(0, 0)
    return best


def clique(nodes, w=1):
    return [(a, b, w) for a, b in itertools.combinations(nodes, 2)]


GRAPHS = {
    "two cliques and a bridge": [*clique([1, 2, 3, 4]), *clique([5, 6, 7, 8]), (4, 5, 1)],
    "weights part a ring": [(1, 2, 5), (2, 3, 1), (3, 4, 5), (4, 5, 1), (5, 6, 5), (6, 1, 1)],
    "star": [(0, i, 1) for i in range(1, 8)],
    "three triangles": [*clique([1, 2, 3]), *clique([4, 5, 6]), *clique([7, 8, 9]), (3, 4, 1), (6, 7, 1)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_communities_equal_brute_force(spark, name):
    edges, trace = GRAPHS[name], []
    frame = spark.createDataFrame(edges, "a long, b long, w long")
    group = {r.node: r.community for r in graph.communities(frame, weight="w", trace=trace).collect()}
    assert set(group) == {n for a, b, _ in edges for n in (a, b)}
    assert trace == sorted(trace)  # it never falls
    assert quality(edges, group) == pytest.approx(best_by_brute_force(edges)) and quality(edges, group) == pytest.approx(trace[-1])
    assert all(min(n for n in group if group[n] == c) == c for c in set(group.values()))


def test_communities_do_not_hang_on_partitions(spark):
    edges = [(i * 7 % 60, i * 11 % 60 // 4 * 4 + i % 4, 1 + i % 3) for i in range(150)]
    frame = spark.createDataFrame(edges, "a long, b long, w long")
    one, many = (sorted(map(tuple, graph.communities(f, weight="w").collect())) for f in (frame.coalesce(1), frame.repartition(6)))
    assert one == many


def test_communities_of_odd_edges(spark):
    odd = spark.createDataFrame([(1, 1, 1.0), (None, 2, 1.0), (3, 4, 0.0), (5, 6, None), (7, 8, -1.0), (9, 10, 2.0), (10, 9, 1.0)], "a long, b long, w double")
    assert sorted(map(tuple, graph.communities(odd, weight="w").collect())) == [(9, 9), (10, 9)]
    assert graph.communities(odd.limit(0), weight="w").collect() == []


def test_a_community_gives_many_nodes_in_a_turn(spark):
    edges = [e for i in range(1, 9) for e in clique([i, 10 * i, 10 * i + 1], 3)] + [(i, i + 1, 1) for i in range(1, 8)]
    group = {n: 0 if n < 10 else n // 10 * 10 for a, b, _ in edges for n in (a, b)}
    links = graph.links_of(spark.createDataFrame(edges, "a long, b long, w long"), "a", "b", "w")
    of = spark.createDataFrame(list(group.items()), "i long, c long")
    moves, left = graph._moves(links, links.groupBy("i").agg(F.sum("w").alias("k")).join(of, "i"), 2.0 * sum(w for *_, w in edges), 0)
    moved = {r.i: r.moved for r in moves.collect()}
    assert left and len(moved) > 4  # it was one node a turn
    assert quality(edges, group | moved) > quality(edges, group)


@pytest.mark.parametrize("name", GRAPHS)
def test_communities_by_joins_equal_brute_force(spark, name):
    """A graph of more links than a task holds is searched by joins."""
    edges, trace = GRAPHS[name], []
    group = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "a long, b long, w long"), weight="w", trace=trace, whole=0).collect()}
    assert trace == sorted(trace) and len(trace) > 1
    assert quality(edges, group) == pytest.approx(best_by_brute_force(edges)) and quality(edges, group) == pytest.approx(trace[-1])
    assert all(min(n for n in group if group[n] == c) == c for c in set(group.values()))


def clustered(parts, size):
    """Components of ``size`` nodes each, whose names are strewn."""
    return [(x * parts + p, y * parts + p, 1 + (x * y + p) % 4) for p in range(parts) for x in range(size) for y in range(x) if (x * y + p) % 5 == 0 or x // 6 == y // 6]


def test_communities_do_not_hang_on_what_a_task_holds(spark):
    """Components are searched apart or together, in numbers or names, with the same communities; a small graph isn't searched by joins."""
    edges = clustered(9, 18) + [(500, 501, 1), (502, 502, 3)]
    frame = spark.createDataFrame(edges, "a long, b long, w long")
    most = max(sum(2 for a, b, _ in edges if a != b and a % 9 == p) for p in range(9))
    one, apart = (sorted(map(tuple, graph.communities(f, weight="w", whole=n).collect())) for f, n in ((frame, 1 << 20), (frame.repartition(5), most)))
    assert one == apart and len({c for _, c in one}) > 9
    # Some components by joins, the others by tasks, and a search by joins that a task ends.
    uneven = edges + [(a, 9 * 18 + a % 9, 1) for a in range(0, 81, 9)] + [(9 * 18, 9 * 18 + 9 * k, 1) for k in range(1, 30)]
    group = dict(map(tuple, graph.communities(spark.createDataFrame(uneven, "a long, b long, w long"), weight="w", whole=most).collect()))
    assert set(group) == {n for a, b, _ in uneven for n in (a, b) if a != b} and all(group[n] == c for n, c in one if n % 9 and n < 9 * 18)
    words = spark.createDataFrame([(f"n{a:04}", f"n{b:04}", w) for a, b, w in edges], "a string, b string, w long")
    named = {int(r.node[1:]): int(r.community[1:]) for r in graph.communities(words, weight="w").collect()}
    assert set(named) == {n for n, _ in one} and quality([e for e in edges if e[0] != e[1]], named) > 0.98 * quality([e for e in edges if e[0] != e[1]], dict(one))


def test_modularity_never_falls_within_a_task():
    edges = clustered(2, 30)
    names = sorted({n for a, b, _ in edges for n in (a, b)})
    rows = sorted((names.index(x), names.index(y), float(w)) for a, b, w in edges for x, y in ((a, b), (b, a)))
    i, j, w = (np.array(c) for c in zip(*rows))
    trace = []
    found = graph._settle(i, j, w, np.arange(len(names)).astype(np.uint64) * np.uint64(7919), w.sum(), trace)
    measured = [quality(edges, dict(zip(names, map(int, c)))) for c in trace]
    assert len(measured) > 3 and all(b > a for a, b in itertools.pairwise(measured))
    assert quality(edges, dict(zip(names, map(int, found)))) == pytest.approx(measured[-1])


def test_edges_of_components_of_three_nodes_or_more(spark):
    edges = [(1, 2), (3, 4), (4, 5), (6, 6), (7, 8), (8, 7), (9, 9), (9, 10), (10, 11), (None, 4), (None, 1)]
    found = graph.in_threes(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(3, 4), (4, 5), (9, 10), (10, 11)]


def test_small_components_go(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4), (4, 5), (6, 6)], "a long, b long")
    assert sorted(map(tuple, graph.components(edges, least=3).collect())) == [(3, 3), (4, 3), (5, 3)]


# Batches -------------------------------------------------------------------------------------------


def batches_by_hand(lengths, budget):
    out, batch, room, width = [], -1, 0, 0
    for n, sample in sorted((-n, s) for s, n in lengths):
        if not room:
            batch, room, width = batch + 1, max(1, budget // max(1, -n)), -n
        out.append((sample, -n, batch, width))
        room -= 1
    return sorted(out)


@settings(max_examples=5, deadline=None)
@given(lengths=st.lists(st.integers(0, 30), min_size=1, max_size=60), budget=st.integers(1, 90))
def test_batches_equal_a_greedy_walk(spark, lengths, budget):
    rows = list(enumerate(lengths))
    found = sampling.batches(spark.createDataFrame(rows, "sample long, n long"), budget).collect()
    assert sorted(map(tuple, found)) == batches_by_hand(rows, budget)


# Streams -------------------------------------------------------------------------------------------


def tokens(spark, samples):
    return spark.createDataFrame([(s, f, float(s * f % 5)) for s in samples for f in range(4)], "sample long, feature long, a double")


def test_a_batch_sent_twice_changes_nothing(spark, tmp_path):
    sums = PairSums(spark, str(tmp_path / "sums"))
    assert sums.sums().collect() == []
    parts = [pairs.attention(tokens(spark, s), 2.0) for s in ([1, 2], [3], [4, 5])]
    assert [sums.merge(p, i) for i, p in enumerate(parts)] == [True] * 3
    once = sorted(map(tuple, sums.sums().collect()))
    assert sums.merge(parts[1], 1) is False and sorted(map(tuple, sums.sums().collect())) == once
    whole = sorted(map(tuple, pairs.accumulate(pairs.attention(tokens(spark, range(1, 6)), 2.0)).collect()))
    assert [(i, j, c) for i, j, _, c in once] == [(i, j, c) for i, j, _, c in whole] and all(math.isclose(a[2], b[2]) for a, b in zip(once, whole))
    sums.compact(2)
    again = sorted(map(tuple, sums.sums().collect()))
    assert [x[:2] + x[3:] for x in again] == [x[:2] + x[3:] for x in once] and sums.merge(parts[0], 0) is False
    assert sorted(p.name for p in (tmp_path / "sums").iterdir()) == ["batch-2", "upto-2"]


def test_a_batch_that_broke_off_counts_when_it_comes_again(spark, tmp_path):
    sums = PairSums(spark, str(tmp_path / "sums"))
    broken = pairs.attention(tokens(spark, [1]), 2.0).withColumn("w", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sums.merge(broken, 0)
    assert sums.sums().collect() == [] and sums.merge(pairs.attention(tokens(spark, [1]), 2.0), 0) and sums.sums().count() == 16


# Early stopping ------------------------------------------------------------------------------------


def test_best_epoch(spark):
    nan = float("nan")
    runs = {"falls": [3, 2, 1], "stops": [2.0, 1.0, 1.0, 0.95, 0.99, 0.1], "never": [nan, None, nan, 1.0], "late": [nan, 5.0, 6.0]}
    rows = [(r, e, x if x is None else float(x)) for r, values in runs.items() for e, x in enumerate(values, 1)]
    found = {r.run: tuple(r)[1:] for r in metrics.best_epoch(spark.createDataFrame(rows, "run string, epoch int, loss double"), 0.1, 3).collect()}
    assert found == {"falls": (3, 1.0, 3, False), "stops": (2, 1.0, 5, True), "never": (None, None, 3, True), "late": (2, 5.0, 3, False)}


def test_components_of_all_trusted_lines(spark):
    """The query links lines of 40 or more: the nodes are those of its own brute force, more than lines of 45 give."""
    from tessera import queries
    from tessera.plans import fixtures as fx

    d = "/root/testdata/sf0.01"
    sizes = {}
    for least in (40.0, 45.0):
        orders, parent = {}, {}
        for r in fx.evidence(spark, d, least).collect():
            orders.setdefault(r.t, set()).add(r.p)

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for own in orders.values():
            if 2 <= len(own) <= 4:
                for a, b in itertools.pairwise(sorted(own)):
                    parent[root(b)] = root(a)
        count = {}
        for x in list(parent):
            count[root(x)] = count.get(root(x), 0) + 1
        sizes[least] = sum(n for n in count.values() if n >= 3)
    assert queries.x_components(spark, d).count() == sizes[40.0] > sizes[45.0]


def test_communities_of_orders_of_any_size(spark):
    """The query links the parts of all orders, those of five parts and more too."""
    from tessera import queries
    from tessera.plans import fixtures as fx

    d, orders = "/root/testdata/sf0.01", {}
    for r in fx.evidence(spark, d, 20.0).collect():
        orders.setdefault(r.t, set()).add(r.p)
    nodes = {}
    for most in (4, 100):
        near = {}
        for own in orders.values():
            for a, b in itertools.permutations(own, 2) if len(own) <= most else ():
                near.setdefault(a, set()).add(b)
        nodes[most] = {a for a, others in near.items() if len(others) > 1 or any(len(near[b]) > 1 for b in others)}
    assert {r.node for r in queries.x_communities(spark, d).collect()} == nodes[100] > nodes[4]
