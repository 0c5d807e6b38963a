"""Layouts of vectors in few dimensions that keep neighbours together: neighbour graph, fuzzy weights, attraction and repulsion."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import ranges
from tessera.operators.vectors import pca
from tessera.sources.tables import ship, write_table

#: Vectors that are compared with one another in one task.
LEAF = 1024
#: Nodes that one task moves in a round.
PART = 2048
#: Nodes that repel in a round, about; they are sent to every task.
REPELLING = 4096
#: Repelling nodes that push a node in an epoch.
PUSHES = 5
#: A force moves a node by no more than this, before the step size.
CLIP = 4.0
#: The step size of the first epoch; it falls to 0 in a straight line.
STEP = 0.5
#: Nodes that one task of the stochastic embedding compares with one another; cells that stand for the nodes of other tasks, at most.
BLOCK, CELLS = 2048, 1024
#: The cells reach this many standard deviations to both sides of the mean; the outermost hold what lies beyond.
REACH = 2.5
#: Units of a place in the sums of a cell, and of a node's share in the sum over all pairs: sums of whole numbers don't hang on their order.
PLACE_UNITS, SHARE_UNITS = 1e6, 1e9
#: By how much attraction is exaggerated in the first epochs, which share of all epochs they are, and the momentum then and later.
EXAGGERATION, EARLY, MOMENTUM = 12.0, 0.4, (0.5, 0.8)


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """The (a, b) with which 1 / (1 + a d^2b) comes nearest to 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damp = np.array([0.0, 1.0]), 1e-3  # log a, b

    def miss(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(p[0]) * d ** (2 * p[1])) - want

    for _ in range(200):
        r, q = miss(p), np.exp(p[0]) * d ** (2 * p[1])
        slope = -q / (1 + q) ** 2
        jacobian = np.stack([slope, slope * 2 * np.log(d)], axis=1)
        square = jacobian.T @ jacobian
        step = np.linalg.solve(square + damp * np.eye(2), -jacobian.T @ r)
        better = np.sum(miss(p + step) ** 2) < np.sum(r**2)
        p, damp = (p + step, damp / 3) if better else (p, damp * 3)
    return float(np.exp(p[0])), float(p[1])


def _usable(vector: str, size: int) -> Column:
    """A vector of ``size`` components, none null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~odd, F.lit(False))


def _projected(points: DataFrame, trees: list[int], bits: int, size: int, seed: int) -> DataFrame:
    """(tree, side, along, *points): on which sides of ``bits`` planes a point lies in each tree, and its place along one more direction."""
    extra = [T.StructField("tree", T.IntegerType()), T.StructField("side", T.LongType()), T.StructField("along", T.DoubleType())]
    planes = np.stack([np.random.default_rng((seed, t)).standard_normal((bits + 1, size)) for t in trees])
    centre = points.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.round(F.avg("x"), 6).alias("x")).orderBy("at").collect()
    middle = np.array([row.x for row in centre])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            x = np.stack(frame["v"].to_list()) - middle
            for t, plane in zip(trees, planes):
                y = np.einsum("nd,pd->np", x, plane)
                side = (y[:, :bits] > 0) @ (1 << np.arange(bits)[::-1]) if bits else np.zeros(len(x), int)
                yield frame.assign(tree=t, side=side, along=np.round(y[:, bits], 9))

    return points.mapInPandas(run, T.StructType([*points.schema, *extra]))


def numbered(vectors: DataFrame, key: str, vector: str, leaf: int = LEAF, seed: int = 42) -> tuple[DataFrame, int, int]:
    """((node, v) of the distinct usable vectors, their number, their size); nodes are numbers from 0, near vectors have near ones.

    The size is the most frequent one (ties to the smaller).  Copies are one node, so no group of copies meets in a task.
    """
    sizes = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = sizes.size if sizes else 0
    distinct = vectors.where(_usable(vector, size)).select(F.transform(vector, lambda x: x.cast("double")).alias("v")).distinct()
    points = write_table(distinct.select(F.sha2(F.array_join("v", ","), 256).alias("name"), "v"), "points")
    n = points.count()
    if not n:
        return points.select(F.lit(0).cast("long").alias("node"), "v"), 0, size
    coded = _projected(points, [0], _bits(n, leaf), size, seed)
    return write_table(ranges.place(coded, ["side", "along", "name"], "node").select("node", "v"), "points"), n, size


def _bits(n: int, leaf: int) -> int:
    return min(40, max(0, int(np.ceil(np.log2(n / leaf)))))


def _smallest(far: np.ndarray, most: int) -> np.ndarray:
    """The columns of the ``most`` smallest values of each row, in any order, ties to smaller columns; only rows with a tie at the edge are sorted."""
    edge = max(most, 1) - 1
    near = np.argpartition(far, edge, axis=1)
    tied = (far <= np.take_along_axis(far, near[:, edge : edge + 1], 1)).sum(1) != most
    near = near[:, :most]
    if tied.any():
        near[tied] = np.argsort(far[tied], axis=1, kind="stable")[:, :most]
    return near


def neighbour_graph(points: DataFrame, n: int, size: int, k: int, trees: int = 8, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """(node, j array, d array): the ``k`` nearest others found of each node by Euclidean distance, nearest first, ties to smaller nodes.

    ``points`` (node, v) are numbered from 0 in the order of a first random projection tree.  Each tree cuts its order into
    leaves of ``leaf`` nodes, whatever the density, and compares within them: exact where all nodes are one leaf,
    else approximate, and better with more trees or larger leaves.
    """
    trees = 1 if n <= leaf else trees
    first = points.select(F.lit(0).alias("tree"), F.floor(F.col("node") / leaf).alias("leaf"), "node", "v")
    leaves = first
    if trees > 1:
        coded = _projected(points, list(range(1, trees)), _bits(n, leaf), size, seed)
        placed = ranges.place(coded, ["side", "along", "node"], "place", ["tree"])
        leaves = first.unionByName(placed.select("tree", F.floor(F.col("place") / leaf).alias("leaf"), "node", "v"))

    def nearest(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        node, x = frame["node"].to_numpy(), np.stack(frame["v"].to_list())
        most, norms, js, ds = min(k, len(node) - 1), np.einsum("nd,nd->n", x, x), [], []
        for lo in range(0, len(node), 64):
            rows = np.arange(lo, min(lo + 64, len(node)))
            far = norms - 2 * x[rows] @ x.T
            far[np.arange(len(rows)), rows] = np.inf
            near = _smallest(far, most)
            gap = x[near] - x[rows, None]
            dist = np.sqrt((gap * gap).sum(-1))
            order = np.lexsort((node[near], dist), axis=1)
            js += list(node[np.take_along_axis(near, order, 1)])
            ds += list(np.take_along_axis(dist, order, 1))
        return pd.DataFrame({"node": node, "j": js, "d": ds})

    found = leaves.groupBy("tree", "leaf").applyInPandas(nearest, "node long, j array<long>, d array<double>")
    met = found.groupBy("node").agg(F.flatten(F.collect_list("j")).alias("j"), F.flatten(F.collect_list("d")).alias("d"))
    return met.mapInArrow(lambda batches: (near for batch in batches for near in _merged(batch, k)), "node long, j array<long>, d array<double>")


def _merged(batch: pa.RecordBatch, k: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of each node among those that its leaves gave, some nodes at a time; one sort serves them all, as distinct arrays of structs are quadratic."""
    for lo in range(0, batch.num_rows, rows):
        node, js, ds = batch.slice(lo, rows).columns
        n = len(node)
        owner = np.repeat(np.arange(n), js.value_lengths().to_numpy())
        j, d = js.flatten().to_numpy(), ds.flatten().to_numpy()
        order = np.lexsort((j, d, owner))
        owner, j, d = owner[order], j[order], d[order]
        new = np.ones(len(j), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (j[1:] != j[:-1]) | (d[1:] != d[:-1])
        owner, j, d = owner[new], j[new], d[new]
        kept = np.arange(len(j)) - np.searchsorted(owner, np.arange(n))[owner] < k
        ends = pa.array(np.append(0, np.cumsum(np.bincount(owner[kept], minlength=n))), pa.int32())
        yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(ends, pa.array(j[kept])), pa.ListArray.from_arrays(ends, pa.array(d[kept]))], ["node", "j", "d"])


def fuzzy_weights(graph: DataFrame, k: int) -> DataFrame:
    """(i, j, w), both directions: how surely two nodes are neighbours, by either one's own scale.

    From a node, the nearest is sure, and weights fall with the distance beyond it so that they sum to log2(``k``);
    the two directions of a pair are joined as probabilities, a + b - ab.
    """

    @F.pandas_udf("array<double>")
    def weights(distances: pd.Series) -> pd.Series:
        if distances.empty:
            return pd.Series([], dtype=object)
        width = np.array([len(d) for d in distances])
        d = np.full((len(width), max(1, width.max())), np.inf)
        for row, found in zip(d, distances):
            row[: len(found)] = found
        beyond = d - d[:, :1]
        low, high = np.zeros(len(d)), np.full(len(d), np.inf)
        scale = np.ones(len(d))
        for _ in range(64):
            over = np.exp(-beyond / scale[:, None]).sum(1) > np.log2(k)
            high, low = np.where(over, scale, high), np.where(over, low, scale)
            scale = np.clip(np.where(np.isinf(high), low * 2, (low + high) / 2), 1e-12, 1e12)
        w = np.exp(-beyond / scale[:, None])
        return pd.Series([r[:n] for r, n in zip(w, width)])

    one = graph.where(F.size("j") > 0).select("node", F.explode(F.arrays_zip("j", weights("d").alias("w"))).alias("x")).select("node", F.col("x.j").alias("j"), F.col("x.w").alias("w"))
    both = one.groupBy(F.least("node", "j").alias("i"), F.greatest("node", "j").alias("j")).agg(F.max("w").alias("a"), F.min("w").alias("b"), F.count("*").alias("n"))
    pair = both.select("i", "j", F.when(F.col("n") == 2, F.col("a") + F.col("b") - F.col("a") * F.col("b")).otherwise(F.col("a")).alias("w"))
    return pair.select("i", "j", "w").unionByName(pair.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def layout(links: DataFrame, start: DataFrame, n: int, min_dist: float = 0.3, rounds: int = 10, epochs: int = 20, most: int = 256, seed: int = 42) -> DataFrame:
    """(node, at): places where linked nodes attract and others repel, from ``start`` (node, at array).

    A round deals nodes into parts of ``PART`` by number (every other round shifted by half a part).  A task moves the
    nodes of one part for ``epochs`` epochs; ends of links outside it stay where the round found them.  Nodes push
    away from a hash sample of about ``REPELLING`` nodes, new in every round.  Of a node with more than ``most`` links, about
    that many, chosen anew by hash, pull in a round, so that no task holds a hub's links.
    """
    a, b = curve(min_dist)
    total = rounds * epochs
    kept = links.where(F.col("w") * total >= 1)
    share = kept.groupBy("i").agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count("*")).alias("share"))
    pulls = write_table(kept.join(share, "i"), "pulls")
    state = start
    for turn in range(rounds):
        part = F.floor((F.col("node") + (turn % 2) * (PART // 2)) / PART)
        every = -(-n // REPELLING)
        sample = state.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "node"), F.lit(every)) == 0).orderBy("node").collect()
        names, pushing = np.array([r.node for r in sample], dtype=np.int64), np.array([r["at"] for r in sample])
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "i", "j"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        ends = pulls.where(drawn).join(state.select(F.col("node").alias("j"), F.col("at").alias("end")), "j").select(F.col("i").alias("node"), "j", "w", "end")

        def move(key: tuple, own: pd.DataFrame, ends: pd.DataFrame, *, turn=turn, names=names, pushing=pushing) -> pd.DataFrame:
            if own.empty:
                return pd.DataFrame({"node": [], "at": []})
            own, ends = own.sort_values("node"), ends.sort_values(["node", "j"])
            node, at = own["node"].to_numpy(), np.stack(own["at"].to_list()).astype(float)
            draw = np.random.default_rng((seed, turn, int(key[0])))
            i = np.searchsorted(node, ends["node"].to_numpy())
            j = ends["j"].to_numpy()
            slot = np.minimum(np.searchsorted(node, j), len(node) - 1)
            inside = node[slot] == j
            w = ends["w"].to_numpy()
            weight = np.maximum(np.bincount(i, w, len(node)), 1e-12)
            other = np.stack(ends["end"].to_list()).astype(float) if len(ends) else np.zeros((0, at.shape[1]))
            for epoch in range(epochs):
                other[inside] = at[slot[inside]]
                gap = other - at[i]
                square = (gap * gap).sum(1)
                power = np.where(square > 0, square, 1.0) ** (b - 1)
                pull = np.where(square > 0, 2 * a * b * power / (1 + a * power * square), 0.0)
                force = np.clip(gap * pull[:, None], -CLIP, CLIP) * w[:, None]
                step = np.stack([np.bincount(i, f, len(node)) for f in force.T], axis=1) / weight[:, None]
                if len(names):
                    chosen = draw.integers(0, len(names), (len(node), PUSHES))
                    apart = at[:, None] - pushing[chosen]
                    square = (apart * apart).sum(-1)
                    push = np.where(names[chosen] == node[:, None], 0.0, 2 * b / ((0.001 + square) * (1 + a * square**b)))
                    step += np.clip(apart * push[..., None], -CLIP, CLIP).sum(1) / 2
                at += step * STEP * (1 - (turn * epochs + epoch) / total)
            return pd.DataFrame({"node": node, "at": list(at)})

        moved = state.groupBy(part.alias("part")).cogroup(ends.groupBy(part.alias("part"))).applyInPandas(move, "node long, at array<double>")
        state = write_table(moved, "layout")
    return state


def neighbour_embedding(
    vectors: DataFrame, key: str, vector: str, k: int = 2, neighbours: int = 75, min_dist: float = 0.3, seed: int = 42, rounds: int = 10, epochs: int = 20, leaf: int = LEAF
) -> DataFrame:
    """(key, e1..ek): places in ``k`` dimensions that keep the neighbours of the vectors, started from principal components.

    Every row of ``vectors`` is in the result; copies share a place.  Vectors that are null, hold a null or non-finite component or
    aren't of the most frequent size have null places.  Equal inputs give equal places in any partitioning.
    """
    ship(vectors.sparkSession)
    points, n, size = numbered(vectors, key, vector, leaf, seed)
    if n > k and size >= k:
        near = min(neighbours, n - 1)
        graph = write_table(neighbour_graph(points, n, size, near, leaf=leaf, seed=seed), "graph")
        first = pca(points, "node", "v", k)
        names = [f"pc{i + 1}" for i in range(k)]
        widest = first.agg(F.greatest(*[F.max(F.abs(c)) for c in names], F.lit(1e-9)).alias("m")).first().m if k > 1 else first.agg(F.max(F.abs("pc1")).alias("m")).first().m
        start = first.select("node", F.array(*[F.round(F.col(c) * (10 / max(widest, 1e-9)), 4) for c in names]).alias("at"))
        state = layout(fuzzy_weights(graph, near), write_table(start, "layout"), n, min_dist, rounds, epochs, seed=seed)
    else:
        state = points.select("node", F.array(*[F.col("node").cast("double")] * k).alias("at"))
    return _placed(vectors, key, vector, size, points, state, k)


def _placed(vectors: DataFrame, key: str, vector: str, size: int, points: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """(key, e1..ek): every row of ``vectors`` with the place of its point, null where it has none."""
    value = f"v_{uuid4().hex}"
    placed = points.join(state, "node").select(F.col("v").alias(value), "at")
    asked = vectors.select(F.col(f"`{key}`"), F.when(_usable(vector, size), F.transform(vector, lambda x: x.cast("double"))).alias(value))
    return asked.join(placed, value, "left").select(f"`{key}`", *[F.col("at")[i].alias(f"e{i + 1}") for i in range(k)])


def affinities(graph: DataFrame, n: int, perplexity: float) -> DataFrame:
    """(i, j, w), both directions: the joint probabilities of ``n`` points, over each one's neighbours in ``graph``; they sum to 1.

    From a node, probabilities fall with the squared distance at the rate that gives them the entropy of
    ``perplexity`` equal ones; the two directions of a pair are averaged.
    """

    @F.pandas_udf("array<double>")
    def shares(distances: pd.Series) -> pd.Series:
        if distances.empty:
            return pd.Series([], dtype=object)
        width = np.array([len(d) for d in distances])
        there = np.arange(max(1, width.max())) < width[:, None]
        d = np.zeros(there.shape)
        d[there] = np.concatenate(distances.to_list())
        square = np.where(there, d * d - d[:, :1] ** 2, 0.0)
        square /= np.maximum(square.sum(1) / np.maximum(width, 1), 1e-300)[:, None]
        low, high, rate = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        for _ in range(64):
            e = np.exp(-rate[:, None] * square) * there
            total = np.maximum(e.sum(1), 1e-300)
            flat = np.log(total) + rate * (e * square).sum(1) / total > np.log(perplexity)
            low, high = np.where(flat, rate, low), np.where(flat, high, rate)
            rate = np.clip(np.where(np.isinf(high), low * 2, (low + high) / 2), 1e-12, 1e12)
        e = np.exp(-rate[:, None] * square) * there
        e /= np.maximum(e.sum(1), 1e-300)[:, None]
        return pd.Series([r[:m] for r, m in zip(e, width)])

    one = graph.where(F.size("j") > 0).select("node", F.explode(F.arrays_zip("j", shares("d").alias("w"))).alias("x")).select("node", F.col("x.j").alias("j"), F.col("x.w").alias("w"))
    pair = one.groupBy(F.least("node", "j").alias("i"), F.greatest("node", "j").alias("j")).agg((F.sum("w") / (2.0 * n)).alias("w"))
    return pair.unionByName(pair.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def _repulsion(at: np.ndarray, others: np.ndarray, count: np.ndarray, same: bool, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(sum of similarities, sum of pushes before they are divided by that of all pairs) of each place by the ``count`` nodes at each of the others.

    ``same``: the others are the places themselves, and none pushes itself.  A few rows at a time stay in the processor's cache.
    """
    if same:
        return _own_repulsion(at, rows)
    z, sums, norms = np.empty(len(at)), np.empty((len(at), at.shape[1] + 1)), (others * others).sum(1)
    weights, turned = np.column_stack([count, others * count[:, None]]), -2 * others.T
    for lo in range(0, len(at), rows):
        a = at[lo : lo + rows]
        q = a @ turned
        q += norms
        q += (a * a).sum(1)[:, None]
        np.maximum(q, 0, out=q)
        q += 1
        np.reciprocal(q, out=q)
        z[lo : lo + rows] = q @ count
        q *= q
        sums[lo : lo + rows] = q @ weights
    return z, at * sums[:, :1] - sums[:, 1:]


def _own_repulsion(at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``_repulsion`` of places by one another: each pair is worked out once, for both."""
    z, sums, norms = np.zeros(len(at)), np.zeros((len(at), at.shape[1] + 1)), (at * at).sum(1)
    weights, turned = np.column_stack([np.ones(len(at)), at]), -2 * at.T
    for lo in range(0, len(at), rows):
        n = min(rows, len(at) - lo)
        q = at[lo : lo + n] @ turned[:, lo:]
        q += norms[lo:]
        q += norms[lo : lo + n, None]
        np.maximum(q, 0, out=q)
        q += 1
        np.reciprocal(q, out=q)
        q[np.arange(n), np.arange(n)] = 0
        z[lo : lo + n] += q.sum(1)
        z[lo + n :] += q[:, n:].sum(0)
        q *= q
        sums[lo : lo + n] += q @ weights[lo:]
        sums[lo + n :] += q[:, n:].T @ weights[lo : lo + n]
    return z, at * sums[:, :1] - sums[:, 1:]


def stochastic_layout(links: DataFrame, start: DataFrame, n: int, k: int, rounds: int = 50, epochs: int = 10, most: int = 512, seed: int = 42) -> DataFrame:
    """(node, at): places whose Student-t similarities come near the probabilities ``links`` (i, j, w), by descent on their divergence.

    A round deals nodes into parts of ``BLOCK`` by number (every other round shifted by half a part).  A task moves one part for ``epochs``
    epochs: its nodes repel one another exactly, those of other parts by the counts and means of at most ``CELLS`` cells of the layout, which
    are the only thing that goes through the driver; a part's own nodes are taken out of them first.  The sum over all pairs follows
    the part's share of it.  Up to ``BLOCK`` nodes are one part, and the descent is exact.  Of a node with more than
    ``most`` links about that many, chosen anew by hash in every round and weighted up, pull, so that no task holds a hub's links.
    """
    total = rounds * epochs
    if n <= BLOCK:
        rounds, epochs = 1, total
    rate = max(n / EXAGGERATION / 4, 50.0)
    share = links.groupBy("i").agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count("*")).alias("share"))
    pulls = write_table(links.join(share, "i"), "pulls")
    zeros = F.array(*[F.lit(0.0)] * k)
    state = start.select("node", "at", zeros.alias("speed"), F.transform(zeros, lambda x: x + 1.0).alias("gain"), F.lit(float(n - 1)).alias("z"))
    side = int(round(CELLS ** (1 / k) - 0.5 + 1e-9))
    for turn in range(rounds):
        low, wide, cells = np.zeros(k), np.ones(k), {}
        all_pairs = float(n) * (n - 1)
        if rounds > 1:
            z = F.sum(F.rint(F.col("z") / n * SHARE_UNITS).cast("long")).alias("z")
            bounds = state.agg(z, *[F.round(f(F.col("at")[d]), 9).alias(f"{m}{d}") for d in range(k) for m, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
            all_pairs = bounds.z / SHARE_UNITS * n
            wide = np.array([max(2 * REACH * bounds[f"std{d}"], 1e-9) / side for d in range(k)])
            low = np.array([bounds[f"mean{d}"] for d in range(k)]) - wide * side / 2
            cell = [F.greatest(F.lit(0), F.least(F.floor((F.col("at")[d] - F.lit(float(low[d]))) / F.lit(float(wide[d]))), F.lit(side - 1))) for d in range(k)]
            sums = [F.sum(F.rint(F.col("at")[d] * PLACE_UNITS).cast("long")).alias(f"s{d}") for d in range(k)]
            cells = {tuple(r[:k]): np.array(r[k:]) for r in state.groupBy(*[c.alias(f"c{d}") for d, c in enumerate(cell)]).agg(F.count("*").alias("n"), *sums).collect()}
        part = F.floor((F.col("node") + (turn % 2) * (BLOCK // 2)) / BLOCK)
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "i", "j"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        there = state.select(F.col("node").alias("j"), *[F.col("at")[d].alias(f"end{d}") for d in range(k)])  # plain columns: arrays are objects in pandas
        ends = pulls.where(drawn).join(there, "j").select(F.col("i").alias("node"), "j", (F.col("w") / F.col("share")).alias("w"), *there.columns[1:])

        def others(at: np.ndarray, *, low=low, wide=wide, cells=cells) -> tuple[np.ndarray, np.ndarray]:
            """(count, mean) of the cells without the nodes at ``at``."""
            if not cells:
                return np.zeros(0), np.zeros((0, k))
            at_cell = np.clip(np.floor((at - low) / wide), 0, side - 1).astype(np.int64)
            own = np.column_stack([np.ones(len(at), np.int64), np.rint(at * PLACE_UNITS).astype(np.int64)])
            rest = {c: sums.copy() for c, sums in cells.items()}
            for c, mine in zip(map(tuple, at_cell.tolist()), own):
                rest[c] -= mine
            left = np.array([v for _, v in sorted(rest.items()) if v[0] > 0]).reshape(-1, k + 1)
            return left[:, 0].astype(float), left[:, 1:] / left[:, :1] / PLACE_UNITS

        def move(own: pd.DataFrame, ends: pd.DataFrame, *, turn=turn, all_pairs=all_pairs, others=others) -> pd.DataFrame:
            if own.empty:
                return pd.DataFrame({c: [] for c in ("node", "at", "speed", "gain", "z")})
            own = own.sort_values("node")
            node, z = own["node"].to_numpy(), own["z"].to_numpy()
            at, speed, gain = (np.stack(own[c].to_list()).astype(float) for c in ("at", "speed", "gain"))
            count, mean = others(at)
            scale = all_pairs / max(z.sum(), 1e-300)
            i, j = np.searchsorted(node, ends["node"].to_numpy()), ends["j"].to_numpy()
            order = np.lexsort((j, i))
            i, j, w, other = i[order], j[order], ends["w"].to_numpy()[order], [ends[f"end{d}"].to_numpy()[order] for d in range(k)]
            slot = np.minimum(np.searchsorted(node, j), len(node) - 1)
            inside = np.flatnonzero(node[slot] == j)
            slot = slot[inside]
            for epoch in range(turn * epochs, (turn + 1) * epochs):
                early = epoch < EARLY * total
                gaps, weight = [], 1.0
                for x, end in zip(np.ascontiguousarray(at.T), other):
                    end[inside] = x[slot]
                    gaps.append(x[i] - end)
                    weight = weight + gaps[-1] * gaps[-1]
                weight = w / weight
                pull = np.stack([np.bincount(i, gap * weight, len(node)) for gap in gaps], axis=1)
                z, push = _repulsion(at, at, np.ones(len(at)), True)
                if len(count):
                    far, more = _repulsion(at, mean, count, False)
                    z, push = z + far, push + more
                slope = 4 * ((EXAGGERATION if early else 1) * pull - push / max(z.sum() * scale, 1e-300))
                gain = np.maximum(np.where(slope * speed < 0, gain + 0.2, gain * 0.8), 0.01)
                speed = np.clip(MOMENTUM[not early] * speed - rate * gain * slope, -CLIP, CLIP)
                at += speed
            return pd.DataFrame({"node": node, "at": list(at), "speed": list(speed), "gain": list(gain), "z": z})

        moved = state.groupBy(part.alias("part")).cogroup(ends.groupBy(part.alias("part"))).applyInPandas(move, "node long, at array<double>, speed array<double>, gain array<double>, z double")
        state = write_table(moved, "layout")
    return state.select("node", "at")


def stochastic_embedding(
    vectors: DataFrame, key: str, vector: str, k: int = 2, perplexity: float = 30.0, seed: int = 42, rounds: int = 50, epochs: int = 10, leaf: int = LEAF
) -> DataFrame:
    """(key, e1..ek): t-distributed stochastic neighbour embedding over three times ``perplexity`` neighbours, started from principal components.

    Rows, copies and unusable vectors are dealt with as in ``neighbour_embedding``.  The perplexity is at most a third of the number of
    other points.  Equal inputs give equal places in any partitioning.
    """
    ship(vectors.sparkSession)
    points, n, size = numbered(vectors, key, vector, leaf, seed)
    if n > k and size >= k:
        near = min(int(3 * perplexity), n - 1)
        graph = write_table(neighbour_graph(points, n, size, near, leaf=leaf, seed=seed), "graph")
        first = pca(points, "node", "v", k)
        spread = first.agg(F.stddev_pop("pc1").alias("s")).first().s
        # Points of equal components start a little apart.
        apart = [F.pmod(F.xxhash64(F.lit(seed), F.lit(d), "node"), F.lit(1001)) / 1001 * 1e-6 for d in range(k)]
        start = first.select("node", F.array(*[F.round(F.col(f"pc{d + 1}") * (1e-4 / max(spread, 1e-9)), 9) + apart[d] for d in range(k)]).alias("at"))
        state = stochastic_layout(affinities(graph, n, max(1.0, min(perplexity, near / 3))), write_table(start, "layout"), n, k, rounds, epochs, seed=seed)
    else:
        state = points.select("node", F.array(*[F.col("node").cast("double")] * k).alias("at"))
    return _placed(vectors, key, vector, size, points, state, k)


REDUCERS = {"pca": pca, "tsne": stochastic_embedding, "umap": neighbour_embedding}


def reduce_dimensions(vectors: DataFrame, key: str, vector: str, method: str = "umap", k: int = 2, **kwargs) -> DataFrame:
    """``vectors`` in ``k`` dimensions by ``method`` (any case): ``pca``, or ``tsne`` or ``umap``, which take the options of ``stochastic_embedding`` and ``neighbour_embedding``."""
    if method.lower() not in REDUCERS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(REDUCERS)}")
    return REDUCERS[method.lower()](vectors, key, vector, k, **kwargs)
