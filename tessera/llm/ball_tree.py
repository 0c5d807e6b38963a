"""Centroid clustering of integer vectors, filtered through partition-local ball trees.

Components become integers (floor of ``scale`` times the component), so sums and squared distances are
exact and no order of adding matters.  Vectors are gathered in blocks where they are read, and each block gets a
metric tree: a node (a ball) has the radius, the count and the integer sum of its vectors; its centre is their mean.
In a round a ball goes whole to a centroid when the triangle inequality puts every other one farther from all
of its vectors; else its halves are asked, down to leaves, whose vectors are compared exactly.  The trees are built
once and written; a round reads them and brings back one row a task and centroid, so only centroids (``k`` of them)
reach the driver.

Vectors of another width than ``width``, null ones, and ones with a null or non-finite component take no part, nor do
ones with a component of 2**27 or more after scaling, whose squared distance would pass 64 bits.  A row with a null
id is assigned like the others.  Repeated rows are assigned alike.  Centroids that start equal tie to the
smaller number; an empty one stays as it is.  Fewer vectors than ``k`` make fewer centroids; none make an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import arrow_map, prepare, write_table

#: Vectors of a block, and of a leaf.
BLOCK, LEAF = 1024, 16
#: Components below it have squared distances within 64 bits; below the other one a product of doubles is exact.
LARGEST, EXACT = 1 << 27, 1 << 22


class Tree:
    """A ball tree over the rows of ``points`` (reordered so that every node is a run)."""

    def __init__(self, points: np.ndarray) -> None:
        order = np.arange(len(points))
        lo, hi, left = [0], [len(points)], [-1]
        at = 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            run = points[order[a:b]]
            spread = run.max(0) - run.min(0)
            widest = int(spread.argmax())
            if b - a > LEAF and spread[widest] > 0:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(run[:, widest], half)]
                left[at] = len(lo)
                lo += [a, a + half]
                hi += [a + half, b]
                left += [-1, -1]
            at += 1
        self.order = order
        self.points = points[order]
        self.lo, self.hi, self.left = np.array(lo, np.int32), np.array(hi, np.int32), np.array(left, np.int32)
        self.sums = np.array([self.points[a:b].sum(0) for a, b in zip(lo, hi)], np.int64)
        centres = self.sums / (self.hi - self.lo)[:, None]
        self.radius = np.array([np.sqrt(((self.points[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(lo, hi, centres)])

    FIELDS = (("points", np.int64), ("lo", np.int32), ("hi", np.int32), ("left", np.int32), ("sums", np.int64), ("radius", np.float64))

    def parts(self) -> list[bytes]:
        return [getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS]

    @classmethod
    def read(cls, parts: list[bytes], width: int) -> Tree:
        tree = cls.__new__(cls)
        for (name, kind), part in zip(cls.FIELDS, parts):
            setattr(tree, name, np.frombuffer(part, kind))
        tree.points, tree.sums = tree.points.reshape(-1, width), tree.sums.reshape(-1, width)
        return tree

    def assign(self, centroids: np.ndarray, whole: Callable[[int, int, int, int], None], exact: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """``whole(node, lo, hi, centroid)`` for each ball that goes whole, ``exact(rows, centroids)`` for the rows of leaves."""
        goal = centroids.astype(np.float64)
        front = np.zeros(1, np.int64)
        rows: list[np.ndarray] = []
        while len(front):
            centres = self.sums[front] / (self.hi[front] - self.lo[front])[:, None]
            d = np.sqrt(((centres[:, None, :] - goal) ** 2).sum(2))
            best = d.argmin(1)
            nearest = d[np.arange(len(front)), best]
            d[np.arange(len(front)), best] = np.inf
            second = d.min(1)
            # Strictly farther even at the ball's edge, with room for rounding: ties are left to the leaves.
            slack = 1e-9 * (nearest + self.radius[front] + 1)
            inside = second - nearest > 2 * self.radius[front] + slack
            for node, c in zip(front[inside], best[inside]):
                whole(int(node), int(self.lo[node]), int(self.hi[node]), int(c))
            front = front[~inside]
            leaves = front[self.left[front] < 0]
            rows += [np.arange(self.lo[n], self.hi[n]) for n in leaves]
            inner = self.left[front[self.left[front] >= 0]].astype(np.int64)
            front = np.concatenate([inner, inner + 1])
        if rows:
            at = np.concatenate(rows)
            exact(at, nearest_of(self.points[at], centroids))


def nearest_of(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point by exact squared distance, ties to the smaller number."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:  # every step is a whole number below 2**53
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((c * c).sum(1) - 2 * (p @ c.T)).argmin(1)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1).argmin(1)


def kept(rows: DataFrame, id_col: str, vec_col: str, width: int, scale: float) -> DataFrame:
    """(id, v): the vectors that take part, as integers."""
    valid = (F.size(vec_col) == width) & F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float(LARGEST)))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(F.col(vec_col).isNotNull() & F.coalesce(valid, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def plant(vectors: DataFrame, width: int) -> DataFrame:
    """(ids, and a tree's arrays) a row a block of up to ``BLOCK`` vectors of one partition."""
    kind = vectors.schema["id"].dataType.simpleString()
    names = [name for name, _ in Tree.FIELDS]

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def grow(least: int) -> Iterator[pa.RecordBatch]:
            while sum(len(x) for _, x in held) >= least and held:
                ids, points = pa.concat_arrays([i for i, _ in held]), np.concatenate([x for _, x in held])
                held[:] = [(ids.slice(BLOCK), points[BLOCK:])] if len(points) > BLOCK else []
                tree = Tree(points[:BLOCK])
                own = ids.slice(0, BLOCK).take(pa.array(tree.order))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *[pa.array([p], pa.binary()) for p in tree.parts()]], ["ids", *names])

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            held.append((batch.column(0), matrix(batch.column(1), width)))
            yield from grow(BLOCK)

        step.end = lambda: grow(1)
        return step

    return arrow_map(vectors, ", ".join([f"ids array<{kind}>", *[f"{n} binary" for n in names]]), start)


def trees_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].values, Tree.read([batch.column(n)[i].as_py() for n, _ in Tree.FIELDS], width)


def totals(planted: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sums) of the vectors of each centroid."""
    k, width = centroids.shape
    schema = StructType([StructField("c", LongType()), StructField("n", LongType()), *[StructField(f"s{i}", LongType()) for i in range(width)]])

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, tree in trees_of(batch, width):

                def whole(node: int, lo: int, hi: int, c: int) -> None:
                    count[c] += hi - lo
                    sums[c] += tree.sums[node]

                def exact(rows: np.ndarray, to: np.ndarray) -> None:
                    np.add(count, np.bincount(to, minlength=k), out=count)
                    np.add.at(sums, to, tree.points[rows])

                tree.assign(centroids, whole, exact)
            yield from ()

        def end() -> Iterator[pa.RecordBatch]:
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), *[pa.array(s) for s in sums[met].T]], schema.names)

        step.end = end
        return step

    merged = arrow_map(planted, schema, start).groupBy("c").agg(*[F.sum(n).alias(n) for n in schema.names[1:]]).collect()  # k rows at most
    count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in merged:
        count[r.c], sums[r.c] = r.n, r[2:]
    return count, sums


def assignments(planted: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    width = centroids.shape[1]
    kind = planted.schema["ids"].dataType.elementType.simpleString()

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for ids, tree in trees_of(batch, width):
                to = np.zeros(len(ids), np.int32)

                def whole(node: int, lo: int, hi: int, c: int) -> None:
                    to[lo:hi] = c

                def exact(rows: np.ndarray, own: np.ndarray) -> None:
                    to[rows] = own

                tree.assign(centroids, whole, exact)
                distance = ((tree.points - centroids[to]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(to), pa.array(distance)], ["id", "cluster", "distance"])

        return step

    return arrow_map(planted, f"id {kind}, cluster int, distance long", start)


def centroids_of(vectors: DataFrame, k: int, seed: str, width: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of their ids (a null id as no text), equal ones by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in vectors.orderBy(key, "v").limit(k).collect()], np.int64).reshape(-1, width)


def cluster(rows: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vec_col: str = "embedding", width: int = 64, scale: float = 256.0, seed: str = "2") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) a vector, after ``rounds`` rounds and a last assignment.

    An inertia beyond 64 bits is null.
    """
    spark: SparkSession = prepare(rows.sparkSession)
    vectors = kept(rows, id_col, vec_col, width, scale)
    centroids = centroids_of(vectors, k, seed, width)
    if not len(centroids):
        return spark.createDataFrame([], StructType([StructField(id_col, rows.schema[id_col].dataType)])).selectExpr(f"`{id_col}`", "cast(null as int) cluster", "cast(null as long) distance", "cast(null as long) cluster_inertia", "cast(null as long) inertia", "cast(null as string) centroid_sha256")
    planted = write_table(plant(vectors, width), "balls")
    for _ in range(rounds):
        count, sums = totals(planted, centroids)
        met = count > 0
        centroids[met] = sums[met] // count[met, None]  # the floor, for negative sums too
    found = write_table(assignments(planted, centroids), "clusters")
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    fits = lambda x: x if x < 1 << 63 else None
    about = [(c, fits(s), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in own.items()]
    stats = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(stats), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
