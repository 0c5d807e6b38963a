"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are scaled to unit length, so the largest cosine is the least distance.  Each of ``PROJECTIONS``
random directions keeps the projections of a block of vectors in one sorted array.  A query opens a
window around its own projection in every array; a vector *collides* where its place in that array
lies in the window.  Windows grow by virtual rehashing (radius times ``GROWTH``).  A vector whose
collisions reach ``NEEDED`` of the projections is verified by its exact cosine on the original
vectors.  A query ends when its k-th best verified distance is within the radius times ``SLACK``, or
when every vector of the block was verified; there is no cap on candidates.

Scale: rows are dealt by hash into blocks of about ``BLOCK`` vectors, queries into blocks of about
``QUERIES``; each pair of blocks is one group of bounded size, so no array is held whole anywhere, and
the k best of each block pair are merged by a window of a few rows a query.  The work is that of a
stated query set against all rows, in blocks: collisions are counted inside a block, because on
vectors without structure a window that finds the neighbours holds over half of every array, and as
rows of a range join the collisions alone would be some 70 a pair of query and vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare

PROJECTIONS, NEEDED, GROWTH, WINDOW, SLACK = 128, 0.77, 1.1, 1.25, 1.0
FIRST_RADIUS = 0.83
BLOCK, QUERIES = 8192, 2048


def usable(vector: str) -> F.Column:
    """Neither null nor zero, and without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that their squares neither vanish nor overflow; cosines stay exactly what they were."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=-1))


def cosines(query: np.ndarray, vectors: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """Exact cosines in double precision, summed alike for equal vectors."""
    return (vectors * query).sum(axis=1) / (lengths(query) * (lengths(vectors) if norms is None else norms))


class Sorted:
    """The sorted projections of one block of vectors (scaled)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11) -> None:
        self.ids, self.vectors = ids, np.ascontiguousarray(vectors)
        self.n, d = vectors.shape
        self.directions = np.random.default_rng(seed).normal(size=(d, PROJECTIONS))
        self.norms = lengths(self.vectors)
        projected = ((self.vectors / self.norms[:, None]) @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.values = np.take_along_axis(projected, order, axis=1)
        # The place of each vector in each sorted array: a window is a range of places.
        self.place = np.empty((PROJECTIONS, self.n), np.int32 if self.n >= 1 << 15 else np.int16)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(self.n, dtype=self.place.dtype), order.shape), axis=1)

    def collisions(self, centre: np.ndarray, half: float) -> np.ndarray:
        """In how many arrays each vector lies in the window of ``half`` to either side of the query's projection."""
        lo = np.array([v.searchsorted(x, "left") for v, x in zip(self.values, centre - half)], self.place.dtype)
        hi = np.array([v.searchsorted(x, "right") for v, x in zip(self.values, centre + half)], self.place.dtype)
        inside = self.place >= lo[:, None]
        inside &= self.place < hi[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if PROJECTIONS < 256 else np.int32)

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[tuple[float, int]], int]:
        """The k best verified (cosine, id), nearest first, ties to the smaller id, never the query itself; and how many were verified."""
        centre = (query / lengths(query)) @ self.directions
        others = self.n - int((self.ids == query_id).any())
        done = self.ids == query_id
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        need = max(1, int(np.ceil(NEEDED * PROJECTIONS)))
        radius = FIRST_RADIUS
        while len(rows) < others:
            new = np.flatnonzero((self.collisions(centre, WINDOW * radius) >= need) & ~done)
            if len(new):
                done[new] = True
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, cosines(query, self.vectors[new], self.norms[new])])
            if len(rows) >= k and np.sqrt(max(0.0, 2 - 2 * np.partition(scores, -k)[-k])) <= SLACK * radius:
                break
            radius *= GROWTH
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return [(float(scores[i]), int(self.ids[rows[i]])) for i in top], len(rows)


def search(table: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score, verified): the k nearest rows of each query row but itself, nearest first.

    ``verified`` is the number of vectors whose exact cosine the query took.  Rows whose id is null, or
    whose vector is null, zero or holds null or non-finite components, take no part; a vector meets
    only vectors of its own length.  Fewer than k others: all of them.  Ties go to the smaller id.  Rows
    that repeat an id are one vector, the smallest in array order (the query's own id never answers
    it).  An empty table gives an empty result.
    """
    prepare(table.sparkSession)
    usable_rows = table.where(F.col(id_col).isNotNull() & usable(vector_col))
    rows = usable_rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("d", F.size("v"))
    n, n_q = (t.count() for t in (table, table.where(is_query)))
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_q // queries))
    place = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    q_place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")
    data = rows.select("id", "v", "d", place.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("c"), F.lit(False).alias("asks"))
    asked = rows.where("q").select("id", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), q_place.alias("c"), F.lit(True).alias("asks"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float, int]] = []
        left, right = rows[~rows["asks"]], rows[rows["asks"]]
        if len(left) and len(right):
            own = Sorted(left["id"].to_numpy(), scaled(np.stack(left["v"].to_numpy())))
            for q, v in zip(right["id"].tolist(), scaled(np.stack(right["v"].to_numpy()))):
                near, verified = own.nearest(q, v, k)
                out += [(q, i, s, 0 if n else verified) for n, (s, i) in enumerate(near)]
        return pd.DataFrame(out, columns=["query_id", "id", "score", "verified"]).astype({"query_id": "int64", "id": "int64", "score": "float64", "verified": "int64"})

    near = data.unionByName(asked).groupBy("d", "b", "c").applyInPandas(meet, "query_id long, id long, score double, verified long")
    own = Window.partitionBy("query_id")
    rank = F.row_number().over(own.orderBy(F.desc("score"), "id"))
    ranked = near.withColumn("verified", F.sum("verified").over(own)).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score", "verified")
