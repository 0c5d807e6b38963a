"""Toxicity by the nearest labelled examples under a cosine of weighted TF-IDF vectors, found exactly.

Terms are words (lower case, punctuation aside) and their first four and five bytes.  A text is the
vector of all its terms that an example holds: (1 + ln tf) * idf * (FLOOR + strength), where idf is
taken over all documents and strength, 0 to 1, says how much oftener than by chance the examples of label 1 hold the
term; no term weighs nothing, so none is left out.  This isn't the plain measure (strength 1 for all terms), which doesn't
tell the labels apart on the fixtures: see the README for its figures.  The ``K`` nearest examples are found in a
block-max inverted index: postings in blocks of neighbouring examples, each with the greatest weight
in it, so that a block whose bound can't reach the K-th best cosine is skipped; what isn't skipped is
scored exactly, so the neighbours are exact.  Terms that many examples hold are rows of a matrix
instead of postings.  Votes are weighted by the square of the cosine; isotonic regression on votes by folds
(an example by an index and weights that know neither it nor its label) turns them into probabilities; the neighbours are the evidence.

Scale: the examples are a bounded sample of the labelled training rows (``EXAMPLES``), so the index is
bounded and may be broadcast; document frequencies and scoring cover all documents, each in one pass
where the text is read.  Nothing but the frequencies of the examples' terms is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, fold, merge_stripes, prepare

#: Labelled training rows that serve as examples, neighbours, examples of a block.
EXAMPLES, K, BLOCK = 3072, 15, 512
#: Weight of a term that doesn't speak for the label, and the excess (in standard deviations) from which and over which it rises to 1 more.
FLOOR, FROM, OVER = 0.08, 2.0, 5.0
#: Share of the examples from which on a term's postings are a matrix row; texts scored together; blocks scored before any is skipped.
FREQUENT, TOGETHER, FIRST = 0.1, 64, 2
CUT = 0.3
#: Parts of the examples that are voted on by the others to calibrate.
FOLDS = 4
STRIPES = 16
_PREFIXES = (4, 5)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term occurrence."""
    low = kernel.LOWER[data]
    w = kernel.words(low, offsets, kernel.NOT_ALNUM)
    of = kernel.owner(w.first)
    all_of, all_h = [of], [w.hashes]
    for n in _PREFIXES:
        longer = np.flatnonzero(w.ends - w.starts > n)
        all_of.append(of[longer])
        all_h.append(kernel.span_hashes(low, w.starts[longer], w.starts[longer] + n))
    return np.concatenate(all_of), np.concatenate(all_h)


def term_counts(data: np.ndarray, offsets: np.ndarray, vocabulary: kernel.Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text, term, times): the distinct vocabulary terms of each text, in order of their places."""
    of, h = terms(data, offsets)
    at = vocabulary.find(h)
    key = np.sort((of[at >= 0] << 32) | at[at >= 0])
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(cut, len(key)))
    key = key[cut]
    return np.searchsorted(key >> 32, np.arange(len(offsets))), key & 0xFFFFFFFF, times


def example_rows(docs: DataFrame, label: dict, id_col: str, text_col: str) -> list[tuple[object, np.ndarray]]:
    """(id, hashes of all terms) of the examples, by id; of texts that share an id the one of the smallest hash counts."""
    spark: SparkSession = docs.sparkSession
    ids = spark.createDataFrame(pa.table({"__id": pa.array(list(label))})).select(F.col("__id").cast(docs.schema[id_col].dataType))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in kernel.chunks(batch.column(1)):
            of, h = terms(data, offsets)
            order = np.argsort(of, kind="stable")
            lists = np.split(h[order].view(np.int64), np.searchsorted(of[order], np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(lists, pa.list_(pa.int64()))], [id_col, "key", "h"])

    own = docs.join(F.broadcast(ids), docs[id_col] == ids["__id"]).select(id_col, text_col, F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("__key"))
    found = arrow_map(own, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, key long, h array<long>", lambda: step).toArrow()
    one: dict = {}
    for i, key, h in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), found.column(2).to_numpy()):
        if i not in one or key < one[i][0]:
            one[i] = key, np.sort(np.asarray(h, np.int64).view(np.uint64))
    return [(i, one[i][1]) for i in sorted(one)]


def frequencies(docs: DataFrame, vocabulary, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each vocabulary term is, and how many documents there are."""
    size = -(-(len(vocabulary.value.hashes) + 1) // STRIPES)

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        counts = np.zeros(size * STRIPES, np.int64)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                _, term, _ = term_counts(data, offsets, vocabulary.value)
                np.add(counts, np.bincount(term, minlength=len(counts)), out=counts)
            counts[-1] += batch.num_rows
            yield from ()

        def end() -> Iterator[pa.RecordBatch]:
            for s in range(STRIPES):
                part = counts[s * size : (s + 1) * size]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"stripe": pa.array([s], pa.int32()), "part": pa.array([zlib.compress(part.astype(np.int32).tobytes(), 1)], pa.binary())})

        step.end = end
        return step

    def add(part: bytes, total: np.ndarray) -> None:
        total += np.frombuffer(zlib.decompress(part), np.int32)

    found = merge_stripes(arrow_map(docs.select(text_col), "stripe int, part binary", start), add, lambda x: zlib.compress(x.tobytes(), 1), size, "int64", STRIPES)
    df = np.zeros(size * STRIPES, np.int64)
    for s, part in found.items():
        df[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(part), np.int64)
    return df[: len(vocabulary.value.hashes)], int(df[-1])


def strengths(term: np.ndarray, example: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """0 to 1 a term: how far the examples of label 1 that hold it exceed those expected by chance."""
    yes = np.bincount(term, labels[example], minlength=size)
    expected = np.bincount(term, minlength=size) * labels.mean() if len(labels) else np.zeros(size)
    return np.clip(((yes - expected) / np.sqrt(expected + 1) - FROM) / OVER, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps that fit y over x best (pool adjacent violators), as points to interpolate between."""
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for value, truth in sorted(zip(x.tolist(), y.tolist())):
        blocks.append([truth, 1, value])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rate = float(np.mean(y)) if len(y) else 0.0
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + rate) / (b[1] + 1) for b in blocks])


class Index:
    """A block-max inverted index of unit vectors of labelled examples."""

    def __init__(self, ids: list, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weight: np.ndarray) -> None:
        """``ids`` ascend; a vector is (terms, times); ``weight`` is that of each term."""
        self.weight, n, size = weight, len(ids), len(weight)
        units = [self.unit(*v) for v in vectors]
        # Examples that share their most common term (and so their language) and label are neighbours.
        common = [int(t[np.argmin(weight[t])]) if len(t) else -1 for t, _ in units]
        order = sorted(range(n), key=lambda i: (common[i], labels[i], i))
        self.ids = [ids[i] for i in order]
        self.rank = np.array(order, np.int64)  # of each example in the order of the ids
        self.labels = np.array([labels[i] for i in order], np.int64)
        self.blocks = max(1, -(-n // BLOCK))
        lengths = np.array([len(units[i][0]) for i in order], np.int64)
        example = np.repeat(np.arange(n), lengths)
        term = np.concatenate([units[i][0] for i in order] or [np.zeros(0, np.int64)])
        value = np.concatenate([units[i][1] for i in order] or [np.zeros(0)])
        by = np.argsort(term, kind="stable")
        term, self.example, self.value = term[by], example[by].astype(np.int32), value[by]
        holders = np.bincount(term, minlength=size)
        frequent = np.flatnonzero(holders > FREQUENT * max(n, BLOCK))
        self.row = np.full(size, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.blocks * BLOCK))
        dense = self.row[term] >= 0
        self.matrix[self.row[term[dense]], self.example[dense]] = self.value[dense]
        term, self.example, self.value = term[~dense], self.example[~dense], self.value[~dense]
        # An entry is a term's postings in one block.
        key = term * self.blocks + self.example // BLOCK
        start = np.flatnonzero(np.diff(key, prepend=-1))
        self.start = np.append(start, len(key)).astype(np.int32)
        self.block = (key[start] % self.blocks).astype(np.int16)
        most = np.maximum.reduceat(self.value, start) if len(key) else np.zeros(0)
        self.most = np.nextafter(most.astype(np.float32), np.float32(2))
        self.first = np.searchsorted(key[start] // self.blocks, np.arange(size + 1)).astype(np.int32)
        none = np.flatnonzero(lengths == 0)
        self.rate = (self.labels.sum() + 0.5) / (n + 1)
        self.rate_empty = float((self.labels[none].sum() + 0.5 * self.rate) / (len(none) + 0.5))
        self.steps = np.zeros(0), np.zeros(0)

    def unit(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(times, np.float64))) * self.weight[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> list[list[tuple[float, int]]]:
        """For each (terms, times) the k examples of largest cosine (above 0) as (cosine, example), nearest first, ties to the smaller id."""
        units = [self.unit(*q) for q in queries]
        dense = np.zeros((len(units), len(self.matrix)))
        for i, (t, w) in enumerate(units):
            rows = self.row[t]
            dense[i, rows[rows >= 0]] = w[rows >= 0]
        return [self._nearest(t, w, known, k) for (t, w), known in zip(units, dense @ self.matrix)]

    def _nearest(self, t: np.ndarray, w: np.ndarray, known: np.ndarray, k: int) -> list[tuple[float, int]]:
        if not len(t):
            return []
        rare = self.row[t] < 0
        t, w = t[rare], w[rare]
        entries, lengths = _ranges(self.first[t], self.first[t + 1])
        weights = np.repeat(w, lengths)
        of = self.block[entries]
        bound = np.bincount(of, weights * self.most[entries], minlength=self.blocks) + known.reshape(-1, BLOCK).max(1)
        order = np.argsort(-bound, kind="stable")
        scores = np.full(len(known), -1.0)
        least = 0.0
        for chosen in (order[:FIRST], order[FIRST:]):
            chosen = chosen[(bound[chosen] > 0) & (bound[chosen] >= least - 1e-9)]
            if not len(chosen):
                break
            mine = np.zeros(self.blocks, bool)
            mine[chosen] = True
            pick = np.flatnonzero(mine[of])
            places, sizes = _ranges(self.start[entries[pick]], self.start[entries[pick] + 1])
            sums = known + np.bincount(self.example[places], np.repeat(weights[pick], sizes) * self.value[places], minlength=len(known))
            here = np.repeat(mine, BLOCK)
            scores[here] = sums[here]
            if len(scores) > k:
                least = max(0.0, float(np.partition(scores, -k)[-k]))
        scores = np.round(np.minimum(scores, 1.0), 12)[: len(self.ids)]
        found = np.flatnonzero((scores > 0) & (scores >= round(least, 12) - 1e-9))
        found = found[np.lexsort((self.rank[found], -scores[found]))][:k]
        return [(float(scores[i]), int(i)) for i in found]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The label among the neighbours, weighted by the squares of their cosines."""
        weight = np.array([c * c for c, _ in near])
        return float((weight * self.labels[[i for _, i in near]]).sum() / weight.sum())

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> list[float | None]:
        """The vote on each vector; None without neighbours."""
        found = [near for lo in range(0, len(queries), TOGETHER) for near in self.nearest(queries[lo : lo + TOGETHER])]
        return [self.vote(near) if near else None for near in found]

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.rate_empty
        return float(np.interp(self.vote(near), *self.steps)) if len(self.steps[0]) else float(self.rate)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the ranges one after the other, the length of each)."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum())), lengths


def fitted(ids: list, vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, idf: np.ndarray) -> Index:
    """The index of these examples, its weights by their labels alone."""
    example = np.repeat(np.arange(len(ids)), [len(t) for t, _ in vectors])
    terms_ = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
    return Index(ids, vectors, y.tolist(), idf * (FLOOR + strengths(terms_, example, y, len(idf))))


def calibrated(ids: list, vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps from votes to probabilities, by folds: an example is voted on by an index whose examples and weights
    know nothing of its own fold.  Equal vectors are of one fold."""
    fold_of = np.array([zlib.crc32(t.tobytes() + c.tobytes()) % FOLDS for t, c in vectors])
    votes, truth = [], []
    for f in range(FOLDS):
        rest, mine = np.flatnonzero(fold_of != f), np.flatnonzero(fold_of == f)
        if len(rest) and len(mine):
            part = fitted([ids[i] for i in rest], [vectors[i] for i in rest], y[rest], idf)
            found = [(v, y[i]) for i, v in zip(mine, part.votes([vectors[i] for i in mine])) if v is not None]
            votes += [v for v, _ in found]
            truth += [t for _, t in found]
    return isotonic(np.array(votes), np.array(truth))


def build(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str, text_col: str, label_col: str, examples: int) -> Index | None:
    """The index over at most ``examples`` labelled training rows (those of the smallest hashes of their ids); None without any."""
    spark: SparkSession = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train).groupBy(id_col).agg(F.max(label_col).alias("y"))
    label = {r[0]: int(r[1]) for r in known.orderBy(F.xxhash64(id_col), id_col).limit(examples).collect()}
    rows = example_rows(docs, label, id_col, text_col) if label else []
    if not rows:
        return None
    vocabulary = kernel.Lookup(np.unique(np.concatenate([h for _, h in rows])))
    sent = spark.sparkContext.broadcast(vocabulary)
    df, n = frequencies(docs, sent, text_col)
    vectors = []
    for _, h in rows:
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        vectors.append((vocabulary.find(h[cut]), np.diff(np.append(cut, len(h)))))
    y = np.array([label[i] for i, _ in rows])
    own, idf = [i for i, _ in rows], np.log((n + 1) / (df + 1)) + 1
    index = fitted(own, vectors, y, idf)
    index.steps = calibrated(own, vectors, y, idf)
    index.vocabulary = vocabulary
    return index


def score(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, cut: float = CUT) -> DataFrame:
    """(id, score, predicted, neighbours), a row a document row; neighbours are (example id, cosine, label), nearest first.

    ``train`` says which ids a label may be learned from.  A text that shares no term with an example
    (so a null or empty one) has no neighbours and gets the smoothed rate among examples without terms.
    Labels that contradict each other count as 1.  Without labels every score is 0.  A score hangs on
    the text alone: equal texts get equal results, whatever their ids, and a text that is an example finds itself among its neighbours.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    index = build(docs, labels, train, id_col, text_col, label_col, examples)
    sent = spark.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()
    near_type = pa.list_(pa.struct([(id_col, docs.limit(0).select(id_col).toArrow().schema.field(0).type), ("cosine", pa.float64()), ("label", pa.int32())]))

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        own = sent.value
        seen: dict[bytes, list[tuple[float, int]]] = {}

        def near_all(queries: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[float, int]]]:
            """The neighbours of each; equal vectors are looked up once."""
            keys = [t.astype(np.int32).tobytes() + c.astype(np.int32).tobytes() for t, c in queries]
            if len(seen) > 20_000:
                seen.clear()
            fresh = list({k: i for i, k in enumerate(keys) if k not in seen}.items())
            for lo in range(0, len(fresh), TOGETHER):
                part = fresh[lo : lo + TOGETHER]
                seen.update(zip([k for k, _ in part], own.nearest([queries[i] for _, i in part])))
            return [seen[k] for k in keys]

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, data, offsets in kernel.chunks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                scores, all_near = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                if own:
                    first, term, times = term_counts(data, offsets, own.vocabulary)
                    found = near_all([(term[a:b], times[a:b]) for a, b in zip(first[:-1], first[1:])])
                    for n, near in enumerate(found):
                        scores[n] = own.score(near)
                        all_near[n] = [{id_col: own.ids[e], "cosine": cosine, "label": int(own.labels[e])} for cosine, e in near]
                yield pa.RecordBatch.from_arrays([ids, pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(all_near, near_type)], [id_col, "score", "predicted", "neighbours"])

        return step

    return arrow_map(docs, f"`{id_col}` {kind}, score double, predicted int, neighbours array<struct<`{id_col}`:{kind},cosine:double,label:int>>", start)


def held_out(id_col: str = "doc_id") -> F.Column:
    return fold(id_col, 4) == 2
