"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; the labels of all others are never read, they are unlabelled web
text.  A small network over surface features and hashed words is fitted by the non-negative unbiased risk estimator

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with logistic loss, so its output is a probability.  The class prior pi is estimated first: among the
texts that a positive-versus-unlabelled discriminator ranks highest, the share of unlabelled mass to
positive mass falls to pi.

Scale: the fit uses at most ``SAMPLE`` positives and ``SAMPLE`` documents of the training fold whatever
their label (those of the smallest hashes of their ids): the ids are found without reading a text, and
only the chosen texts are turned into features for the fit.  Scoring is one map where the text is
read: no shuffle, and ``keep_good`` filters there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, fold, prepare

#: Positives, and documents of the training fold, that a fit collects.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 16, 30, 512, 0.01, 1e-4
CUT = 0.3

_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".,", "!?", "|", "%&$#*@", "\"'()[];:-", "<>/={}\\_~^`+")
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _i
_CLASS[192:] = len(_GROUPS) + 1
_CLASS[128:192] = len(_GROUPS) + 2
N_CLASSES = len(_GROUPS) + 3
#: Cells of hashed words, and their weight among the inputs (there is little to learn from a cell, and much to overfit).
CELLS, DAMP = 8, 0.3
N_FEATURES = N_CLASSES + 12 + CELLS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each text: shares of byte classes, lengths, how words repeat, and shares of hashed words."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    w = kernel.words(data, offsets)
    of = kernel.owner(w.first)
    count = np.diff(w.first)
    some = np.maximum(count, 1)
    length = w.ends - w.starts

    def mean(x: np.ndarray, who: np.ndarray = of) -> np.ndarray:
        return np.bincount(who, x, minlength=n) / some

    same = np.zeros(len(of))
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
    distinct, top = np.zeros(n), np.zeros(n)
    repeated = np.zeros(n)
    if len(of):
        order = np.argsort((of.astype(np.uint64) << np.uint64(44)) | (w.hashes >> np.uint64(20)))
        h, o = w.hashes[order], of[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
        runs = np.diff(np.append(at, len(h)))
        distinct = np.bincount(o[at], minlength=n) / some
        np.maximum.at(top, o[at], runs)
        top /= some
        at3, h3 = kernel.windows(w.hashes, w.first, 3)
        o3 = of[at3]
        if len(o3):
            key = np.sort((o3.astype(np.uint64) << np.uint64(44)) | (h3 >> np.uint64(20)))
            again = np.concatenate([[False], key[1:] == key[:-1]])
            repeated = np.bincount((key >> np.uint64(44)).astype(np.int64), again, minlength=n) / some
    upper_first = kernel.UPPER[data[w.starts]] if len(of) else np.zeros(0)
    last = data[w.ends - 1] if len(of) else np.zeros(0, np.uint8)
    marks = np.isin(last, np.frombuffer(b"%&$#*!|", np.uint8))
    extra = np.stack([np.log1p(size) / 10, np.log1p(count) / 8, 1 / (1 + count), mean(length) / 10, mean(length <= 2), mean(length >= 12), mean(same), distinct, top, repeated, mean(upper_first), mean(marks)], 1)
    cells = np.bincount(of * CELLS + (w.hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=n * CELLS).reshape(n, CELLS) / some[:, None]
    return np.concatenate([shares, extra, cells], 1)


def all_features(column: pa.Array) -> np.ndarray:
    return np.concatenate([features(data, offsets) for _, _, data, offsets in kernel.chunks(column)]).astype(np.float32)


class Network:
    """One hidden layer, standardised inputs, logistic output."""

    def __init__(self, x: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        if x.shape[1] == N_FEATURES:
            self.scale[-CELLS:] /= DAMP
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.moments = [(np.zeros_like(v), np.zeros_like(v)) for v in self.w]
        self.steps = 0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step, given the derivative of the risk by each row's logit."""
        x = self.inputs(x)
        h = np.tanh(x @ self.w[0] + self.w[1])
        back = slope[:, None] * self.w[2] * (1 - h * h)
        grads = [x.T @ back + DECAY * self.w[0], back.sum(0), h.T @ slope + DECAY * self.w[2], np.array([slope.sum()])]
        self.steps += 1
        for v, g, (m, s) in zip(self.w, grads, self.moments):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _epochs(net: Network, p: np.ndarray, u: np.ndarray, epochs: int, prior: float | None, seed: int) -> None:
    """Fit by mini-batches; without a prior, plainly tell positives from unlabelled."""
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for lo in range(0, len(u), BATCH):
            xu = u[order[lo : lo + BATCH]]
            xp = p[rng.integers(0, len(p), min(BATCH, len(p)))]
            x, n_p, n_u = np.concatenate([xp, xu]), len(xp), len(xu)
            z = net.logit(x)
            s = _sigmoid(z)
            slope = np.empty(len(x))
            if prior is None:
                slope[:n_p], slope[n_p:] = (s[:n_p] - 1) / n_p, s[n_p:] / n_u
            else:
                negative = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
                if negative >= 0:
                    slope[:n_p], slope[n_p:] = (prior * (s[:n_p] - 1) - prior * s[:n_p]) / n_p, s[n_p:] / n_u
                else:  # the estimate of the negative risk is below zero: undo it
                    slope[:n_p], slope[n_p:] = prior * s[:n_p] / n_p, -s[n_p:] / n_u
            net.step(x, slope)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The least ratio of unlabelled to positive mass among top scores that hold ``least`` of the positives."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 81))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    return float(np.clip((u / p).min(), 0.01, 0.99))


class Model:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        discriminator = Network(unlabelled)
        _epochs(discriminator, positive, unlabelled, EPOCHS // 3, None, 1)
        self.prior = class_prior(discriminator.logit(positive), discriminator.logit(unlabelled))
        self.net = Network(unlabelled)
        _epochs(self.net, positive, unlabelled, EPOCHS, self.prior, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.net.score(x)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: F.Column, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` positives and ``sample`` documents of the training fold, whatever their label; None where there is no positive."""
    good = labels.where(F.col(id_col).isNotNull() & train).groupBy(id_col).agg(F.max(label_col).alias("__y")).where(F.col("__y") == 1).select(id_col)
    ids = docs.where(F.col(id_col).isNotNull() & train).select(id_col)

    def least(rows: DataFrame, positive: int) -> DataFrame:
        return rows.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("__id"), F.lit(positive).alias("__p"), F.lit(1 - positive).alias("__u"))

    chosen = least(ids.join(good, id_col, "left_semi"), 1).unionByName(least(ids, 0)).groupBy("__id").agg(F.max("__p").alias("__p"), F.max("__u").alias("__u"))
    own = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("__id", "__p", "__u", text_col)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat = pa.array(all_features(batch.column(3)).ravel())
        rows = pa.FixedSizeListArray.from_arrays(flat, N_FEATURES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), rows], ["id", "p", "u", "x"])

    found = arrow_map(own, f"id {docs.schema[id_col].dataType.simpleString()}, p int, u int, x array<float>", lambda: step).toArrow()
    x = np.stack(found.column(3).to_numpy()).astype(np.float64) if len(found) else np.zeros((0, N_FEATURES))
    # In an order of their own, so that the fit doesn't depend on partitions.
    order = np.lexsort((*x.T, np.array(found.column(0).to_pylist()))) if len(found) else np.zeros(0, int)
    x, p, u = x[order], found.column(1).to_numpy()[order], found.column(2).to_numpy()[order]
    return Model(x[p == 1], x[u == 1]) if (p == 1).any() else None


def score(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(id, score, predicted), a row a document row; predicted is 1 where the score is at least ``cut``.

    ``train`` says which ids the fit may use, labelled or not.  A null or empty text is scored like any
    other (all its features are those of no text).  Labels that contradict each other count as good.
    Without a single positive label every score is 0.5.  Repeated rows get equal scores.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, train, sample))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _scores(model.value, batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], [id_col, "score", "predicted"])

    return arrow_map(docs, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int", lambda: step)


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    return model.score(all_features(texts).astype(np.float64)) if model else np.full(len(texts), 0.5)


def keep_good(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows predicted bad, filtered where the text is read.

    Each row goes by its own text, one with a null id or a null text too.  Columns are those of ``docs``,
    whatever their names.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs.select(id_col, text_col), labels, id_col, text_col, label_col, train))
    at = docs.columns.index(text_col)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_scores(model.value, batch.column(at)) >= cut))

    return arrow_map(docs, docs.schema, lambda: step)


def held_out(id_col: str = "doc_id") -> F.Column:
    return fold(id_col, 5) == 0
