"""Language-model scores of whole texts by a gated recurrent network with a class-factored softmax.

Tokens are words (A-Z lower-cased) and one end a text.  Each word is a *member* of a class: the most
frequent words (``HEADS`` times the square root of the number of distinct words) are members of their
own, binned by frequency into about the square root as many classes; all others, known or not, are hashed into
``BUCKETS`` members of the class of their shape (first two bytes, a non-ASCII byte, punctuation at the end).

    P(word | before) = P(class | state) * P(member | class, state) * share of the word in its member

Both softmaxes are learned.  The share is 1 for a frequent word, else (c + 1) / (N + V + 1) with the
counts of the member's words over all training texts, so the unseen words of a member share one event.
The state is that of a minimal gated unit over all words before, carried from window to window through
the whole text:  h = z * h + (1 - z) * n,  with the gate z and the candidate n learned for each
member.  It is trained by truncated backpropagation in numpy: in each of ``ROUNDS`` rounds each part
trains on its training texts from the common weights, and the weights are averaged by their tokens.
Every training text is read once, every word moves the state, and the loss is taken at every place.

Scale: word counts are one map-side reduced aggregation.  Up to ``KNOWN`` of the most frequent words go to the
tasks (a bounded broadcast); only occurrences of rarer words are shuffled, one row a text and word, to
meet their counts.  Texts are written once as members, two bytes a token; training deals these to parts of
about ``PART_TOKENS`` by the hash of the id, in an order of their own, so the weights depend neither on files nor on
partitions.  Weights are averaged in ``GROUPS`` groups before the driver.  Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, fold, prepare, write_table

HEADS, SHAPES, BUCKETS = 4, 32, 64
#: Frequent words at most (a member fits in two bytes), and words that are broadcast with their counts.
MOST_HEADS, KNOWN = 32_768, 1 << 19
HIDDEN, STEPS, STREAMS, RATE, ROUNDS, GROUPS = 32, 64, 512, 0.07, 2, 4
#: Places of a window from one loss to the next: every place of every training text has its loss.
EVERY = 1
PART_TOKENS = 4 << 20
#: Tokens that are laid in streams together, rows of an output matrix, and words that a count is reduced over.
GATHER, ROWS, RUN = 2 << 20, 512, 2 << 20
END = np.uint64(0x5851F42D4C957F2D)
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, first token of each text) of every token: a text's words, then its end."""
    low = kernel.LOWER[data]
    w = kernel.words(low, offsets)
    n, first = len(w.starts), w.first
    if n:
        one = low[w.starts].astype(np.int64)
        two = np.where(w.ends - w.starts > 1, low[np.minimum(w.starts + 1, len(low) - 1)], 0)
        high = np.cumsum(np.concatenate([[0], low > 127]), dtype=np.int32)
        wide = (high[w.ends] > high[w.starts]).astype(np.int64)
        shape = ((one * 31 + two) % (SHAPES // 4)) * 4 + wide * 2 + _PUNCTUATION[low[w.ends - 1]]
    else:
        shape = np.zeros(0, np.int64)
    texts = len(offsets) - 1
    at = np.arange(n) + kernel.owner(first)
    starts = first + np.arange(texts + 1)
    h, bucket = np.full(n + texts, END, np.uint64), np.zeros(n + texts, np.int64)
    h[at], bucket[at] = w.hashes, shape * BUCKETS + (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    return h, bucket, starts


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, bucket, n) of every distinct token of ``docs``."""

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                h, c = (np.concatenate(x) for x in zip(*held))
                held.clear()
                order = np.argsort(h)
                h, c = h[order], c[order]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(h))))], ["h", "bucket", "n"])

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                h, c, _ = tokens(data, offsets)
                held.append((h, c))
            if sum(len(x[0]) for x in held) > RUN:
                yield from end()

        step.end = end
        return step

    return arrow_map(docs.select(text_col), "h long, bucket int, n long", start).groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


class Lexicon:
    """The known words with their counts, and the members and classes of all words."""

    def __init__(self, h: np.ndarray, bucket: np.ndarray, n: np.ndarray, total: int, distinct: int, bucket_n: np.ndarray, bucket_v: np.ndarray) -> None:
        """Words by falling count; the end, if any text was counted, is among the frequent ones."""
        self.total, self.distinct = total, distinct
        front = np.flatnonzero(h == END)
        order = np.concatenate([front, np.flatnonzero(h != END)]).astype(np.int64)
        h, bucket, n = h[order], bucket[order], n[order]
        heads = self.heads = min(HEADS * math.isqrt(distinct), MOST_HEADS, len(h))
        by_count = np.argsort(-n[:heads], kind="stable")
        h[:heads], bucket[:heads], n[:heads] = h[by_count], bucket[by_count], n[by_count]
        self.bucket_n, self.bucket_v = bucket_n.astype(np.float64), bucket_v.astype(np.float64)
        np.subtract.at(self.bucket_n, bucket[:heads], n[:heads])
        np.subtract.at(self.bucket_v, bucket[:heads], 1)
        groups = max(1, math.isqrt(heads))
        mass = np.cumsum(n[:heads]) - n[:heads]
        head_class = np.minimum(mass * groups // max(1, n[:heads].sum()), groups - 1).astype(np.int64)
        _, head_class = np.unique(head_class, return_inverse=True)
        groups = int(head_class.max()) + 1 if heads else 0
        #: The class of each member; the members of a class stand together.
        self.of = np.concatenate([head_class, groups + np.arange(SHAPES).repeat(BUCKETS)])
        self.classes = groups + SHAPES
        self.bounds = np.searchsorted(self.of, np.arange(self.classes + 1))
        self.members = len(self.of)
        self.member_n = np.concatenate([n[:heads], self.bucket_n])
        order = np.argsort(h, kind="stable")
        self.n = n[order]
        self.place = np.where(order < heads, order, -1).astype(np.int32)  # among the frequent words
        self.lookup = kernel.Lookup(h[order])

    def symbols(self, h: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(member, count or -1 where not known) of each word."""
        at = self.lookup.find(h)
        if not len(self.n):
            return self.heads + bucket, at
        place = np.where(at >= 0, self.place[at], -1)
        return np.where(place >= 0, place, self.heads + bucket), np.where(at >= 0, self.n[at], -1)


def shapes(lexicon: Lexicon) -> dict[str, tuple[int, ...]]:
    """Gate and candidate of each member (and of a text's start, which clears the state), class weights, member weights."""
    return {"x": (lexicon.members + 1, 2 * HIDDEN), "c": (HIDDEN, lexicon.classes), "cb": (lexicon.classes,), "w": (lexicon.members, HIDDEN), "wb": (lexicon.members,)}


def unpack(flat: np.ndarray, lexicon: Lexicon) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(lexicon).items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(lexicon: Lexicon, seed: int = 3) -> np.ndarray:
    """Small random weights, and biases that make the untrained network a unigram model of the members."""
    flat = np.random.default_rng(seed).normal(0, 0.1, sum(map(math.prod, shapes(lexicon).values()))).astype(np.float32)
    p = unpack(flat, lexicon)
    p["x"] *= 3
    p["c"] *= 0.1
    p["w"] *= 0.1
    p["wb"][:] = np.log(lexicon.member_n + 1)
    p["cb"][:] = np.log(np.bincount(lexicon.of, lexicon.member_n + 1, lexicon.classes))
    return flat


class Network:
    def __init__(self, flat: np.ndarray, lexicon: Lexicon) -> None:
        self.flat, self.lexicon = flat.copy(), lexicon
        self.p = unpack(self.flat, lexicon)
        self.squares = np.full(len(flat), 1e-6, np.float32)
        self.s = unpack(self.squares, lexicon)
        self.start = lexicon.members
        z, n = self.gates(self.p["x"])
        z[self.start] = n[self.start] = 0  # a start clears the state
        self.z, self.n, self.add = z, n, n - z * n
        self.fixed, self.held = None, {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """Memory of a window that the next one uses again, as fresh pages cost a good part of what is computed in them."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.flat.dtype)
        return self.held[name][:size].reshape(shape)

    @staticmethod
    def gates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(z, n) of rows of ``x``."""
        return 0.5 * (np.tanh(0.5 * x[:, :HIDDEN]) + 1), np.tanh(x[:, HIDDEN:])

    def states(self, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the state given, then that after each input; z) of inputs (steps, streams); a stream's state is cleared where a text starts.

        Both are overwritten by the next call.
        """
        z = np.take(self.z, inputs, axis=0, mode="clip", out=self.room("z", *inputs.shape, HIDDEN))
        out = self.room("states", len(inputs) + 1, inputs.shape[1], HIDDEN)
        out[0] = h
        np.take(self.add, inputs, axis=0, mode="clip", out=out[1:])
        for t in range(len(inputs)):
            out[t + 1] += z[t] * out[t]
        return out, z

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(class weights, member weights), a row a column of the softmax, whose last entry is the bias below the softmax's largest."""
        p, lex = self.p, self.lexicon
        c = np.column_stack([p["c"].T, p["cb"] - p["cb"].max()])
        return c, np.column_stack([p["w"], p["wb"] - np.maximum.reduceat(p["wb"], lex.bounds[:-1])[lex.of]])

    @staticmethod
    def softmax(s: np.ndarray, weights: np.ndarray, own: np.ndarray, back: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """(log probability of the column ``own`` at each row of s, with ``back`` the slopes of the weights); adds the rows' slopes to ``back``.

        Slopes are (e - total at the own column) / total: the quotient is taken at the narrow sides of the products.
        """
        e = s @ weights.T
        flat, at = e.reshape(-1), np.arange(0, e.size, e.shape[1]) + own
        picked = flat.take(at).astype(np.float64)
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], e.dtype)
        logs = picked - np.log(total)
        if back is None:
            return logs, None
        flat[at] -= total
        share = (1 / total)[:, None]
        back += (e @ weights[:, :HIDDEN]) * share
        return logs, e.T @ (s * share)

    def outputs(self, states: np.ndarray, symbols: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(class) * P(member | class) at each state; with grads, also the states' slopes.

        Rows are laid by member, so those of a class stand together, and go ``ROWS`` at a time, so that what they give stays in the cache.
        """
        lex = self.lexicon
        order = np.argsort(symbols.astype(np.uint16), kind="stable")  # a radix sort
        own = symbols[order]
        cls = lex.of[own]
        s = self.room("sorted", len(own), HIDDEN + 1)
        s[:, :HIDDEN] = np.take(states, order, axis=0, mode="clip", out=self.room("back", len(own), HIDDEN))
        s[:, HIDDEN] = 1  # meets the biases
        c, w = self.fixed or self.weights()
        logs, back = np.zeros(len(own)), None if grads is None else self.room("back", len(own), HIDDEN)
        if grads is not None:
            back[:] = 0
        of_c, of_w = (None, None) if grads is None else (np.zeros_like(c), np.zeros_like(w))

        def add(lo: int, hi: int, weights: np.ndarray, picks: np.ndarray, slopes: np.ndarray | None) -> None:
            for a in range(lo, hi, ROWS):
                mine = slice(a, min(a + ROWS, hi))
                found, more = self.softmax(s[mine], weights, picks[mine], None if back is None else back[mine])
                logs[mine] += found
                if slopes is not None:
                    slopes += more

        add(0, len(own), c, cls, of_c)
        within, cuts = own - lex.bounds[cls], np.searchsorted(cls, np.arange(lex.classes + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = lex.bounds[k], lex.bounds[k + 1]
            if hi - lo > 1:
                add(cuts[k], cuts[k + 1], w[lo:hi], within, None if grads is None else of_w[lo:hi])
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        if grads is not None:
            grads["c"], grads["cb"], grads["w"], grads["wb"] = of_c[:, :HIDDEN].T, of_c[:, HIDDEN], of_w[:, :HIDDEN], of_w[:, HIDDEN]
            back = np.take(back, place, axis=0, mode="clip")
        return logs[place], back

    def learn(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray, phase: int) -> np.ndarray:
        """One update by the loss at the places phase, phase + EVERY, ... of the window; the last state."""
        every, z = self.states(inputs, h)
        before, states = every[:-1], every[1:]
        places = slice(phase, None, EVERY)
        mine = valid[places]
        if not mine.any():
            return states[-1].copy()
        grads: dict = {}
        if mine.size == valid.size and mine.all():
            slope = self.outputs(states.reshape(-1, HIDDEN), targets.ravel(), grads)[1].reshape(states.shape)
        else:
            slope = np.zeros_like(states)
            slope[places][mine] = self.outputs(states[places][mine], targets[places][mine], grads)[1]
        for t in range(len(inputs) - 2, -1, -1):  # what a state passes on: z of the next word
            slope[t] += z[t + 1] * slope[t + 1]
        scale = np.float32(1 / mine.sum())
        for name in ("c", "cb", "w", "wb"):
            g = grads[name] * scale
            self.s[name][:] += g * g
            self.p[name][:] -= np.float32(RATE) * g / np.sqrt(self.s[name])
        # The gate and the candidate are those of the word, so its slopes come from two sums over its places.
        symbols = inputs.ravel()
        rows = np.flatnonzero(np.bincount(symbols, minlength=self.start + 1)[: self.start])  # a start has no gate to learn
        at, n = self.z[rows], self.n[rows]

        def sums(values: np.ndarray) -> np.ndarray:
            columns = self.room("columns", HIDDEN, symbols.size)
            columns[:] = values.reshape(-1, HIDDEN).T
            return np.stack([np.bincount(symbols, x, minlength=self.start + 1)[rows] for x in columns], axis=1)

        total = sums(slope)
        g = np.concatenate([at * (1 - at) * (sums(np.multiply(slope, before, out=z)) - n * total), (1 - at) * (1 - n * n) * total], axis=1).astype(states.dtype) * scale
        square = self.s["x"][rows] + g * g
        self.s["x"][rows] = square
        x = self.p["x"][rows] - np.float32(RATE) * g / np.sqrt(square)
        self.p["x"][rows] = x
        at, n = self.gates(x)
        self.z[rows], self.n[rows], self.add[rows] = at, n, n - at * n
        return states[-1].copy()

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each valid place, the last state)."""
        states = self.states(inputs, h)[0][1:]
        if valid.all():
            return self.outputs(states.reshape(-1, HIDDEN), targets.ravel(), None)[0], states[-1].copy()
        return self.outputs(states[valid], targets[valid], None)[0], states[-1].copy()

    def run(self, symbols: np.ndarray, starts: np.ndarray, train: bool) -> np.ndarray:
        """Log probability (natural) of each text; its state is carried from window to window.

        Texts are laid end to end in up to STREAMS parallel streams of about equal length, longest first,
        so that one very long text doesn't leave the others waiting.
        """
        lengths = np.diff(starts)
        out = np.zeros(len(lengths))
        if not len(lengths):
            return out
        streams = int(np.clip(lengths.sum() // lengths.max(), 1, STREAMS))
        loads = [(0, s) for s in range(streams)]
        place, of = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            load, s = heapq.heappop(loads)
            place[i], of[i] = load, s
            heapq.heappush(loads, (load + int(lengths[i]), s))
        depth = -(-max(x[0] for x in loads) // STEPS) * STEPS
        text = np.repeat(np.arange(len(lengths)), lengths)
        row, column = np.arange(len(symbols)) - np.repeat(starts[:-1] - place, lengths), of[text]
        targets, inputs = np.zeros((depth, streams), np.int32), np.full((depth, streams), self.start, np.int32)
        owner = np.full((depth, streams), -1, np.int32)
        targets[row, column], owner[row, column] = symbols, text
        before = np.concatenate([[self.start], symbols[:-1]])
        before[starts[:-1]] = self.start
        inputs[row, column] = before
        h = np.zeros((streams, HIDDEN), np.float32)
        self.fixed = None if train else self.weights()
        for turn, t in enumerate(range(0, depth, STEPS)):
            w = slice(t, t + STEPS)
            valid = owner[w] >= 0
            if train:
                h = self.learn(inputs[w], targets[w], valid, h, turn % EVERY)
            else:
                logs, h = self.log_probabilities(inputs[w], targets[w], valid, h)
                out += np.bincount(owner[w][valid], logs, minlength=len(out))
        self.fixed = None
        return out


def train(members: DataFrame, lexicon, parts: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` rounds of local training and averaging over ``parts`` parts each.

    ``members``: (part, turn, members), each part in the order of ``turn``.  Parts are dealt to eight times as many
    tasks, so that few tasks get two; one that does trains them one after the other, each for itself.
    """
    spark: SparkSession = members.sparkSession
    flat = initial(lexicon.value)
    for turn in range(rounds):
        common = spark.sparkContext.broadcast(flat)

        def start(common=common) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
            part, net, seen, size = [None], [None], [0], [0]
            held: list[np.ndarray] = []

            def learn() -> None:
                if held:
                    net[0].run(np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])]), True)
                    seen[0] += size[0]
                    size[0] = 0
                    held.clear()

            def end() -> Iterator[pa.RecordBatch]:
                learn()
                if seen[0]:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part[0]], pa.int32()), "n": pa.array([seen[0]], pa.int64()), "w": pa.array([net[0].flat.tobytes()], pa.binary())})

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for p, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if p != part[0]:
                        yield from end()
                        part[0], net[0], seen[0] = p, Network(common.value, lexicon.value), 0
                    held.append(np.frombuffer(text.as_buffer(), "<u2").astype(np.int64))
                    size[0] += len(held[-1])
                    if size[0] > GATHER:
                        learn()

            step.end = end
            return step

        def average() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
            total, n = [0.0], [0]

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for k, w in zip(batch.column(1).to_pylist(), batch.column(2)):
                    total[0] = total[0] + np.frombuffer(w.as_buffer(), np.float32) * np.float64(k)
                    n[0] += k
                yield from ()

            def end() -> Iterator[pa.RecordBatch]:
                if n[0]:
                    yield pa.RecordBatch.from_pydict({"n": pa.array([n[0]], pa.int64()), "w": pa.array([total[0].tobytes()], pa.binary())})

            step.end = end
            return step

        mine = members.where(F.col("part") % rounds == turn)
        dealt = mine.repartition(8 * parts, "part").sortWithinPartitions("part", "turn", "members").select("part", "members")
        trained = arrow_map(dealt, "part int, n long, w binary", start).withColumn("g", F.floor(F.col("part") / rounds) % GROUPS)
        grouped = trained.repartition(GROUPS, "g").sortWithinPartitions("part").select("part", "n", "w")
        found = sorted((r.n, bytes(r.w)) for r in arrow_map(grouped, "n long, w binary", average).collect())
        if found:
            flat = (sum(np.frombuffer(w) for _, w in found) / sum(n for n, _ in found)).astype(np.float32)
    return flat


def learn_lexicon(counts: DataFrame) -> Lexicon:
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    bucket_n, bucket_v = np.zeros(SHAPES * BUCKETS), np.zeros(SHAPES * BUCKETS)
    for r in totals:
        bucket_n[r.bucket], bucket_v[r.bucket] = r.n, r.v
    # The cut between known and rare words comes from a histogram of counts, so no task gathers words.
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    held, cut = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r.level):
        held += r.v
        if held > KNOWN:
            cut = r.level + 1
            break
    known = counts.where(level >= cut).toArrow()
    h, bucket, n = (known.column(c).to_numpy().copy() for c in ("h", "bucket", "n"))
    order = np.lexsort((h, -n))
    h, bucket, n = h[order], bucket[order], n[order]
    return Lexicon(h.view(np.uint64), bucket.astype(np.int64), n, int(bucket_n.sum()), int(bucket_v.sum()), bucket_n, bucket_v)


def member_table(source: DataFrame, lexicon, parts: int) -> DataFrame:
    """(row, id, trains, part, turn, members, n_tokens, n_known, base, inside, rare, times): each text as members, with what its known words add.

    ``rare`` are the hashes of its words that aren't known, ``times`` how often each occurs.
    """
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, trains boolean, part int, turn long, members binary, n_tokens long, n_known long, base double, inside double, rare array<long>, times array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        per_token = math.log10(lex.total + lex.distinct + 1)
        share = np.concatenate([np.zeros(lex.heads), np.log10(lex.bucket_n + lex.bucket_v + 1)])
        for lo, hi, data, offsets in kernel.chunks(batch.column(4)):
            h, bucket, starts = tokens(data, offsets)
            symbols, c = lex.symbols(h, bucket)
            texts, lengths = hi - lo, np.diff(starts)
            of = np.repeat(np.arange(texts), lengths)
            known = c >= 0
            log_c = np.log10(np.maximum(c, 0) + 1.0)
            base = np.bincount(of, log_c - per_token, minlength=texts)
            inside = np.bincount(of, np.where(symbols >= lex.heads, log_c, 0) - share[symbols], minlength=texts)
            order = np.flatnonzero(~known)
            order = order[np.lexsort((h[order], of[order]))]
            cut = np.flatnonzero((np.diff(of[order], prepend=-1) != 0) | (np.diff(h[order], prepend=np.uint64(0)) != 0))
            times = np.diff(np.append(cut, len(order))).astype(np.int32)
            bounds = pa.array(np.searchsorted(of[order][cut], np.arange(texts + 1)).astype(np.int32))
            raw = symbols.astype("<u2").tobytes()
            columns = [c_.slice(lo, texts) for c_ in batch.columns[:4]]
            columns += [pa.array([raw[2 * a : 2 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], pa.binary()), pa.array(lengths), pa.array(np.bincount(of, known, minlength=texts).astype(np.int64)), pa.array(base), pa.array(inside)]
            columns += [pa.ListArray.from_arrays(bounds, pa.array(h[order][cut].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times))]
            yield pa.RecordBatch.from_arrays(columns, names)

    part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts * ROUNDS)).cast("int")
    rows = source.select("id", "trains", part.alias("part"), F.xxhash64("id").alias("turn"), "text")
    return write_table(arrow_map(rows, schema, lambda: step).select(F.monotonically_increasing_id().alias("row"), "*"), "members")


def score(docs: DataFrame, train_on: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), a row a document row; scores are log10.

    ``train_on`` says which rows are learned from (null: no).  A null text has one token, its end.
    base_score is add-one smoothed unigram probability; score that of the model.  Rows that repeat an
    id are scored each.  Without training rows every word is unknown and the base is 0.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train_on, F.lit(False)).alias("trains"))
    counts = write_table(word_counts(source.where("trains"), "text"), "counts")
    lexicon = spark.sparkContext.broadcast(learn_lexicon(counts))
    parts = max(1, -(-lexicon.value.total // (ROUNDS * PART_TOKENS)))
    table = member_table(source, lexicon, parts)
    weights = spark.sparkContext.broadcast(train(table.where("trains").select("part", "turn", "members"), lexicon, parts))
    n_all = lexicon.value.total

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        net = Network(weights.value, lexicon.value)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = net.run(np.concatenate([x for _, x in held]), np.concatenate([[0], np.cumsum([len(x) for _, x in held])]), False) / math.log(10)
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.int64()), pa.array(found)], ["at", "model"])
                held.clear()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            held.extend((r, np.frombuffer(x.as_buffer(), "<u2").astype(np.int64)) for r, x in zip(batch.column(0).to_pylist(), batch.column(1)))
            if sum(len(x) for _, x in held) > GATHER // 2:
                yield from flush()

        step.end = flush
        return step

    model = arrow_map(table.select("row", "members"), "at long, model double", start)
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("k"))
    met = rare.join(counts.select("h", "n"), "h")
    more = met.groupBy(F.col("row").alias("at_row")).agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + F.lit(1.0))).alias("more"))
    rows = table.drop("members", "rare", "times").join(model, F.col("row") == F.col("at")).join(more, F.col("row") == F.col("at_row"), "left")
    extra = F.coalesce("more", F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("model") + F.col("inside") + extra).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> F.Column:
    return fold(id_col, 7) == 2
