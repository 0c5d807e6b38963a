"""Best-fit packing of tokenised documents into sequences under several limits at once.

A piece asks for tokens, for one of the documents a sequence may hold, and for attention cost (its length squared),
and a sequence has that much of each left.  Pieces go in from the longest to the shortest; each takes, of the open
sequences that have room in every limit, the best by a rule, or opens a new one:

* ``norm``: the smallest weighted norm of what would be left, as shares of the limits;
* ``dot``: the largest weighted dot product of what is left and what is asked.

What a piece asks for depends on its length alone, so equal pieces are placed as one run: sequences in the same
state are a class with a count, a chosen sequence takes as many of the run as fit, and the plan works on the histogram
of lengths (``tokens`` entries at most) and not on pieces.  It is the packing of all pieces together, on any number of
machines: a piece's place in the order of lengths (counted by ranges) says which sequence it is in.  The driver holds the
histogram and the runs placed (at most a few for each length and class), never pieces.

A text is cut at ASCII white space, which no token crosses, and each distinct stretch between is encoded once a task
while the cache lasts; a text is read in parts of some MB.  Null and empty texts are their end token alone.  Rows with
a null id and rows that repeat an id are documents of their own.  An empty table packs to nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, prepare, write_table
from tessera.operators.ranges import place

#: Bytes of a text that are encoded together; letters of a word that is remembered; stretches and bytes after which memory starts anew.
PART, SHORT, REMEMBERED, HELD = 2 << 20, 48, 1 << 18, 64 << 20
_GAP = re.compile(rb"[ \t-\r]")


@dataclass(frozen=True)
class Limits:
    """What a sequence holds; None is as much as its tokens can ask for."""

    tokens: int
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)

    def longest(self) -> int:
        """The longest piece that fits into an empty sequence."""
        return min(self.tokens, math.isqrt(int(self.vector()[2])))


@dataclass(frozen=True)
class Rule:
    kind: str = "norm"
    #: Weights of tokens, documents and attention cost.
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def order(self, room: np.ndarray, ask: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The rows of ``room``, best first; ties to the older sequence."""
        if self.kind == "norm":
            key = (np.array(self.weights) * ((room - ask) / limits) ** 2).sum(1)
        elif self.kind == "dot":
            key = -(np.array(self.weights) * (room / limits) * (ask / limits)).sum(1)
        else:
            raise ValueError(f"unknown rule {self.kind!r}; known: norm, dot")
        return np.argsort(key, kind="stable")


@dataclass(frozen=True)
class Runs:
    """Runs of equal pieces in the order of their places: ``each`` of them a sequence, from ``sequence`` on, ``offset`` the first one's."""

    start: np.ndarray
    length: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces at these places."""
        run = np.searchsorted(self.start, places, "right") - 1
        nth = places - self.start[run]
        return self.sequence[run] + nth // self.each[run], self.offset[run] + nth % self.each[run] * self.length[run]


def plan(lengths: dict[int, int], limits: Limits, rule: Rule = Rule()) -> Runs:
    """Where the pieces go, given how many there are of each length."""
    full = limits.vector()
    room, first, count = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # classes of equal sequences in a row
    runs: list[tuple[int, int, int, int, int]] = []
    at = sequences = 0

    for length in sorted(lengths, reverse=True):
        left, ask = lengths[length], np.array([length, 1, length * length], np.int64)
        fits = np.flatnonzero((room >= ask).all(1))
        fits = fits[rule.order(room[fits], ask, full)]
        each = (room[fits] // ask).min(1)
        upto = np.cumsum(each * count[fits])
        chosen = fits[: int(np.searchsorted(upto, left)) + 1]
        new: list[tuple[np.ndarray, int, int]] = []
        for c, q in zip(chosen.tolist(), each.tolist()):
            taken = min(left, q * int(count[c]))
            runs.append((at, length, q, int(first[c]), int(full[0] - room[c, 0])))
            new += _split(room[c], int(first[c]), int(count[c]), ask, taken, q)
            at, left = at + taken, left - taken
        if left:
            q = int((full // ask).min())
            opened = -(-left // q)
            runs.append((at, length, q, sequences, 0))
            new += _split(full, sequences, opened, ask, left, q)
            at, sequences = at + left, sequences + opened
        stay = np.ones(len(count), bool)
        stay[chosen] = False
        new = [x for x in new if x[0][0] > 0 and x[0][1] > 0]  # full ones take nothing more
        room = np.concatenate([room[stay], np.array([x[0] for x in new], np.int64).reshape(-1, 3)])
        first, count = (np.concatenate([old[stay], np.array([x[i] for x in new], np.int64)]) for i, old in ((1, first), (2, count)))
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Runs(*columns, sequences)


def _split(room: np.ndarray, first: int, count: int, ask: np.ndarray, taken: int, each: int) -> list[tuple[np.ndarray, int, int]]:
    """What becomes of a class when ``taken`` pieces go in, ``each`` a sequence: full ones, one with the rest, untouched ones."""
    whole, rest = divmod(taken, each)
    out = [(room - each * ask, first, whole)] if whole else []
    if rest:
        out.append((room - rest * ask, first + whole, 1))
    left = count - whole - bool(rest)
    return out + ([(room, first + count - left, left)] if left else [])


#: What the tokenizer's own description splits a lower-cased text into (fixed by it), and the mark between stretches.
_WORDS = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0d\x20\x85\xa0\p{L}\p{N}]+")
#: Letters whose normal form is themselves and whose case doesn't hang on their neighbours: Latin, but for the dotted capital I.
_PLAIN = regex.compile("[\x00-\u012f\u0131-\u024f]*")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Token ids of whole texts by a tokenizer that drops white space, with a bounded memory of stretches and words.

    Stretches in plain letters are lower-cased and split here and only their words go to the tokenizer's model, each once;
    others go through the whole tokenizer.
    """

    def __init__(self, described: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(described)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size = np.zeros(REMEMBERED * 2, np.int64), np.zeros(REMEMBERED * 2, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    def word(self, text: str) -> list[int]:
        """The ids of one lower-cased word."""
        shown = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        if len(text) <= SHORT:
            if len(self.words) >= REMEMBERED * 2:
                self.words.clear()
            self.words[text] = ids
        return ids

    def learn(self, fresh: list[str]) -> tuple[list[int], list[int]]:
        """(ids of the stretches one after the other, how many each has)."""
        plain = [w.isascii() or _PLAIN.fullmatch(w) is not None for w in fresh]
        other = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(fresh, plain) if not p], add_special_tokens=False))
        found = _WORDS.findall("".join([f"{w}\n" for w, p in zip(fresh, plain) if p]).lower())
        flat, sizes, at = [], [], 0
        words, word = self.words, self.word
        for p in plain:
            before = len(flat)
            if p:
                while (w := found[at]) != "\n":
                    flat += words.get(w) or word(w)
                    at += 1
                at += 1
            else:
                flat += next(other).ids
            sizes.append(len(flat) - before)
        return flat, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end); no text is null."""
        stretches = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds = stretches.offsets.to_numpy().astype(np.int64)
        distinct = stretches.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        words = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED or self.held > HELD:
            self.forget()
        known = self.known
        fresh = [w for w in words if w not in known]
        flat, sizes = self.learn(fresh)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        n, m = len(known), len(known) + len(fresh)
        if m > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(m, np.int64)]) for x in (self.start, self.size))
        self.size[n:m] = sizes
        self.start[n:m] = self.used + np.cumsum(self.size[n:m]) - self.size[n:m]
        self.used += len(flat)
        known.update(zip(fresh, range(n, m)))
        slots = np.array([known[w] for w in words], np.int64)
        of = slots[distinct.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        each = self.size[of]
        ends = np.cumsum(each)
        ids = self.flat[np.repeat(self.start[of] - (ends - each), each) + np.arange(int(each.sum()))]
        self.held += int(distinct.dictionary.nbytes)
        return ids, np.concatenate([[0], ends])[bounds - bounds[0]]


def parts_of(text: bytes) -> Iterator[bytes]:
    """A long text in parts cut at white space."""
    lo = 0
    while lo < len(text):
        gap = _GAP.search(text, lo + PART)
        hi = gap.start() if gap else len(text)
        yield text[lo:hi]
        lo = hi


def pieces(docs: DataFrame, described: str, id_col: str, text_col: str, end: int, longest: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and the end token, cut every ``longest`` ids."""
    sent = docs.sparkSession.sparkContext.broadcast(described)
    kind = docs.schema[id_col].dataType.simpleString()

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        encoder = Encoder(sent.value)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, data, offsets in kernel.chunks(batch.column(1)):
                if hi - lo == 1 and len(data) > 2 * PART:
                    found = [encoder.encode(pa.array([p.decode()]))[0] for p in parts_of(data.tobytes())]
                    ids, bounds = np.concatenate(found), np.array([0, sum(map(len, found))])
                else:
                    ids, bounds = encoder.encode(batch.column(1).slice(lo, hi - lo).fill_null(""))
                row, nth, begin, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(ids[a:b], end).astype("<u4")
                    for n, s in enumerate(range(0, len(own), longest)):
                        part = own[s : s + longest]
                        row.append(lo + i)
                        nth.append(n)
                        begin.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

        return step

    return arrow_map(docs.select(id_col, text_col), f"id {kind}, piece int, start long, length long, ids_crc32 long", start)


def pack(docs: DataFrame, tokenizer: str, end: int, limits: Limits, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) a piece; sequences are numbered from 0, offsets have no gaps.

    ``tokenizer`` is the path of a tokenizer's description, read on the driver.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        described = f.read()
    cut = write_table(pieces(docs, described, id_col, text_col, end, limits.longest()), "pieces")
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``tokens`` rows
    runs = spark.sparkContext.broadcast(plan({r.length: r.n for r in counted}, limits, rule))
    placed = place(cut, [F.desc("length"), "id", "piece", "start", "ids_crc32"])

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sequence, offset = runs.value.find(batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    found = arrow_map(placed, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", start)
    return found.select(F.col("id").alias(id_col), *[c for c in found.columns if c != "id"])
