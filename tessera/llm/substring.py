"""Substring deduplication of word windows, with a count-min prefilter.

1. Each task counts the windows of its texts in a count-min sketch of ``ROWS`` rows; the sketches are
   merged stripe by stripe into one bit a cell: met at least twice.  A window's estimate is the minimum
   over its rows, so counts are only ever overestimated.
2. A second pass keeps the windows whose estimate is two or more: a superset of all repeated windows, so
   none is lost.  They are grouped exactly, by 95 bits of two independent hashes of the whole window.
3. Words under a window that also starts in a document with a smaller doc_id are removed.

Scale: a row has two cells for each window the input can hold (by its bytes), up to ``CELL_BITS``, so
what tasks receive is at most 128 MB as bits.  A larger input is taken in up to ``PASSES`` passes, each
over the windows of one share of the hashes with a sketch of its own (PASSES * 2^29 windows, some 50 GB of text,
before the prefilter passes more; a cluster with larger executors raises CELL_BITS).  Step 2 is exact and
distributed at any load: a run of windows is first reduced to one row a distinct window, that of its
smallest doc_id, and other documents of the run are decided at once, so a window that a third of all
documents hold makes one row for each ``RUN`` windows, not one a document.  Texts are shuffled only
where they have a window to lose, as long as those documents' ids may be broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, merge_stripes, prepare, write_table

#: Words of a window.
WIDTH = 13
#: Rows of the sketch, log2 of the cells of a row at most, stripes in which it is merged, passes at most.
ROWS, CELL_BITS, STRIPES, PASSES = 2, 29, 64, 16
#: Bytes of text that a window has at least, as a rule.
WINDOW_BYTES = 6
#: Windows that a run gathers before it is reduced.
RUN = 1 << 20
#: Document ids (8 bytes each) that may be broadcast; beyond them all texts are shuffled.
IDS = 1 << 20


def _text_windows(column: pa.Array, width: int, share: tuple[int, int], second: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first row, text of each window, its hash, its second hash), for runs of texts; only windows of a share (k of n) of the hashes."""
    for lo, _, data, offsets in kernel.chunks(column):
        w = kernel.words(data, offsets)
        at, h1 = kernel.windows(w.hashes, w.first, width)
        if not len(at):
            continue
        text = kernel.owner(w.first)[at]
        h2 = kernel.windows(kernel.span_hashes(data, w.starts, w.ends, 1), w.first, width)[1] if second else None
        if share[1] > 1:
            mine = h1 % np.uint64(share[1]) == np.uint64(share[0])
            text, h1, h2 = text[mine], h1[mine], h2[mine] if second else None
        if len(h1):
            yield lo, text, h1, h2


def _cells(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The cell of each window in each row; rows lie end to end."""
    for row in range(ROWS):
        x = h if not row else kernel.mix(h ^ np.uint64(0x2545F4914F6CDD1D * row % 2**64))
        yield (x >> np.uint64(64 - bits)) + np.uint64(row << bits)


def _pack(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted cells of a stripe and whether each was met twice, as planes of bytes that compress well."""
    gaps = np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(gaps[:, 1:].T.tobytes(), 1) + b"|" + gaps[:, 0].tobytes() + np.packbits(twice).tobytes() + len(cells).to_bytes(4, "little")


def _add(part: bytes, counts: np.ndarray) -> None:
    n = int.from_bytes(part[-4:], "little")
    unzip = zlib.decompressobj()
    high = np.frombuffer(unzip.decompress(part), np.uint8).reshape(3, n)
    rest = unzip.unused_data[1:]
    gaps = np.zeros((n, 4), np.uint8)
    gaps[:, 0], gaps[:, 1:] = np.frombuffer(rest[:n], np.uint8), high.T
    cells = np.cumsum(gaps.view("<u4").ravel(), dtype=np.int64)
    twice = np.unpackbits(np.frombuffer(rest[n : n + (n + 7) // 8], np.uint8), count=n)
    counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)


class Sketch:
    """The merged sketch: a bit a cell, whether its windows were met at least twice; sent compressed."""

    def __init__(self, bits: int, stripes: dict[int, bytes]) -> None:
        self.bits, self.stripes, self.twice = bits, stripes, None

    def __getstate__(self) -> tuple[int, dict[int, bytes]]:
        return self.bits, self.stripes

    def __setstate__(self, state: tuple[int, dict[int, bytes]]) -> None:
        self.__init__(state[0], {})
        size = (ROWS << self.bits) // 8
        self.twice, part_size = np.zeros(size, np.uint8), size // STRIPES
        for stripe, part in state[1].items():
            self.twice[stripe * part_size : (stripe + 1) * part_size] = np.frombuffer(zlib.decompress(part), np.uint8)

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """The places of the window hashes that are estimated to occur twice or more: by all their cells."""
        at = np.arange(len(h))
        for row in range(ROWS):
            x = h[at] if not row else kernel.mix(h[at] ^ np.uint64(0x2545F4914F6CDD1D * row % 2**64))
            cell = ((x >> np.uint64(64 - self.bits)) + np.uint64(row << self.bits)).astype(np.int64)
            at = at[(self.twice[cell >> 3] & (0x80 >> (cell & 7)).astype(np.uint8)) > 0]
        return at


def plan(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(log2 of the cells of a row, passes) for the windows that the bytes of all texts can hold."""
    windows = (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // WINDOW_BYTES + 1
    passes = min(PASSES, -(-windows // (1 << CELL_BITS)))
    return int(np.clip((2 * windows // passes).bit_length(), 16, CELL_BITS)), passes


def merged_sketch(docs: DataFrame, bits: int, share: tuple[int, int] = (0, 1), width: int = WIDTH, text_col: str = "text") -> Sketch:
    stripe_size = (ROWS << bits) // STRIPES

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            new = np.concatenate([[True], cells[1:] != cells[:-1]])
            twice = ~np.append(new[1:], True)[new]  # the next one is the same
            cells = cells[new]
            bounds = np.searchsorted(cells, np.arange(STRIPES + 1, dtype=np.int64) * stripe_size)
            for s in range(STRIPES):
                a, b = bounds[s], bounds[s + 1]
                if b > a:
                    part = _pack(cells[a:b].astype(np.int64) - s * stripe_size, twice[a:b])
                    yield pa.RecordBatch.from_pydict({"stripe": pa.array([s], pa.int32()), "part": pa.array([part], pa.binary())})

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, _, h1, _ in _text_windows(batch.column(0), width, share):
                held.extend(x.astype(np.uint32) for x in _cells(h1, bits))
            if sum(map(len, held)) > 4 * ROWS * RUN:
                yield from flush()

        step.end = flush
        return step

    parts = arrow_map(docs.select(text_col), "stripe int, part binary", start)
    return Sketch(bits, merge_stripes(parts, _add, lambda counts: zlib.compress(np.packbits(counts > 1).tobytes(), 1), stripe_size, "uint8", STRIPES))


def _late_rows(docs: DataFrame, bits: int, share: tuple[int, int], width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, h1, run): a window of a document that also starts in one with a smaller id, or a run's list of such windows."""
    spark: SparkSession = docs.sparkSession
    sketch = spark.sparkContext.broadcast(merged_sketch(docs, bits, share, width, text_col))

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h1, h2, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.flatnonzero(new)
            first = np.repeat(doc[at], np.diff(np.append(at, len(h1))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at].view(np.int64)), pa.array(h2[at].astype(np.int32)), pa.array(doc[at]), pa.nulls(len(at), pa.binary())], ["h1", "h2", "doc", "later"]
            )
            late = doc > first
            doc, h1 = doc[late], h1[late]
            if len(doc):
                order = np.lexsort((h1, doc))
                doc, h1 = doc[order], h1[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1])
                doc, h1 = doc[new], h1[new]
                at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                lists = [x.tobytes() for x in np.split(h1, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(h1[at].view(np.int64)), pa.array(np.zeros(len(at), np.int32)), pa.array(doc[at]), pa.array(lists, pa.binary())], ["h1", "h2", "doc", "later"])

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, text, h1, h2 in _text_windows(batch.column(1), width, share, second=True):
                hit = sketch.value.repeated(h1)
                if len(hit):
                    held.append((h1[hit], (h2[hit] >> np.uint64(33)), ids[lo + text[hit]].astype(np.int64)))
            if sum(len(x[0]) for x in held) > RUN:
                yield from flush()

        step.end = flush
        return step

    found = arrow_map(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col), "h1 long, h2 int, doc long, later binary", start)
    smallest = F.min(F.when(F.col("later").isNull(), F.col("doc"))).over(Window.partitionBy("h1", "h2"))
    late = found.withColumn("smallest", smallest).where(F.col("later").isNotNull() | (F.col("doc") > F.col("smallest")))
    rows = write_table(late.select("doc", F.when(F.col("later").isNull(), F.col("h1")).alias("h1"), "later"), "late")
    sketch.destroy()
    return rows


def later_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h1, later): for each document the first hashes of its windows that also start in one with a smaller id."""
    bits, passes = plan(docs, text_col)
    return reduce(DataFrame.unionByName, [_late_rows(docs, bits, (k, passes), width, id_col, text_col) for k in range(passes)])


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, unless ``digest_only``, the kept words as the text.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A text without removed words keeps its own spacing as the text
    column; one that loses words is its kept words joined by one space.  A null text has no words and
    stays null.  A row with a null id takes no part in the comparison and keeps all words.  Rows that
    repeat an id are one document for the comparison (an id isn't smaller than itself).  Other columns
    stay as they are; columns of the made names are replaced.
    """
    prepare(docs.sparkSession)
    made = ["n_words", "n_removed", "kept_sha256"]
    rest = [f for f in docs.schema if f.name not in made and not (digest_only and f.name == text_col)]
    of, hashes, runs = (f"{x}_{uuid.uuid4().hex}" for x in ("of", "hashes", "runs"))  # no columns of any input
    rows = later_windows(docs, width, id_col, text_col)
    late = rows.groupBy(F.col("doc").alias(of)).agg(F.collect_list("h1").alias(hashes), F.collect_list("later").alias(runs))
    same = F.col(id_col).cast("long") == F.col(of)
    ids = rows.select(F.col("doc").alias(of)).distinct()
    if ids.limit(IDS + 1).count() <= IDS:  # texts that lose nothing stay where they are
        ids = F.broadcast(ids)
        whole = docs.join(ids, same, "left_anti").select("*", F.array().cast("array<long>").alias(hashes), F.array().cast("array<binary>").alias(runs))
        joined = docs.join(ids, same, "left_semi").join(late, same).select(*docs.columns, hashes, runs).unionByName(whole)
    else:
        joined = docs.join(late, same, "left")
    inputs = [*(f.name for f in rest if f.name != text_col), text_col, hashes, runs]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = {c: batch.column(i) for i, c in enumerate(inputs)}
        n_words, n_removed, sha, kept_texts = [], [], [], []
        for lo, hi, data, offsets in kernel.chunks(column[text_col]):
            w = kernel.words(data, offsets)
            at, h1 = kernel.windows(w.hashes, w.first, width)
            bounds = np.searchsorted(at, w.first)
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                own, many = column[hashes][lo + i].as_py(), column[runs][lo + i].as_py()
                gone = np.zeros(b - a, bool)
                if own or many:
                    bad = np.concatenate([np.array(own, np.int64).view(np.uint64), *(np.frombuffer(x, np.uint64) for x in many)])
                    x = slice(bounds[i], bounds[i + 1])
                    gone = kernel.covered(b - a, at[x][np.isin(h1[x], bad)] - a, width)
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                all_words = text.split()
                kept = [t for t, g in zip(all_words, gone.tolist()) if not g] if gone.any() else all_words
                joined_words = b" ".join(kept)
                n_words.append(int(b - a))
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(joined_words).hexdigest())
                if not digest_only:
                    kept_texts.append(joined_words.decode("utf-8", "replace") if gone.any() else column[text_col][lo + i].as_py())
        out = {f.name: column[f.name] for f in rest if f.name != text_col}
        if not digest_only:
            out[text_col] = pa.array(kept_texts, pa.string())
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        names = [*(f.name for f in rest), *made]
        yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "n_words long, n_removed long, kept_sha256 string"
    return arrow_map(joined.select(*inputs), schema, lambda: step)
