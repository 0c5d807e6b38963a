"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matches.

1. Seeds: the windows of ``MIN_TILE`` words that a text shares with a benchmark item (lower case,
   punctuation aside) join documents to items; an item of fewer words is one window of its own length.
2. For each pair found, tiles are marked greedily: the longest common run of words in which no word
   is marked yet, again and again, down to ``MIN_TILE`` words.  Common runs start at equal Karp-Rabin
   hashes; what a tile cuts off a longer run is tried again.  Tiles may come in any order, so a
   passage whose sentences were reordered is still covered.
3. An item whose words are covered to ``threshold`` or more marks the document.

Scale: items, their seeds and the documents' hits are tables; none passes through the driver.  A bit
filter of the seeds (at most ``2 ** FILTER_BITS`` bits, whatever the benchmark) keeps what documents
send down to windows that an item may hold: a hit row has only the words under such windows.  Seeds
meet in a sort-merge join of two written tables, so adaptive execution can split a seed that a third
of all documents hold.  A pair goes to tiling only if its shared windows could reach the threshold.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, keep_unmatched, merge_stripes, prepare, write_table

#: Words of the shortest tile, and of a seed.
MIN_TILE = 5
#: Part of an item's words that tiles must cover.
THRESHOLD = 0.6
#: log2 of the bits of the seed filter: at least, and at most (128 MB).
LEAST_BITS, FILTER_BITS, STRIPES = 24, 30, 16
_P, _M = 1_000_003, (1 << 61) - 1


def tiles(text: list[int], item: list[int], shortest: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, words) of two sequences of word hashes; -1 in the text is a gap.

    The longest common run of unmarked words is marked next, ties to the smaller start in the text, then
    in the item.  Every such run lies in a maximal one (of the unmarked texts), so those are held in a
    heap by length; one that a tile has cut goes back as its remainders.
    """
    a, b = np.array(text, np.int64), np.array(item, np.int64)
    heap = []
    for i, j in _starts(text, item, shortest):
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        n = int(differ[0]) if len(differ) else n
        if n >= shortest:
            heap.append((-n, i, j))
    heapq.heapify(heap)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    found: list[tuple[int, int, int]] = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = free_a[i : i - n] & free_b[j : j - n]
        if free.all():
            found.append((i, j, -n))
            free_a[i : i - n] = free_b[j : j - n] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo >= shortest:
                heapq.heappush(heap, (lo - hi, i + lo, j + lo))
    return found


def _starts(text: list[int], item: list[int], length: int) -> Iterator[tuple[int, int]]:
    """(start in text, start in item) of the common runs that can't be extended to the left, by equal Karp-Rabin hashes.

    Places of equal hash are told apart by the word before them, so a repetitive text isn't paired with
    every place of a repetitive item.
    """
    table: dict[int, list[int]] = defaultdict(list)
    for j, h in _running(item, length):
        table[h].append(j)
    before: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, h in _running(text, length) if table else ():
        if h in table:
            before[h][text[i - 1] if i else -1].append(i)
    for h, groups in before.items():
        for j in table[h]:
            for word, places in groups.items():
                if not j or word != item[j - 1]:
                    for i in places:
                        yield i, j


def _running(words: list[int], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each window of ``length`` words without a gap."""
    top, value, run = pow(_P, length - 1, _M), 0, 0
    for k, word in enumerate(words):
        if word < 0:
            value = run = 0
            continue
        if run >= length:
            value -= words[k - length] * top
        value = (value * _P + word) % _M
        run += 1
        if run >= length:
            yield k - length + 1, value


def _seeds(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, seed) of the windows of a width; seeds of different widths differ."""
    at, h = kernel.windows(hashes, first, width)
    return at, kernel.mix(h + np.uint64(width))


def _words(data: np.ndarray, offsets: np.ndarray) -> kernel.Words:
    return kernel.words(data, offsets, kernel.NOT_ALNUM, lower=True)


def item_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, name, n, words): each named item with words, under a key of its own (written once, so it stays)."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in kernel.chunks(batch.column(1)):
            w = _words(data, offsets)
            lists = np.split(w.hashes.view(np.int64), w.first[1:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int32)), pa.array(lists, pa.list_(pa.int64()))], ["name", "n", "words"])

    named = benchmark.where(F.col(item_col).isNotNull()).select(item_col, text_col)
    rows = arrow_map(named, f"name {kind}, n int, words array<long>", lambda: step).where("n > 0")
    return write_table(rows.select(F.monotonically_increasing_id().alias("item"), "*"), "items")


def seed_table(items: DataFrame) -> DataFrame:
    """(h, item, n, times): the seeds of each item and in how many of its places they are."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, n, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = words.values.to_numpy().view(np.uint64)
            h, times = np.unique(_seeds(own, np.array([0, n]), min(n, MIN_TILE))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)), pa.array(np.full(len(h), n, np.int32)), pa.array(times.astype(np.int32))], ["h", "item", "n", "times"])

    return write_table(arrow_map(items.select("item", "n", "words"), "h long, item long, n int, times int", lambda: step), "seeds")


class Filter:
    """A Bloom filter of the seeds with two probes: their highest and lowest bits."""

    def __init__(self, bits: int, packed: np.ndarray) -> None:
        self.bits, self.packed = bits, packed

    def passes(self, h: np.ndarray) -> np.ndarray:
        """The places of the hashes that may be seeds."""
        at = np.arange(len(h))
        for probe in (0, 1):
            cell = _cell(h[at], self.bits, probe)
            at = at[(self.packed[cell >> 3] & (0x80 >> (cell & 7)).astype(np.uint8)) > 0]
        return at


def _cell(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1) if probe else h >> np.uint64(64 - bits)).astype(np.int64)


def seed_filter(seeds: DataFrame) -> Filter:
    bits = int(np.clip((seeds.count() * 32).bit_length(), LEAST_BITS, FILTER_BITS))
    stripe = (1 << bits) // STRIPES

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h = batch.column(0).to_numpy().view(np.uint64)
        cells = np.unique(np.concatenate([_cell(h, bits, 0), _cell(h, bits, 1)]))
        for s, own in enumerate(np.split(cells, np.searchsorted(cells, np.arange(1, STRIPES) * stripe))):
            if len(own):
                yield pa.RecordBatch.from_pydict({"stripe": pa.array([s], pa.int32()), "part": pa.array([(own - s * stripe).astype("<u4").tobytes()], pa.binary())})

    def add(part: bytes, total: np.ndarray) -> None:
        total[np.frombuffer(part, "<u4")] = True

    parts = arrow_map(seeds.select("h"), "stripe int, part binary", lambda: step)
    found = merge_stripes(parts, add, lambda x: np.packbits(x).tobytes(), stripe, "bool", STRIPES)
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for s, part in found.items():
        packed[s * stripe // 8 : (s + 1) * stripe // 8] = np.frombuffer(part, np.uint8)
    return Filter(bits, packed)


def hit_table(docs: DataFrame, sent, widths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(row, name, digest, words, seeds): each document with windows that pass the filter; its words under them (-1: a gap) and the distinct seeds."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at_row, digests, runs, seeds = [], [], [], []
        for lo, _, data, offsets in kernel.chunks(batch.column(1)):
            w = _words(data, offsets)
            under, hits = np.zeros(len(w.starts), bool), []
            for width in widths:
                at, h = _seeds(w.hashes, w.first, width)
                pick = sent.value.passes(h)
                if len(pick):
                    under |= kernel.covered(len(under), at[pick], width)
                    hits.append((np.searchsorted(w.first, at[pick], "right") - 1, h[pick]))
            if not hits:
                continue
            text, h = (np.concatenate(x) for x in zip(*hits))
            for i in np.unique(text).tolist():
                inside = np.flatnonzero(under[w.first[i] : w.first[i + 1]]) + w.first[i]
                words = (w.hashes[inside] % np.uint64(_M)).astype(np.int64)
                at_row.append(lo + i)
                digests.append(hashlib.sha256(data[offsets[i] : offsets[i + 1]].tobytes()).digest()[:16])
                runs.append(np.insert(words, np.flatnonzero(np.diff(inside) > 1) + 1, -1))
                seeds.append(np.unique(h[text == i]).view(np.int64))
        if at_row:
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_row, pa.int64())), pa.array(digests, pa.binary()), pa.array(runs, longs), pa.array(seeds, longs)], ["name", "digest", "words", "seeds"])

    found = arrow_map(docs.select(id_col, text_col), f"name {kind}, digest binary, words array<long>, seeds array<long>", lambda: step)
    return write_table(found.select(F.monotonically_increasing_id().alias("row"), "*"), "hits")


def judged(docs: DataFrame, benchmark: DataFrame, threshold: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """(name, digest, item_name, coverage, n_tiles, n_matched) for each document row and item that it covers to the threshold."""
    spark: SparkSession = prepare(docs.sparkSession)
    items = item_table(benchmark, item_col, text_col)
    seeds = seed_table(items)
    widths = sorted(r.w for r in items.select(F.least("n", F.lit(MIN_TILE)).alias("w")).distinct().collect())
    hits = hit_table(docs, spark.sparkContext.broadcast(seed_filter(seeds)), widths, id_col, text_col)
    met = hits.select("row", F.explode("seeds").alias("h")).join(seeds, "h")
    pairs = met.groupBy("row", "item", "n").agg(F.sum("times").alias("m")).where(F.col("m") * F.least("n", F.lit(MIN_TILE)) >= threshold * F.col("n"))
    pairs = write_table(pairs.select("row", "item"), "pairs")
    both = pairs.join(hits.select("row", "name", "digest", "words"), "row").join(items.select("item", F.col("name").alias("item_name"), F.col("words").alias("own")), "item")
    kinds = [f"{c} {both.schema[c].dataType.simpleString()}" for c in ("name", "digest", "item_name")]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, coverage, n_tiles, n_matched = [], [], [], []
        for k, (words, own) in enumerate(zip(batch.column(3), batch.column(4))):
            item = (own.values.to_numpy().view(np.uint64) % np.uint64(_M)).astype(np.int64).tolist()
            marked = tiles(words.values.to_numpy().tolist(), item, min(MIN_TILE, len(item)))
            n = sum(t[2] for t in marked)
            if n >= threshold * len(item):
                at.append(k)
                coverage.append(n / len(item))
                n_tiles.append(len(marked))
                n_matched.append(n)
        if at:
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(3)]
            columns += [pa.array(coverage, pa.float64()), pa.array(n_tiles, pa.int32()), pa.array(n_matched, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "digest", "item_name", "coverage", "n_tiles", "n_matched"])

    return arrow_map(both.select("name", "digest", "item_name", "words", "own"), ", ".join(kinds) + ", coverage double, n_tiles int, n_matched int", lambda: step)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row (id, item_id, coverage, n_tiles, n_matched) for each document and item it contains.

    Words are runs of letters, digits and non-ASCII characters, in lower case.  A null or empty text
    has no rows; an item without words matches nothing, nor does one without an id; an item of one to four words matches where
    all its words stand together.  Two items of equal text both get their row.  Repeated document rows
    give repeated rows; null ids are kept.  An empty benchmark gives an empty result.
    """
    found = judged(docs, benchmark, threshold, id_col, text_col, item_col)
    return found.select(F.col("name").alias(id_col), F.col("item_name").alias(item_col), "coverage", "n_tiles", "n_matched")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item.

    Rows go by their own text: one with a null id goes like any other, and of rows that share an id only
    those that contain an item.  A null text stays.  Columns are those of ``docs``, whatever their names.
    """
    digest = F.unhex(F.substring(F.sha2(F.col(text_col), 256), 1, 32))
    return keep_unmatched(docs, digest, judged(docs, benchmark, threshold, id_col, text_col, item_col).select("digest"))
