"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

A shingle is five consecutive words (lower case, punctuation aside); a text of one to four words is
one shingle.  Its weight is its count in the text times the mean inverse document frequency of its
words.  Document frequencies come from all documents, in a table of ``WORD_CELLS`` hashed words (a
fixed size, so it may be broadcast; words that share a cell share their frequency).

1. Equal texts are one: the smallest id stands for them.
2. ``BANDS`` x ``ROWS`` consistent weighted samples a text; texts that agree on a band share a bucket.
   Two samples agree as often as the similarity says, so a pair is a *candidate* if it shares a bucket
   and agrees in at least ``LEAST`` of all samples.  A pair at 0.8 isn't with a chance of 0.08 %.
3. In each bucket the candidates (hub, member) are verified by exact weighted Jaccard similarity.  The hub is
   the most central text, that with the largest buckets: of a text and its altered copies, the text
   itself, for an alteration breaks bands.  The hub then moves to the member nearest to it, ``CLIMBS``
   times, each time with all its candidates.  Verified links make components.
4. All candidates that are still of different components are verified, so every candidate is, but for those
   whose two texts are already of one class.  Where two blocks of a bucket's members have few of them,
   they are verified pair by pair; where they have many, the texts of the two blocks meet in one task
   and all similarities come from a matrix product over the shingles they share.

Scale: a row a document and band is shuffled, never a shingle.  Hubs are found by map-side minima, and
joins on documents, digests and buckets are sort-merge joins of written tables that adaptive execution can
split where they are hot.  In step 4 the members of a bucket meet as arrays of samples, in salted
blocks of about ``BLOCK``; rows of pairs are at most ``FEW`` a member and block.  A bucket of n unlinked
texts costs n * n / 2 comparisons in blocks, whatever its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, keep_matched, keep_unmatched, merge_stripes, prepare, write_table
from tessera.operators.graph import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
#: The rarest word weighs 1 + SPREAD times a word that every document holds.  A small spread keeps the
#: weighted similarity near the plain one, so that a few altered (hence rare) words don't part copies.
SPREAD = 0.5
#: Times that a bucket's hub moves to the text nearest to it.
CLIMBS = 2
#: Samples in which a candidate agrees at least, of BANDS * ROWS (at 0.8: all but 3 in 100,000).
LEAST = 14
#: Members of a bucket that are compared with as many others at a time (fewer, where their weights exceed ``WEIGHT``),
#: and candidates a member of two blocks from which on they are verified by a matrix product; columns of that at a time.
BLOCK, WEIGHT, FEW, COLUMNS = 1024, 1 << 20, 2, 4096
WORD_CELLS, STRIPES = 1 << 20, 16
_STRIPE = WORD_CELLS // STRIPES
_CELL_SHIFT = np.uint64(64 - 20)


def _words(data: np.ndarray, offsets: np.ndarray) -> kernel.Words:
    return kernel.words(data, offsets, kernel.NOT_ALNUM, lower=True)


def word_idf(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed and scaled inverse document frequency of each word cell, over all documents."""

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        counts = np.zeros(WORD_CELLS, np.int32)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                w = _words(data, offsets)
                keys = np.sort((kernel.owner(w.first).astype(np.int64) << 20) | (w.hashes >> _CELL_SHIFT).astype(np.int64))
                if len(keys):
                    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
                    np.add(counts, np.bincount(keys & (WORD_CELLS - 1), minlength=WORD_CELLS), out=counts, casting="unsafe")
            yield from ()

        def end() -> Iterator[pa.RecordBatch]:
            for s in range(STRIPES):
                part = counts[s * _STRIPE : (s + 1) * _STRIPE]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"stripe": pa.array([s], pa.int32()), "part": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

        step.end = end
        return step

    def add(part: bytes, total: np.ndarray) -> None:
        total += np.frombuffer(zlib.decompress(part), np.int32)

    found = merge_stripes(arrow_map(docs.select(text_col), "stripe int, part binary", start), add, lambda x: zlib.compress(x.tobytes(), 1), _STRIPE, "int64", STRIPES)
    df = np.zeros(WORD_CELLS, np.int64)
    for s, part in found.items():
        df[s * _STRIPE : (s + 1) * _STRIPE] = np.frombuffer(zlib.decompress(part), np.int64)
    n = docs.count() + 1
    return (1 + SPREAD * np.log(n / (df + 1)) / np.log(n + 1)).astype(np.float32)


def shingles(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each text, sorted by text and hash."""
    w = _words(data, offsets)
    at, h = kernel.windows(w.hashes, w.first, width)
    per_word = idf[(w.hashes >> _CELL_SHIFT).astype(np.int64)]
    text = kernel.owner(w.first)[at]
    weight = np.zeros(len(at), np.float32)
    for k in range(width):
        weight += per_word[at + k]
    weight /= width
    sizes = np.diff(w.first)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        extra_h, extra_w = [], []
        for i in short.tolist():
            own = slice(w.first[i], w.first[i + 1])
            _, one = kernel.windows(w.hashes[own], np.array([0, sizes[i]]), int(sizes[i]))
            extra_h.append(one[0] ^ np.uint64(sizes[i]))
            extra_w.append(per_word[own].mean(dtype=np.float32))
        text, h, weight = np.concatenate([text, short]), np.concatenate([h, np.array(extra_h, np.uint64)]), np.concatenate([weight, np.array(extra_w, np.float32)])
    order = np.argsort((text.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)), kind="stable")
    text, h, weight = text[order], h[order], weight[order]
    if not len(h):
        return text, h, weight
    at = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]))
    times = np.diff(np.append(at, len(h))).astype(np.float32)
    return text[at], h[at], weight[at] * times


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each run of shingles that begins at one of ``starts``: (runs, n)."""
    log_w = np.log(weight)
    lengths = np.diff(np.append(starts, len(h)))
    out = np.empty((len(starts), n), np.uint64)
    scale = np.float32(2.0**-24)
    low = np.uint64(0xFFFFFF)
    for k in range(n):
        x = kernel.mix(h ^ np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
        y = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        y ^= y >> np.uint64(28)
        u = [((v & low).astype(np.float32) + np.float32(0.5)) * scale for v in (x >> np.uint64(40), x >> np.uint64(16), y >> np.uint64(40), y >> np.uint64(16))]
        shift = (((x & np.uint64(0xFFFF)) << np.uint64(8)) | (y & np.uint64(0xFF))).astype(np.float32) * scale
        r = -np.log(u[0] * u[1])
        log_c = np.log(-np.log(u[2] * u[3]))
        t = np.floor(log_w / r + shift)
        log_a = log_c - r * (t - shift + np.float32(1))
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == np.repeat(least, lengths))
        run = np.searchsorted(starts, at, "right") - 1
        at = at[np.concatenate([[True], run[1:] != run[:-1]])]
        out[:, k] = kernel.mix(h[at] ^ kernel.mix(t[at].astype(np.int64).view(np.uint64)))
    return out


def band_keys(docs: DataFrame, idf, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, exact, bands, samples, total): each document with a digest of its text, its band keys (none without words), two bytes of each sample, and its shingles' weight."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys: list = [None] * batch.num_rows
        marks: list = [None] * batch.num_rows
        total = np.zeros(batch.num_rows)
        for lo, _, data, offsets in kernel.chunks(batch.column(2)):
            text, h, weight = shingles(data, offsets, idf.value)
            if not len(h):
                continue
            starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            drawn = samples(h, weight, starts, bands * rows).reshape(len(starts), bands, rows)
            key = np.zeros((len(starts), bands), np.uint64)
            for j in range(rows):
                key = kernel.mix(key * np.uint64(31) + drawn[:, :, j] + np.uint64(1))
            short = drawn.reshape(len(starts), bands * rows).astype(np.uint16).view(np.int16)
            for i, own, mark in zip(text[starts].tolist(), key.view(np.int64), short):
                keys[lo + i], marks[lo + i] = own, mark
            total[lo + text[starts]] = np.add.reduceat(weight.astype(np.float64), starts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int16())), pa.array(total)], ["doc", "exact", "bands", "samples", "total"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), _digest(text_col).alias("exact"), text_col)
    return arrow_map(source, "doc long, exact binary, bands array<long>, samples array<short>, total double", lambda: step)


def _digest(text_col: str) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.col(text_col), 256), 1, 32))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted distinct hashes, weights): sum of minima over sum of maxima."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    common = float(np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64)) if same.any() else 0.0
    total = float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common
    return common / total if total else 0.0


def measured(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, s): the exact weighted Jaccard similarity of each pair."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.zeros(batch.num_rows)
        last, left = None, None
        ids = batch.column(0).to_pylist()
        for i in range(batch.num_rows):
            if ids[i] != last:
                last, left = ids[i], _one(batch.column(2)[i].as_py(), idf.value)
            found[i] = similarity(left, _one(batch.column(3)[i].as_py(), idf.value))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "s"])

    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return arrow_map(both, "a long, b long, s double", lambda: step)


def _one(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, h, weight = shingles(data, np.array([0, len(data)], np.int64), idf)
    order = np.argsort(h)
    return h[order], weight[order]


def _stars(buckets: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b): the hub of each bucket with each other member that agrees in enough samples."""
    own = hubs.join(buckets.select("band", "key", F.col("doc").alias("a"), F.col("samples").alias("own")), ["band", "key", "a"])
    agree = F.size(F.filter(F.zip_with("samples", "own", lambda x, y: x == y), lambda x: x)) >= LEAST
    return buckets.join(own, ["band", "key"]).where((F.col("doc") != F.col("a")) & agree).select("a", F.col("doc").alias("b")).distinct()


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, component) after more links: components of the linked components alone."""
    left, right = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    ends = links.join(left, "a", "left").join(right, "b", "left")
    merged = components(write_table(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "ends"))
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(label, "node", "left_anti")
    every = label.union(fresh.select("node", F.col("node").alias("component")))
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return write_table(every.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def _candidates(buckets: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(a, b, left, right): the candidates of different components, as pairs or, where two blocks have many, as the members that have one.

    In each bucket the members outside its largest component meet all members, block by block.  The
    similarity is at most the ratio of the total weights.
    """
    own = buckets.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = own.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("total").alias("t"))
    main = F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("main")
    sums = [F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("t").alias("t"), F.count("*").alias("parts")]
    mixed = sizes.groupBy("band", "key").agg(main, *sums).where("parts > 1")
    heavy = F.col("t") / F.lit(WEIGHT)
    x, y = (F.ceil(F.greatest(n / F.lit(BLOCK), heavy)).cast("int") for n in (F.col("n"), F.col("n") - F.col("most")))
    cuts = write_table(mixed.select("band", "key", "main", x.alias("x"), y.alias("y")), "cuts")
    within = write_table(own.join(cuts, ["band", "key"]), "mixed")
    member = F.struct("doc", "component", "total", "samples")
    right = within.groupBy("band", "key", "main", F.pmod(F.xxhash64("doc"), "x").alias("i")).agg(F.collect_list(member).alias("members"))
    left = within.where("component <> main").groupBy("band", "key", F.pmod(F.xxhash64("doc", F.lit(1)), "y").alias("j")).agg(F.collect_list(member).alias("others"))
    met = write_table(right, "members").join(write_table(left, "others"), ["band", "key"]).select("main", "members", "others")

    def columns(block) -> tuple[np.ndarray, ...]:
        rows = block.values
        marks = rows.field("samples")
        return tuple(rows.field(c).to_numpy() for c in ("doc", "component", "total")) + (marks.flatten().to_numpy().reshape(len(rows), -1),)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for main, members, others in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            b, of_b, total_b, marks_b = columns(members)
            a, of_a, total_a, marks_a = columns(others)
            agree = np.zeros((len(a), len(b)), np.uint8)
            for k in range(marks_a.shape[1]):
                agree += marks_a[:, k, None] == marks_b[None, :, k]
            open_ = (agree >= LEAST) & (of_a[:, None] != of_b[None, :]) & ((of_b[None, :] == main) | (a[:, None] < b[None, :]))
            open_ &= np.minimum(total_a[:, None], total_b[None, :]) >= np.maximum(total_a[:, None], total_b[None, :]) * (threshold - 1e-4)
            i, j = np.nonzero(open_)
            if len(i) > FEW * (len(a) + len(b)):
                two = [a[np.unique(i)]], [b[np.unique(j)]]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array(x, lists) for x in two)], ["a", "b", "left", "right"])
            elif len(i):
                n = len(i)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.nulls(n, lists), pa.nulls(n, lists)], ["a", "b", "left", "right"])

    return write_table(arrow_map(met, "a long, b long, left array<long>, right array<long>", lambda: step), "candidates")


def similarities(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weighted Jaccard similarity of each of ``left`` to each of ``right`` (hashes, weights), up to rounding.

    A shingle's weight is its count times one value, so a shingle and its how-manieth time together are
    an element of a plain weighted set, and common weights are a product of 0/1 matrices.
    """
    every = left + right
    of = np.repeat(np.arange(len(every)), [len(h) for h, _ in every])
    h, w = (np.concatenate([x[k] for x in every]) for k in (0, 1))
    order = np.lexsort((w, h))
    unit = np.empty(len(h))
    first = np.flatnonzero(np.diff(h[order], prepend=h[order][:1] + np.uint64(1)) != 0)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    unit[order] = w[order][first][run]  # the least weight of a shingle here
    times = w / unit
    shingle = np.empty(len(h), np.int64)
    shingle[order] = run
    # Where all counts are multiples of the least, levels of it are elements; others are compared as they are.
    inter = np.zeros((len(left), len(right)))
    whole = np.abs(times - np.round(times)) < 1e-3
    odd = np.zeros(len(first), bool)
    odd[shingle[~whole]] = True
    level, plain = 1, ~odd[shingle]
    while plain.any():
        mine = np.flatnonzero(plain & (times > level - 0.5))
        if not len(mine):
            break
        names, at = np.unique(shingle[mine], return_inverse=True)
        value = np.zeros(len(names))
        value[at] = unit[mine]
        for lo in range(0, len(names), COLUMNS):
            part = (at >= lo) & (at < lo + COLUMNS)
            matrix = np.zeros((len(every), min(COLUMNS, len(names) - lo)), np.float32)
            matrix[of[mine[part]], at[part] - lo] = np.sqrt(value[at[part]])
            inter += matrix[: len(left)] @ matrix[len(left) :].T
        level += 1
    for s in np.flatnonzero(odd).tolist():
        mine = np.flatnonzero(shingle == s)
        a, b = mine[of[mine] < len(left)], mine[of[mine] >= len(left)]
        inter[np.ix_(of[a], of[b] - len(left))] += np.minimum(w[a][:, None], w[b][None, :])
    total = np.array([x[1].sum(dtype=np.float64) for x in every])
    return inter / np.maximum(total[: len(left), None] + total[None, len(left) :] - inter, 1e-30)


def _dense_links(candidates: DataFrame, label: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b): links that join all components with a pair at the threshold within two blocks of many candidates."""
    blocks = write_table(candidates.where("left is not null").select(F.monotonically_increasing_id().alias("block"), "left", "right"), "blocks")
    sides = [blocks.select("block", F.explode(c).alias("doc"), F.lit(n).alias("side")) for n, c in enumerate(("left", "right"))]
    known = label.select(F.col("node").alias("doc"), "component")
    rows = sides[0].unionByName(sides[1]).join(texts, "doc").join(known, "doc", "left")
    rows = rows.select("block", F.struct("side", "doc", F.coalesce("component", "doc").alias("component"), "text").alias("row"))
    met = rows.groupBy("block").agg(F.collect_list("row").alias("rows")).select("rows")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in batch.column(0):
            side, doc, component = (block.values.field(c).to_numpy() for c in ("side", "doc", "component"))
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, text in zip(doc.tolist(), block.values.field("text")):
                if i not in held:
                    held[i] = _one(text.as_py(), idf.value)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = similarities([held[i] for i in doc[a].tolist()], [held[i] for i in doc[b].tolist()])
            i, j = np.nonzero((found >= threshold - 1e-4) & (component[a][:, None] != component[b][None, :]))
            top: dict[int, int] = {}

            def root(x: int) -> int:
                while top.setdefault(x, x) != x:
                    x = top[x]
                return x

            out = []
            for x, y in zip(a[i].tolist(), b[j].tolist()):
                u, v = root(int(component[x])), root(int(component[y]))
                if u != v and similarity(held[int(doc[x])], held[int(doc[y])]) >= threshold:
                    top[u] = v
                    out.append((doc[x], doc[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])

    return arrow_map(met, "a long, b long", lambda: step)


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id), a row a document row: the class is the smallest id among its near-duplicates.

    A text that is null, or has no word and no equal text, is a class of its own, as is a null text
    whatever others there are.  A null id has a null class.  Rows that repeat an id are one document: of
    its texts that of the smallest digest is compared.  Ties don't arise (the smallest id stands for a
    group).  An empty table gives an empty result.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    idf = spark.sparkContext.broadcast(word_idf(docs, text_col))
    keyed = write_table(band_keys(docs, idf, id_col, text_col, bands, rows), "bands")
    copies = keyed.where(F.col("exact").isNotNull()).groupBy("exact").agg(F.min("doc").alias("same"), F.count("*").alias("n")).where("n > 1")
    stands = write_table(keyed.join(write_table(copies.drop("n"), "copies"), "exact", "left").withColumn("same", F.coalesce("same", "doc")), "stands")
    texts_of = stands.where((F.col("doc") == F.col("same")) & F.col("bands").isNotNull())
    single = texts_of.groupBy("doc").agg(F.min(F.struct("exact", "bands", "samples", "total")).alias("t")).select("doc", "t.*")
    single = write_table(single, "single")
    one = write_table(single.select("doc", F.posexplode("bands").alias("band", "key")), "one")
    shared = one.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = write_table(one.join(write_table(shared, "sizes"), ["band", "key"]), "met")
    central = met.groupBy("doc").agg(F.sum("n").alias("c"))
    buckets = write_table(met.join(single.select("doc", "exact", "samples", "total"), "doc"), "buckets")
    hubs = write_table(buckets.join(central, "doc").groupBy("band", "key").agg(F.max_by("doc", F.struct(F.col("c"), -F.col("doc"))).alias("a")), "hubs")
    wanted = write_table(buckets.select("doc", "exact").distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), _digest(text_col).alias("exact"), F.col(text_col).alias("text"))
    texts = keep_matched(texts, wanted, ["doc", "exact"])
    if wanted.count() < texts.count():  # rows that are given twice
        texts = texts.dropDuplicates(["doc"])
    texts = write_table(texts.select("doc", "text"), "texts")
    used = hubs
    known = write_table(measured(_stars(buckets, hubs), texts, idf), "pairs")
    for _ in range(CLIMBS):
        either = known.union(known.select("b", "a", "s"))
        near = buckets.select("band", "key", "doc").join(hubs, ["band", "key"]).join(either.withColumnRenamed("b", "doc"), ["a", "doc"]).select("band", "key", "doc", "s")
        free = near.join(used.withColumnRenamed("a", "doc"), ["band", "key", "doc"], "left_anti")
        hubs = write_table(free.groupBy("band", "key").agg(F.max_by("doc", F.struct(F.col("s"), -F.col("doc"))).alias("a")), "hubs")
        pairs = _stars(buckets, hubs).join(either.select("a", "b"), ["a", "b"], "left_anti")
        known = known.union(write_table(measured(pairs, texts, idf), "pairs"))
        used = used.union(hubs)
    label = components(write_table(known.where(F.col("s") >= threshold).select("a", "b"), "links"))
    found = _candidates(buckets, label, threshold)
    done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = found.where("left is null").select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
    links = measured(pairs, texts, idf).where(F.col("s") >= threshold).select("a", "b")
    links = write_table(links, "links").union(write_table(_dense_links(found, label, texts, idf, threshold), "links"))
    if not links.isEmpty():
        label = _joined(label, links)
    found = stands.join(label, stands["same"] == label["node"], "left").select(F.col("doc").alias(id_col), F.coalesce("component", "same").alias("class_id"))
    missing = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long"), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(missing)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that of the smallest id; null ids stay."""
    dropped = classes(docs, threshold, id_col, text_col).where(F.col(id_col) != F.col("class_id")).select(id_col)
    return keep_unmatched(docs, F.col(id_col).cast("long"), dropped)
