"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier 1: a minimal perfect hash (hash and displace) over the vocabulary resolves a whole pre-token
that is a vocabulary entry.  Tier 2: the others are merged by a heap of adjacent pairs over bytes
in a linked list, lowest rank first and leftmost on ties.  Both tables are bounded by the
vocabulary.  Encoding is one map over the texts: no shuffle, and nothing grows with the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm import kernel
from tessera.llm.common import arrow_map, prepare

#: Distinct pre-tokens whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file of lines ``base64-token rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys in n slots, and the keys to verify a hit."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n)
        hashes = self._hash(keys)
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        bounds = np.searchsorted((hashes % np.uint64(self.buckets))[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.zeros(n, np.int64)
        used = np.zeros(n, bool)
        sizes = np.diff(bounds)
        by_size = np.argsort(-sizes, kind="stable")
        for bucket in by_size[sizes[by_size] > 1]:
            members = order[bounds[bucket] : bounds[bucket + 1]]
            d = 0
            while True:
                d += 1
                slots = self._slots(hashes[members], d)
                if not used[slots].any() and len(set(slots.tolist())) == len(members):
                    break
            used[slots] = True
            self.shift[bucket], self.slot_key[slots] = d, members
        free = np.flatnonzero(~used)
        single = by_size[sizes[by_size] == 1]
        self.shift[single] = -free[: len(single)] - 1
        self.slot_key[free[: len(single)]] = order[bounds[single]]
        self.keys = [keys[i] for i in self.slot_key]

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
        return kernel.span_hashes(np.frombuffer(b"".join(keys), np.uint8), ends - np.fromiter(map(len, keys), np.int64, len(keys)), ends)

    def _slots(self, hashes: np.ndarray, d: int | np.ndarray) -> np.ndarray:
        salt = np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (kernel.mix(hashes ^ salt) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The index (in the list given at the start) of each key, -1 for one that isn't there."""
        if not keys:
            return []
        hashes = self._hash(keys)
        d = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, self._slots(hashes, np.maximum(d, 0)))
        own = self.keys
        return [int(i) if own[s] == k else -1 for s, i, k in zip(slots.tolist(), self.slot_key[slots].tolist(), keys)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by merging its bytes: a heap of pair ranks over a linked list of parts."""
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that starts here
    left, pair = list(range(-1, n - 1)), [-1] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            pair[i] = rank
            heap.append((rank, i))
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if pair[i] != rank:
            continue
        j = ends[i]
        end = ends[i] = ends[j]
        pair[j] = pair[i] = -1
        if end < n:
            left[end] = i
            rank = ranks.get(piece[i : ends[end]])
            if rank is not None:
                pair[i] = rank
                heapq.heappush(heap, (rank, i))
        k = left[i]
        if k >= 0:
            rank = ranks.get(piece[k:end])
            if rank is None:
                pair[k] = -1
            else:
                pair[k] = rank
                heapq.heappush(heap, (rank, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Codec:
    """Encodes and decodes whole texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.first_tier = PerfectHash(self.tokens)
        self.reset()

    def reset(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.by_id = {i: t for t, i in self.ranks.items()}
        self.known: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "by_id", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.reset()

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for piece, key, i in zip(pieces, raw, self.first_tier.find(raw)):
            ids = [self.ranks[self.tokens[i]]] if i >= 0 else merge_bytes(key, self.ranks)
            self.known[piece] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            self.learn(new)
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and decoded (the text decoded from the ids), and ids.

    A null text is encoded as an empty one (no ids); every other text is encoded whole, without
    special tokens.  Columns of those names in the input are replaced; with ``keep_ids`` false the two
    large columns ids (array<int>) and decoded (string) are left out.  Repeated rows get equal rows.
    """
    spark = prepare(docs.sparkSession)
    codec = spark.sparkContext.broadcast(Codec(load_ranks(vocabulary), pattern))
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    rest = [f for f in docs.schema if f.name not in made]
    keep = [f.name for f in rest if keep_ids or f.name != text_col]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec.value
        n, sha, back, all_ids, all_text = [], [], [], [], []
        for text in batch.column(batch.schema.get_field_index(text_col)):
            ids = own.encode(text.as_py() or "")
            decoded = own.decode(ids)
            n.append(len(ids) // 4)
            sha.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(decoded).hexdigest())
            if keep_ids:
                all_ids.append(np.frombuffer(ids, "<i4"))
                all_text.append(decoded.decode("utf-8", "replace"))
        columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
        if keep_ids:
            columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*keep, *made[: 5 if keep_ids else 3]])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest if f.name in keep)
    schema += "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return arrow_map(docs.select(*[f.name for f in rest]), schema, lambda: step)
