"""URL filters by Bloom filter cascades: exact membership in lists, without a join.

A url asks for *keys*: each suffix of its host at a label boundary, with each prefix of its path
whose length some listed rule has.  The keys that all urls of the corpus ask for are the complete
universe.  Each verdict has a list, and each list a cascade.  Level 1 of a cascade is a Bloom filter
of the listed keys; level 2 holds the keys of the universe that level 1 wrongly passes; level 3 the
listed keys that level 2 wrongly passes, and so on until a level passes nothing wrongly.  A key is
listed if the first level that rejects it is an even one (counting from 1), so every answer about a
key of the universe is exact.

Scale: level 1 is sized so that its false positives over the universe are about as many as the
listed keys.  A cascade therefore takes about ``1.44 * log2(universe / listed)`` bits a listed key:
its size is bounded by the list, not by the corpus, and it alone is broadcast; the keys of the lists
stay on the driver.  The universe is written once and never collected; each level is one distributed
pass over it that returns only false positives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import arrow_map, prepare, write_table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def key_hashes(keys: list[str]) -> np.ndarray:
    data = [k.encode() for k in keys]
    ends = np.cumsum([len(k) for k in data]) if data else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if data else ends
    return kernel.span_hashes(np.frombuffer(b"".join(data), np.uint8), starts, ends)


class Bloom:
    """A Bloom filter over 64-bit hashes; ``salt`` makes the levels independent."""

    def __init__(self, hashes: np.ndarray, rate: float, salt: int) -> None:
        n = max(1, len(hashes))
        self.salt = np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        self.probes = max(1, round(-np.log2(rate)))
        self.bits = max(64, int(np.ceil(n * self.probes / np.log(2))))
        self.set = np.zeros(self.bits, bool)
        for at in self._places(hashes):
            self.set[at] = True

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        x = kernel.mix(hashes ^ self.salt)
        step = kernel.mix(x) | np.uint64(1)
        for i in range(self.probes):
            yield ((x + np.uint64(i) * step) % np.uint64(self.bits)).astype(np.int64)

    def __contains__(self, hashes: np.ndarray) -> np.ndarray:
        raise TypeError("use passes()")

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= self.set[at]
        return out


def listed(levels: list[Bloom], hashes: np.ndarray) -> np.ndarray:
    """Whether each key is listed: exact for every key of the universe the cascade was built over."""
    answer = np.zeros(len(hashes), bool)
    open_ = np.arange(len(hashes))
    for i, level in enumerate(levels):
        passed = level.passes(hashes[open_])
        answer[open_[~passed]] = i % 2 == 1
        open_ = open_[passed]
    answer[open_] = len(levels) % 2 == 1
    return answer


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path up to ``?``, ``#`` or the end.  Null or no ``://``: both empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((x for x in (rest.find("?"), rest.find("#")) if x >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def keys_of(host: str, path: str, lengths: Iterable[int]) -> list[str]:
    """The keys a url asks for, longest first (by length of the key, then of its host)."""
    if not host:
        return []
    labels = [host]
    while (dot := labels[-1].find(".")) >= 0:
        labels.append(labels[-1][dot + 1 :])
    found = [(len(h) + n, len(h), h + path[:n]) for h in labels if h for n in lengths if n <= len(path)]
    return [k for _, _, k in sorted(found, key=lambda x: (-x[0], -x[1]))]


def universe(urls: DataFrame, url_col: str, lengths: list[int]) -> DataFrame:
    """The distinct keys that ``urls`` ask for, written once."""

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = {k for u in batch.column(0).to_pylist() for k in keys_of(*split_url(u), lengths)}
        yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(keys), pa.string())})

    return write_table(arrow_map(urls.select(url_col), "key string", lambda: ask).distinct(), "universe")


def build(keys: DataFrame, size: int, want: list[str]) -> list[Bloom]:
    """The cascade that tells the keys of the list from all others of the universe ``keys``, which has ``size``."""
    own = kernel.Lookup(np.unique(key_hashes(sorted(set(want)))))
    inside = own.hashes
    rate = min(0.5, max(len(inside), 1) / max(size, 1))
    sent = keys.sparkSession.sparkContext.broadcast(own)
    levels: list[Bloom] = []
    while True:
        i = len(levels)
        if i % 2 == 0:
            if i:
                inside = inside[levels[-1].passes(inside)]
                if not len(inside):
                    return levels
            levels.append(Bloom(inside, rate if i == 0 else 0.5, i + 1))
            continue
        so_far = keys.sparkSession.sparkContext.broadcast(levels)

        def wrong(batch: pa.RecordBatch, so_far=so_far) -> Iterator[pa.RecordBatch]:
            hashes = key_hashes(batch.column(0).to_pylist())
            passed = sent.value.find(hashes) < 0
            for level in so_far.value:
                passed &= level.passes(hashes)
            yield pa.RecordBatch.from_pydict({"h": pa.array(hashes[passed].view(np.int64))})

        false = arrow_map(keys, "h long", lambda: wrong).toArrow().column(0).to_numpy().view(np.uint64)
        if not len(false):
            return levels
        levels.append(Bloom(false, 0.5, i + 1))


def judge(urls: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, otherwise: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict: the longest rule that fits decides, else ``otherwise``.

    A null url, or one without ``://``, has an empty host and path, no rule, and the verdict
    ``otherwise`` (its key is not in a list).  Of rules with the same key the last counts.  Columns of
    those four names in the input are replaced.  Repeated rows get equal answers; an empty table gives an empty result.
    """
    spark = prepare(urls.sparkSession).sparkContext
    verdict = {r.host + r.path: r.verdict for r in rules}
    lengths = sorted({len(r.path) for r in rules})
    keys = universe(urls, url_col, lengths)
    size = keys.count()
    lists = {v: [k for k, own in verdict.items() if own == v] for v in sorted(set(verdict.values()))}
    sent = spark.broadcast({v: build(keys, size, own) for v, own in lists.items()})
    rest = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    frame = urls.select(*rest) if url_col in rest else urls.select(*rest, url_col)
    at_url, kept = frame.columns.index(url_col), [frame.columns.index(c) for c in rest]

    def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pairs = [split_url(u) for u in batch.column(at_url).to_pylist()]
        asked = [keys_of(h, p, lengths) for h, p in pairs]
        flat = [k for own in asked for k in own]
        hashes = key_hashes(flat)
        of = np.full(len(flat), -1)
        names = list(sent.value)
        for n, name in enumerate(names):
            of[listed(sent.value[name], hashes)] = n
        found, verdicts, at = [], [], 0
        for own in asked:
            hits = np.flatnonzero(of[at : at + len(own)] >= 0)
            found.append(own[hits[0]] if len(hits) else None)
            verdicts.append(names[of[at + hits[0]]] if len(hits) else otherwise)
            at += len(own)
        columns = [batch.column(c) for c in kept]
        columns += [pa.array([h for h, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string()), pa.array(found, pa.string()), pa.array(verdicts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*rest, "host", "path", "rule", "verdict"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name in rest)
    return arrow_map(frame, f"{schema}host string, path string, rule string, verdict string", lambda: apply)


def urls_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id"), F.col("url"))
