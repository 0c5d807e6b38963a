"""Sparse and dense arrays in ``.npy`` files as a data source of rows (sample, feature, v), and compressed label arrays.

``csr_rows`` reads a folder of ``indptr.npy``, ``indices.npy`` and ``data.npy`` (compressed rows), or of
``dense.npy`` (a matrix; zeros are left out), or of numbered blocks of the first form and a manifest, as its writer makes.
Work is planned by entries, not rows: the first and last row wanted are looked up in ``indptr``, and what lies between is
cut into runs of ``entries`` entries, so a range reads only its own part of each file and a row may be many tasks.
The range is an option of the read (``first``, and ``last`` exclusive) and not a pushed filter: Spark 4.1 keeps what one scan of
a Python source was pushed for every other scan of the same frame, which then lacks rows.  Nothing is read whole, on the
driver neither: an ``indptr`` is searched in place.

``label_arrays`` reads ``.npz`` files of a label matrix in either published form, the compact one (universe,
rows, cols, shape) or the dense one (matrix), as one label table (db, kind, i, j); see ``LabelArrays``.

Files are opened by their own place (a path or a URI that ``pyarrow.fs`` knows) on driver and executors.
"""

from __future__ import annotations

import json
import os
import zipfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.sources.tables import ship

#: Entries of a task, and of a batch.
ENTRIES, BATCH = 1 << 22, 1 << 16
MANIFEST = "manifest.json"
SCHEMA = "sample long, feature long, v double"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Npy:
    """One array in a file, read by ranges of its first axis."""

    def __init__(self, path: str) -> None:
        files, place = opened(path)
        self.file = files.open_input_file(place)
        version = np.lib.format.read_magic(self.file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.file)
        if fortran and len(self.shape) > 1:
            raise ValueError(f"{path}: columns come first in this file; rows can't be read by range")
        self.start = self.file.tell()
        self.step = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])

    def read(self, lo: int, hi: int) -> np.ndarray:
        self.file.seek(self.start + lo * self.step)
        return np.frombuffer(self.file.read((hi - lo) * self.step), self.dtype).reshape(hi - lo, *self.shape[1:])


@dataclass
class Run(InputPartition):
    """Entries ``lo``..``hi`` of a block whose first row is sample ``first`` (a dense block: its rows)."""

    block: str
    first: int
    lo: int
    hi: int
    dense: bool = False


class CsrReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.entries = options["path"].rstrip("/"), int(options.get("entries", ENTRIES))
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", 1 << 62))  # the samples wanted

    def blocks(self) -> list[tuple[str, int, int]]:
        """(folder, first sample, rows) of each block."""
        files, place = opened(self.path)
        kinds = {name: files.get_file_info(f"{place}/{name}").type != fs.FileType.NotFound for name in (MANIFEST, "indptr.npy", "dense.npy")}
        if kinds[MANIFEST]:
            with files.open_input_file(f"{place}/{MANIFEST}") as f:
                found = json.loads(f.read())
            return [(f"{self.path}/{b['block']}", b["first"], b["rows"]) for b in found["blocks"]]
        if kinds["indptr.npy"]:
            return [(self.path, 0, len(Npy(f"{self.path}/indptr.npy")) - 1)]
        if kinds["dense.npy"]:
            return [(self.path, 0, -1)]
        raise FileNotFoundError(f"{self.path} holds neither a manifest nor indptr.npy or dense.npy")

    def partitions(self) -> list[Run]:
        runs = []
        for folder, first, rows in self.blocks():
            if rows < 0:
                dense = Npy(f"{folder}/dense.npy")
                step = max(1, self.entries // max(1, dense.shape[1]))
                runs += [Run(folder, 0, lo, min(lo + step, self.high, len(dense)), True) for lo in range(min(self.low, len(dense)), min(self.high, len(dense)), step)]
                continue
            a, b = max(self.low - first, 0), min(self.high - first, rows)
            if a < b:
                indptr = Npy(f"{folder}/indptr.npy")
                start, end = indptr[a], indptr[b]
                runs += [Run(folder, first, lo, min(lo + self.entries, end)) for lo in range(start, end, self.entries)]
        return runs or [Run("", 0, 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.lo >= p.hi:
            return
        if p.dense:
            yield from self.dense(p)
            return
        indptr, indices, data = (Npy(f"{p.block}/{n}.npy") for n in ("indptr", "indices", "data"))
        row = bisect_right(indptr, p.lo) - 1
        for lo in range(p.lo, p.hi, BATCH):
            hi = min(lo + BATCH, p.hi)
            last = bisect_left(indptr, hi, row)  # the first row that starts at or after the end
            ends = indptr.read(row + 1, last + 1)
            sample = row + np.searchsorted(ends, np.arange(lo, hi), "right")
            yield batch(sample + p.first, indices.read(lo, hi), data.read(lo, hi))
            row = int(sample[-1])

    def dense(self, p: Run) -> Iterator[pa.RecordBatch]:
        array = Npy(f"{p.block}/dense.npy")
        step = max(1, BATCH // max(1, array.shape[1]))
        for lo in range(p.lo, p.hi, step):
            part = array.read(lo, min(lo + step, p.hi))
            rows, columns = np.nonzero(part)
            yield batch(rows + lo, columns, part[rows, columns])


def batch(sample: np.ndarray, feature: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sample.astype(np.int64)), pa.array(feature.astype(np.int64)), pa.array(v.astype(np.float64))], ["sample", "feature", "v"])


@dataclass
class Written(WriterCommitMessage):
    blocks: list


class CsrWriter(DataSourceArrowWriter):
    """Rows that come in order of (sample, feature) in each task, as blocks of up to ``entries`` entries; the manifest comes last."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.entries, self.overwrite = options["path"].rstrip("/"), int(options.get("entries", ENTRIES)), overwrite
        self.version = f"blocks-{uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, place = opened(self.path)
        blocks, held, n = [], [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            sample, feature, v = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("sample", "feature", "v"))
            if (np.diff(sample) < 0).any():
                raise ValueError("rows don't come in the order of their samples")
            first, last = int(sample[0]), int(sample[-1])
            name = f"{self.version}/{uuid4().hex}"
            files.create_dir(f"{place}/{name}", recursive=True)
            arrays = {"indptr": np.searchsorted(sample, np.arange(first, last + 2)).astype(np.int64), "indices": feature.astype(np.int64), "data": v.astype(np.float64)}
            for file, array in arrays.items():
                with files.open_output_stream(f"{place}/{name}/{file}.npy") as out:
                    np.lib.format.write_array(out, array)
            blocks.append({"block": name, "first": first, "rows": last + 1 - first, "entries": len(sample)})
            held.clear()

        for part in iterator:
            while part.num_rows:
                take = min(part.num_rows, self.entries - n)
                held.append(part.slice(0, take))
                part, n = part.slice(take), n + take
                if n == self.entries:
                    flush()
                    n = 0
        if n:
            flush()
        return Written(blocks)

    def commit(self, messages: list[Written | None]) -> None:
        files, place = opened(self.path)
        target = f"{place}/{MANIFEST}"
        if not self.overwrite and files.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.path} already holds arrays")
        files.create_dir(place, recursive=True)
        staged = f"{place}/{self.version}.json"
        blocks = sorted((b for m in messages if m for b in m.blocks), key=lambda b: (b["first"], b["first"] + b["rows"]))
        with files.open_output_stream(staged) as out:
            out.write(json.dumps({"blocks": blocks}).encode())
        files.move(staged, target)

    def abort(self, messages: list[Written | None]) -> None:
        files, place = opened(self.path)
        if files.get_file_info(f"{place}/{self.version}").type != fs.FileType.NotFound:
            files.delete_dir(f"{place}/{self.version}")


class CsrRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CsrReader:
        return CsrReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        return CsrWriter(dict(self.options), overwrite)


# Label arrays ----------------------------------------------------------------------------------------


@dataclass
class Archive(InputPartition):
    path: str
    db: str


class Member:
    """One array of an archive, as a stream of its rows: compressed bytes can't be sought, so rows pass once, some at a time."""

    def __init__(self, file: zipfile.ZipFile, name: str) -> None:
        self.stream = file.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.fortran, self.dtype = read(self.stream)

    def rows(self, at_once: int) -> Iterator[np.ndarray]:
        n, rest = (self.shape[0] if self.shape else 1), self.shape[1:]
        step = self.dtype.itemsize * int(np.prod(rest, dtype=np.int64))
        for lo in range(0, n, at_once):
            size = min(at_once, n - lo)
            buffer = self.stream.read(size * step)
            if len(buffer) < size * step:
                raise ValueError("the array ends before its shape says so")
            yield np.frombuffer(buffer, self.dtype).reshape(size, *rest)

    def whole(self) -> np.ndarray:
        return np.concatenate(list(self.rows(BATCH)) or [np.zeros(0, self.dtype)])


class LabelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.suffix = options.get("suffix", "_ground_truth_matrix.npz")
        self.size = int(options["size"]) if "size" in options else None

    def partitions(self) -> list[Archive]:
        files, place = opened(self.path)
        info = files.get_file_info(place)
        if info.type == fs.FileType.File:
            return [Archive(self.path, os.path.basename(self.path).removesuffix(".npz").removesuffix(self.suffix.removesuffix(".npz")))]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(place)) if f.base_name.endswith(self.suffix))
        if not found:
            raise FileNotFoundError(f"no file of {self.path} ends in {self.suffix}")
        return [Archive(f"{self.path}/{f}", f.removesuffix(self.suffix)) for f in found]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        files, place = opened(partition.path)
        with files.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
            names = {n.removesuffix(".npy") for n in archive.namelist()}
            if "matrix" in names:
                found = self.dense(archive)
            elif {"universe", "rows", "cols", "shape"} <= names:
                found = self.compact(archive)
            else:
                raise ValueError(f"{partition.path} holds {sorted(names)}: neither form of a label matrix")
            for kind, i, j in found:
                other = pa.nulls(len(i), pa.int64()) if j is None else pa.array(j.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([partition.db] * len(i)), pa.array([kind] * len(i)), pa.array(i.astype(np.int64)), other], ["db", "kind", "i", "j"])

    def square(self, shape: tuple) -> int:
        if len(shape) != 2 or shape[0] != shape[1]:
            raise ValueError(f"expected a square matrix, got {tuple(shape)}")
        if self.size is not None and shape[0] != self.size:
            raise ValueError(f"the matrix is for {shape[0]} names, the order has {self.size}")
        return int(shape[0])

    def compact(self, archive: zipfile.ZipFile) -> Iterator[tuple]:
        n = self.square(tuple(Member(archive, "shape").whole().tolist()))
        universe = Member(archive, "universe").whole().astype(np.int64)
        inside = np.zeros(n, bool)
        if len(universe) and (universe.min() < 0 or universe.max() >= n):
            raise ValueError("the universe names a row outside the matrix")
        inside[universe] = True
        yield "universe", np.flatnonzero(inside), None
        balance = Balance(n)
        for i, j in zip(Member(archive, "rows").rows(BATCH), Member(archive, "cols").rows(BATCH), strict=True):
            i, j = i.astype(np.int64), j.astype(np.int64)
            if len(i) != len(j) or (i >= n).any() or (j >= n).any() or not (inside[i] & inside[j] & (i != j)).all():
                raise ValueError("a positive lies outside the universe or on the diagonal")
            yield balance.upper(i, j)
        balance.close()

    def dense(self, archive: zipfile.ZipFile) -> Iterator[tuple]:
        n = self.square(Member(archive, "matrix").shape)
        at_once = max(1, BATCH // max(1, n))
        known = np.concatenate([~np.isnan(part).all(1) for part in Member(archive, "matrix").rows(at_once)] or [np.zeros(0, bool)])
        yield "universe", np.flatnonzero(known), None
        balance, lo = Balance(n), 0
        for part in Member(archive, "matrix").rows(at_once):
            nan = np.isnan(part)
            if not np.isin(part[~nan], (0, 1)).all():
                raise ValueError("labels other than 0, 1 and unknown")
            here = np.arange(lo, lo + len(part))
            want = ~(known[here][:, None] & known[None, :])
            want[np.arange(len(part)), here] = True
            if (nan != want).any():
                raise ValueError("the unknown pairs are not those outside the universe and the diagonal")
            i, j = np.nonzero(part == 1)
            yield balance.upper(i + lo, j)
            lo += len(part)
        balance.close()


class Balance:
    """Whether the positives on both sides of the diagonal are the same, by sums of their hashes."""

    def __init__(self, n: int) -> None:
        self.n, self.sums = n, [0, 0]

    def upper(self, i: np.ndarray, j: np.ndarray) -> tuple:
        up = i < j
        for side, (a, b) in enumerate(((i[up], j[up]), (j[~up], i[~up]))):
            x = (a * self.n + b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            self.sums[side] += int((x * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64))
        return "positive", i[up], j[up]

    def close(self) -> None:
        if self.sums[0] % (1 << 64) != self.sums[1] % (1 << 64):
            raise ValueError("the positives are not symmetric")


class LabelArrays(DataSource):
    """(db, kind, i, j): the universe of each matrix (null j) and its positives i < j, whichever form a file has.

    ``path`` is a file or a folder of ``<db>_ground_truth_matrix.npz``; ``size`` is the number of names in the order that
    belongs to the matrices.  A shape that isn't square or isn't of that size, another label than 0, 1 and unknown,
    unknowns that the universe doesn't imply, and unequal halves raise.  A file is a task and passes through it some rows at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "label_arrays"

    def schema(self) -> str:
        return "db string, kind string, i long, j long"

    def reader(self, schema) -> LabelReader:
        return LabelReader(dict(self.options))


# Use ---------------------------------------------------------------------------------------------------


def register(spark: SparkSession) -> SparkSession:
    """Make both sources known to a session, and this package to its workers."""
    ship(spark)
    spark.dataSource.register(CsrRows)
    spark.dataSource.register(LabelArrays)
    return spark


def read_csr(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, entries: int = ENTRIES) -> DataFrame:
    """(sample, feature, v) of the samples from ``first`` to before ``last``, or of all."""
    options = {"entries": entries, "first": first, "last": last}
    return register(spark).read.format("csr_rows").options(**{k: v for k, v in options.items() if v is not None}).load(path)


def save_csr(expr: DataFrame, path: str, entries: int = ENTRIES, overwrite: bool = False) -> None:
    """Write (sample, feature, v) as blocks of compressed rows; samples are whole numbers from 0.

    Rows are dealt by ranges of (sample, feature), so a long sample is in several blocks.
    """
    register(expr.sparkSession)
    ordered = expr.select(*[expr[c].cast(t) for c, t in (("sample", "long"), ("feature", "long"), ("v", "double"))]).repartitionByRange("sample", "feature").sortWithinPartitions("sample", "feature")
    ordered.write.format("csr_rows").option("entries", entries).mode("overwrite" if overwrite else "append").save(path)


def read_label_arrays(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    reader = register(spark).read.format("label_arrays")
    return (reader if size is None else reader.option("size", size)).load(path)
