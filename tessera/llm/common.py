"""What the operators share: the shared folder, written tables, Arrow maps and merged counters."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.tables import read, write_table

__all__ = ["arrow_map", "fold", "keep_matched", "keep_unmatched", "merge_stripes", "prepare", "read", "write_table"]

#: Bytes of one Arrow batch sent to Python; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20
#: Keys (of up to 16 bytes) that may be broadcast.
KEYS = 1 << 19


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once, and keep Arrow batches of whole texts small."""
    context = spark.sparkContext
    if not getattr(context, "_tessera_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(archive)
        context._tessera_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def give_back() -> None:
    """Return freed memory to the system: workers stay for the next stage, and would hold what this one needed at most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def arrow_map(df: DataFrame, schema: str | StructType, start: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """Map the batches of each partition; ``start`` runs once a task and returns the batch function.

    Where that function has an attribute ``end``, it is called after the last batch and may yield more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        end = getattr(step, "end", None)
        if end:
            yield from end()
        del step, end
        give_back()

    return df.mapInArrow(run, schema)


def fold(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; the remainder that a null id gets is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def merge_stripes(parts: DataFrame, decode: Callable[[bytes, np.ndarray], None], encode: Callable[[np.ndarray], bytes], size: int, dtype: str, stripes: int) -> dict[int, bytes]:
    """Merge rows (stripe int, part binary) of all tasks into one array a stripe, and bring the encoded stripes back.

    Each stripe is one task's streaming sum over at most one part a map task, in ``size`` cells, so
    memory is bounded by the stripe and what returns by ``stripes`` encoded stripes, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, part in zip(batch.column("stripe").to_pylist(), batch.column("part")):
                if stripe not in sums:
                    sums[stripe] = np.zeros(size, dtype)
                decode(part.as_py(), sums[stripe])
        for stripe, total in sums.items():
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32()), "part": pa.array([encode(total)], pa.binary())})

    merged = parts.repartition(stripes, "stripe").mapInArrow(run, "stripe int, part binary").collect()
    return {r.stripe: bytes(r.part) for r in merged}


def keep_unmatched(docs: DataFrame, key: F.Column, dropped: DataFrame, most: int = KEYS) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the one column of ``dropped``; a null key stays.

    The distinct keys are written and counted: up to ``most`` are broadcast, so that whole documents
    aren't shuffled; beyond it both sides are.
    """
    name = f"key_{uuid.uuid4().hex}"  # no column of any input
    keys = write_table(dropped.select(F.col(dropped.columns[0]).alias(name)).distinct(), "dropped")
    few = keys.limit(most + 1).count() <= most
    return docs.join(F.broadcast(keys) if few else keys, key == F.col(name), "left_anti")


def keep_matched(rows: DataFrame, keys: DataFrame, on: list[str], most: int = KEYS) -> DataFrame:
    """``rows`` whose columns ``on`` are among the distinct, written ``keys``: broadcast up to ``most``, so that whole texts aren't shuffled."""
    few = keys.limit(most + 1).count() <= most
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")
