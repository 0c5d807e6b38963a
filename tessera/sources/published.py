"""Tables that are verified before anyone can see them.

A version is written under the table's path, read back and checked, and only then named by the table's manifest, which is
how readers find it.  A version that fails its check is deleted and never named, so a broken table is never at
the path; a task or driver that dies leaves a version that nothing names.  Only one of two writers that don't
overwrite can make the manifest (an exclusive create); the other one fails and takes its version away.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_published"


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, a maker of its paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def version_of(spark: SparkSession, path: str) -> str | None:
    """The folder that the manifest names; None where nothing is published."""
    files, make = _files(spark, path)
    manifest = make(f"{path}/{MANIFEST}")
    if not files.exists(manifest):
        return None
    stream = files.open(manifest)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}/{name}" if name else None  # empty: its writer is at it


def _name(spark: SparkSession, path: str, version: str, overwrite: bool) -> None:
    files, make = _files(spark, path)
    try:
        stream = files.create(make(f"{path}/{MANIFEST}"), overwrite)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or files.exists(make(f"{path}/{MANIFEST}")):
            raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path} is already published") from None
        raise
    stream.write(version.encode())
    stream.close()


def publish(table: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, overwrite: bool = False) -> DataFrame:
    """Write ``table`` to ``path`` if ``check`` (which raises) accepts what was written; the published table.

    Without ``overwrite`` a published table is never replaced; with it the old version goes once the new one is named.
    """
    spark: SparkSession = table.sparkSession
    files, make = _files(spark, path)
    old = version_of(spark, path)
    if old and not overwrite:
        raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path} is already published")
    version = f"version-{uuid4().hex}"
    try:
        table.write.parquet(f"{path}/{version}")
        staged = spark.read.schema(table.schema).parquet(f"{path}/{version}")
        if check:
            check(staged)
        _name(spark, path, version, overwrite)
    except BaseException:
        files.delete(make(f"{path}/{version}"), True)
        raise
    if old:
        files.delete(make(old), True)
    return staged


def published(spark: SparkSession, path: str) -> DataFrame:
    version = version_of(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(version)


def same_rows(table: DataFrame) -> Callable[[DataFrame], None]:
    """A check that what was written is what was given: equal counts and sums of two row hashes, in one pass over each.

    ``table`` must give the same rows when it is computed again.
    """
    from pyspark.sql import functions as F

    def sums(t: DataFrame) -> tuple:
        columns = sorted(t.columns)
        each = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
        return tuple(t.agg(F.count("*"), *each).first())

    def check(staged: DataFrame) -> None:
        if sums(staged) != sums(table):
            raise OSError("what was written is not what was given")

    return check
