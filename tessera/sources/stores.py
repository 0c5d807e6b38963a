"""Stored results: the binned cache with its fingerprint, label tables, and write-once tables."""

from __future__ import annotations

import hashlib
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.binning import rank_bin
from tessera.operators.lookups import require_vectors
from tessera.sources.published import publish, published, same_rows, version_of

CACHE_VERSION = 1


def fingerprint(expr: DataFrame, bins: int, seed: int) -> dict[str, str]:
    """What a cache depends on: sizes, parameters, feature names, and a sum over all values' hashes (so a change of
    values is seen)."""
    row = expr.agg(F.count_distinct("sample").alias("samples"), F.count_distinct("feature").alias("features"), F.sum(F.xxhash64("sample", "feature", "v").cast("decimal(20,0)")).alias("values")).first()
    named = expr.select(F.col("feature").cast("string").alias("f")).distinct()
    names = named.agg(F.sum(F.xxhash64("f").cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64("f", F.lit(1)).cast("decimal(20,0)")).alias("b")).first()
    return {"cache_version": str(CACHE_VERSION), "n_samples": str(row.samples), "n_features": str(row.features), "num_bins": str(bins), "bin_seed": str(seed), "names": f"{names.a}/{names.b}", "values": str(row["values"])}


def load_or_build(expr: DataFrame, path: str, bins: int = 10, seed: int = 0) -> DataFrame:
    """The binned table of this fingerprint under ``path``, built, checked and published there first if it is missing.

    Tokens lie under the digest of their fingerprint, so they are never found under another's; a build that was broken
    off was never published.  Where two builders meet, the first one's table stands.
    """
    spark: SparkSession = expr.sparkSession
    want = fingerprint(expr, bins, seed)
    own = f"{path}/{hashlib.sha1(repr(sorted(want.items())).encode()).hexdigest()[:16]}"
    if version_of(spark, own) is None:

        def whole(staged: DataFrame) -> None:
            row = staged.agg(F.count_distinct("sample").alias("samples"), F.min("bin").alias("low"), F.max("bin").alias("high")).first()
            if str(row.samples) != want["n_samples"] or not (row.samples == 0 or 1 <= row.low <= row.high <= bins):
                raise OSError("the binned table doesn't hold the samples and bins of its source")

        with suppress(FileExistsError):
            publish(rank_bin(expr, bins, seed), own, whole)
    return published(spark, own)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Write (accession, vector); all vectors must be of one length, which is how a reader knows it."""
    if vectors.select(F.size("vector")).distinct().limit(2).count() > 1:
        raise ValueError("the vectors differ in length")
    vectors.select("accession", "vector").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, accessions: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((accession, vector), their length); with ``accessions`` each of these must have a vector."""
    found = spark.read.parquet(path)
    first = found.select(F.size("vector").alias("n")).first()
    if accessions is not None:
        found = require_vectors(accessions.select("accession").distinct(), found, "accession")
    return found, first.n if first else 0


def save_labels(coded: DataFrame, path: str, overwrite: bool = False) -> None:
    """Publish label tables (kind, i, j) once what was written is what was given; refuses to overwrite unless told to."""
    publish(coded, path, same_rows(coded), overwrite)


def load_labels(spark: SparkSession, path: str, order: DataFrame | None = None) -> DataFrame:
    """Label tables; with an order table (idx, protein) the universe must lie within it."""
    coded = published(spark, path)
    if order is not None and not coded.where("kind = 'universe'").join(order, coded["i"] == order["idx"], "left_anti").isEmpty():
        raise ValueError("the universe names an index outside the protein order")
    return coded


def write_once(table: DataFrame, path: str, key: str) -> None:
    """Publish a table whose key is unique among the rows written; refuses to overwrite, and of two writers one fails."""

    def unique(staged: DataFrame) -> None:
        n, distinct = staged.agg(F.count("*"), F.count_distinct(key)).first()
        if n != distinct:
            raise ValueError(f"{key} is not unique: {n} rows, {distinct} keys")

    publish(table, path, unique)
