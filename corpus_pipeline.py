"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. quality: documents that the positive-unlabelled classifier rejects go.
2. near_dedup: one document of each near-duplicate class stays, that of the smallest id.
3. substring_dedup: words of windows that an earlier document holds go from the text.
4. decontaminate: documents that contain a benchmark item go.
5. encode: the texts that are left, as byte-level BPE ids.

All stages but the last return the columns of ``documents``, whatever their names.  A row with a null id
is judged by its own text in stages 1 and 4, and stays as it is in stages 2 and 3; a null text is scored
as an empty one, is no duplicate, loses nothing, contains no item and has no ids.  Rows that repeat an id
are one document to stages 2 and 3.  An empty table passes through.  SQL can't express the learned
and hashed stages, so the tests hold each stage against a brute-force version.

Each stage's table is written and reread; once it is, the tables before it are deleted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, pu_quality, substring, tiling, weighted_minhash
from tessera.llm.common import prepare, read, write_table
from tessera.sources.tables import drop_tables, written

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep_good(docs, read(spark, sf_dir, "labels"), train=~pu_quality.held_out())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weighted_minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(prepare(spark), sf_dir, "documents"), []
    for name, stage in STAGES:
        before = len(written(spark))
        docs = write_table(stage(spark, docs, sf_dir), name)
        *scratch, table = written(spark)[before:]
        drop_tables(spark, last + scratch)
        last = [table]
    return docs
