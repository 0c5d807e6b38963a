"""Extra columns whose names the operators use themselves, and nulls in every column."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, arc, bpe, gru_lm, pu_quality, substring, tiling, toxicity, url_cascade, weighted_minhash

NAMES = ("hashes", "runs", "h", "h1", "h2", "doc", "later", "bands", "band", "key", "node", "component", "score", "predicted", "features", "terms", "ids", "item_id", "part", "row", "id", "n", "a", "b", "class_id", "n_words")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (None, "x"), (None, None)], "doc_id long, text string")
    return rows.select("*", *[F.lit(None).cast("string").alias(n) if i % 2 else F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def test_text_operators(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), "score", "text", "terms")
    bench = docs.select(F.lit(5).cast("long").alias("item_id"), "text", "doc_id")
    assert substring.remove_repeats(docs, 3).count() == 5
    assert weighted_minhash.classes(docs).count() == 5
    assert weighted_minhash.keep_one(docs).count() == 4
    assert tiling.clean(docs, bench).columns == docs.columns
    assert pu_quality.score(docs, labels, F.lit(True)).count() == 5
    assert pu_quality.keep_good(docs, labels, F.lit(True)).columns == docs.columns
    assert toxicity.score(docs, labels, F.lit(True)).count() == 5
    assert gru_lm.score(docs, F.lit(True)).count() == 5
    assert bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 5


def test_other_operators(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), "key", "a", F.lit("x").alias("digest"), F.lit("y").alias("host"))
    assert arc.archive(pages).count() == 5
    assert url_cascade.judge(pages).count() == 5
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") < 3, F.array(F.lit(1.0), F.lit(2.0))).alias("embedding"), "id", F.lit(1).alias("v"), F.lit(2).alias("q"))
    assert ann.search(vectors, F.col("vec_id") == 1).count() == 1


def test_substring_dedup_with_its_own_names(spark):
    from tessera.llm import substring

    text = " ".join(f"w{i}" for i in range(20))
    names = ("__doc", "__hashes", "__runs", "of", "hashes", "runs", "n_words")
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, None)], "doc_id long, text string").withColumns({c: F.lit(7) for c in names})
    found = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert [found[i].n_removed for i in (1, 2, 3)] == [0, 20, 0] and found[2]["__doc"] == found[2]["__runs"] == 7 and found[2].n_words == 21


def test_ids_with_a_blank_in_their_name(spark):
    from tessera.llm import toxicity

    docs = spark.createDataFrame([(1, "good text"), (2, "bad word")], "`doc id` long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "`doc id` long, toxic int")
    assert toxicity.score(docs, labels, F.lit(True), id_col="doc id").count() == 2
