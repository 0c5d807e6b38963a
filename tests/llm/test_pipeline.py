"""The stages of the pipeline on what their predecessors kept."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe
from tessera.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"documents": docs.toPandas().set_index("doc_id")}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_table(stage(spark, docs, DATA), name)
        out[name] = docs.toPandas().set_index("doc_id")
    return out


def test_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        assert sorted(stages[name].columns) == sorted(stages["documents"].columns)
    for a, b in zip(names, names[1:]):
        assert set(stages[b].index) <= set(stages[a].index)


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")
    good = labels.index[labels.quality == 1]
    assert stages["quality"].index.isin(good).sum() >= 0.9 * stages["documents"].index.isin(good).sum()


def test_exact_copies_go(stages):
    kept = stages["near_dedup"]
    assert not kept.text[kept.text.str.len() > 0].duplicated().any()
    assert set(stages["quality"].text) - set(kept.text) or len(kept) == len(stages["quality"])


def test_encoding_equals_library(stages):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in stages["decontaminate"].text.items():
        ids = library.encode_ordinary(text)
        row = stages["encode"].loc[i]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(stages["encode"]) == len(stages["decontaminate"]) > 0


def test_near_dedup_equals_brute_force(spark, stages):
    from tessera.llm import weighted_minhash
    from test_text_operators import brute_classes

    rows = [(i, t) for i, t in stages["quality"].text.items()]
    idf = weighted_minhash.word_idf(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {i for i, c in brute_classes(rows, idf, 0.8).items() if i == c}
    assert set(stages["near_dedup"].index) == want


def test_substring_dedup_equals_brute_force(stages):
    from test_text_operators import brute_repeats

    rows = [(i, t) for i, t in stages["near_dedup"].text.items()]
    found = stages["substring_dedup"]
    for i, _, n_removed, sha in brute_repeats(rows, 13):
        text = found.text[i]
        assert hashlib.sha256(" ".join((text or "").encode().decode().split()).encode()).hexdigest() == sha or not n_removed
        assert (text == dict(rows)[i]) == (n_removed == 0) and found.n_chars[i] == len(text)


def test_decontaminate_equals_brute_force(spark, stages):
    """Every document that holds a whole item goes, and none that shares no five words with one does."""
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept, before = stages["decontaminate"], stages["substring_dedup"]

    def words(text):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())

    fives = {tuple(w[i : i + 5]) for w in map(words, items) for i in range(len(w) - 4)}
    for i, text in before.text.items():
        w = words(text)
        inside = f" {' '.join(w)} "
        if any(f" {' '.join(words(x))} " in inside for x in items):
            assert i not in kept.index
        elif not fives & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
            assert i in kept.index


def test_odd_rows_pass_each_stage(spark, tmp_path):
    """Nulls in any column, rows given twice, clashing names, empty and very long texts, and an empty table."""
    names = ("score", "predicted", "digest", "row", "name", "h1", "later", "class_id", "n_removed", "__key")
    rows = [(1, "w " * 50_000, None), (2, None, "en"), (2, None, "en"), (None, "one two three four five six seven", None), (3, "", "x"), (4, "one two three four five six seven", "en"), (4, "one two three four five six seven", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([(None, None) if table == "benchmark" else (None, None, None)], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, frame, str(tmp_path))
            assert found.columns == docs.columns
            assert found.count() == (0 if frame is not docs else len(rows))  # without a label or an item nothing goes
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "2", "3", "4", "4", "None"]


def test_run_drops_what_it_no_longer_reads(spark):
    from tessera.sources.tables import written

    before = len(written(spark))
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert len(written(spark)) == before + 1


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
