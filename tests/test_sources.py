import gzip

import pytest
from pyspark.sql import functions as F

from tessera.operators import binning, pairs
from tessera.sources import parsers, stores


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_gaf(spark):
    def row(qualifier, n=15):
        f = [f"c{i}" for i in range(n)]
        f[3], f[6] = qualifier, "IDA"
        return "\t".join(f)

    found = parsers.parse_gaf(lines(spark, "!comment", row("part_of"), row("not|x", 17), row("NOT", 16), row("short", 14)))
    assert found.count() == 3 and len(found.columns) == 17
    assert {r.product_form for r in found.collect()} == {"", "c16"}
    assert parsers.drop_negated(found).count() == 1
    assert parsers.drop_negated(found, any_case=False).count() == 2
    assert parsers.keep_evidence(found, ["IEA"]).count() == 0


def test_pathways_and_two_columns(spark):
    found = parsers.parse_pathways(lines(spark, " P1\tR1\tu\tn \tTAS\tHomo sapiens", "a\tb", "P2\tR1\tu\tn\tTAS\tMus"), "Homo sapiens").collect()
    assert [(r.accession, r.name) for r in found] == [("P1", "n")]
    assert [tuple(r) for r in parsers.parse_two_columns(lines(spark, "", "a\tb", "a\tb\tc", "x")).collect()] == [("a", "b")]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|A_H GN=ABC OS=x\nMKV\nLL\n>sp|P2|B_H\nAA\n>sp|P1|A_H GN=NEW\nM\n")
    found = {r.accession: (r.gene, r.length, r.sequence) for r in parsers.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert found == {"P1": ("NEW", 1, "M"), "P2": (None, 2, "AA")}


def test_separated_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write("a\tb\nx\t1\n")
    assert [tuple(r) for r in parsers.read_separated(spark, str(tmp_path / "a.tsv.gz"), "a string, b int").collect()] == [("x", 1)]


def test_spectra_and_crossrefs(spark):
    psms = spark.createDataFrame([("r", False, ["P1", "P2"]), ("r", True, ["P1"]), ("r", None, ["CON__P3", "P1"])], "run string, is_decoy boolean, proteins array<string>")
    assert {r.accession: r.n for r in parsers.spectrum_counts(psms).collect()} == {"P1": 2, "P2": 1}
    refs = spark.createDataFrame([("P1", "x ENSG01.4; ENSG02")], "acc string, t string")
    assert sorted(map(tuple, parsers.gene_crossrefs(refs, "acc", "t").collect())) == [("ENSG01", "P1"), ("ENSG02", "P1")]


def test_dense(spark):
    found = parsers.dense_to_long(spark.createDataFrame([(1, [0.0, 2.0, -1.0])], "sample long, values array<double>"))
    assert [tuple(r) for r in found.collect()] == [(1, 2, 2.0)]


def test_cache_is_rebuilt_when_values_change(spark, tmp_path):
    def table(x):
        return spark.createDataFrame([(0, 1, 1.0), (0, 2, x)], "sample long, feature long, v double")

    path = str(tmp_path / "cache")
    first = {r.feature: r.bin for r in stores.load_or_build(table(2.0), path, 2).collect()}
    again = {r.feature: r.bin for r in stores.load_or_build(table(2.0), path, 2).collect()}
    changed = {r.feature: r.bin for r in stores.load_or_build(table(0.5), path, 2).collect()}
    assert first == again == {1: 1, 2: 2} and changed == {1: 2, 2: 1}


def test_label_store(spark, tmp_path):
    coded = pairs.label_tables(spark.createDataFrame([(0, 1)], "i long, j long"), spark.createDataFrame([(0,), (1,)], "i long"))
    path = str(tmp_path / "labels")
    stores.save_labels(coded, path)
    assert stores.load_labels(spark, path).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        stores.save_labels(coded, path)
    with pytest.raises(ValueError):
        stores.load_labels(spark, path, spark.createDataFrame([(0,)], "idx long"))


def test_write_once(spark, tmp_path):
    with pytest.raises(ValueError):
        stores.write_once(spark.createDataFrame([(1,), (1,)], "k long"), str(tmp_path / "t"), "k")


def test_streaming_sums_equal_batch(spark, tmp_path):
    from tessera.streaming import pair_sums, windowed_counts

    weights = spark.createDataFrame([(s, i, j, 0.5 * i + j) for s in range(4) for i in range(3) for j in range(3)], "sample long, i long, j long, w double")
    weights.repartition(3).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(weights.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w"))
    run = pair_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("sums").collect())) == sorted(map(tuple, pairs.accumulate(weights).collect()))
    events = spark.createDataFrame([("a", 1)], "event_type string, t long").select("event_type", F.timestamp_seconds("t").alias("ts"))
    assert windowed_counts(events).count() == 1
    assert binning.detected_count(spark.createDataFrame([], "sample long, feature long, v double")).count() == 0


def test_fasta_headers_keep_their_marks(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">sp|P1|A_H protein (>95% id) GN=ABC PE=1\nMK\nLV\n>tr|P2|B_H x\r\nAC\r\n>P3\n")
    found = {r.accession: (r.gene, r.sequence) for r in parsers.read_fasta(spark, str(path)).collect()}
    assert found == {"P1": ("ABC", "MKLV"), "P2": (None, "AC"), "P3": (None, "")}


def test_manual_files_are_told_by_their_first_bytes(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_bytes(gzip.compress("zipped é".encode()))
    (tmp_path / "b.gz").write_text("plain")
    assert sorted(r.text for r in parsers.read_manual(spark, str(tmp_path)).collect()) == ["plain", "zipped é"]
    with pytest.raises(FileNotFoundError, match="fetch it"):
        parsers.read_manual(spark, str(tmp_path / "none"), "fetch it by hand")


def test_sources_by_range_and_by_kind(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"sample": [1, 2, 3], "feature": [1, 1, 2], "v": [1.0, 2.0, 3.0]})
    parsers.expression_source(spark, frame).write.parquet(f"{tmp_path}/x")
    assert parsers.expression_source(spark, f"{tmp_path}/x").count() == 3
    assert [r["sample"] for r in parsers.read_range(spark, f"{tmp_path}/x", 2, 3).collect()] == [2]


def test_vector_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "accession string, vector array<double>")
    stores.save_vectors(rows, f"{tmp_path}/v")
    found, size = stores.load_vectors(spark, f"{tmp_path}/v", rows.select("accession"))
    assert size == 2 and found.count() == 2
    with pytest.raises(ValueError, match="1 features have no vector: c"):
        stores.load_vectors(spark, f"{tmp_path}/v", spark.createDataFrame([("a",), ("c",)], "accession string"))
    with pytest.raises(ValueError, match="length"):
        stores.save_vectors(rows.union(spark.createDataFrame([("c", [1.0])], rows.schema)), f"{tmp_path}/w")


def test_weights_as_tables_and_for_another_vocabulary(spark, tmp_path):
    import numpy as np

    from tessera.plans import model

    weights = model.Weights(5, d=8, heads=2)
    model.save_weights(spark, weights, f"{tmp_path}/m")
    back = model.load_weights(spark, f"{tmp_path}/m", heads=2)
    assert back.layers == weights.layers and all(np.allclose(back.arrays[k], v) for k, v in weights.arrays.items())
    other = model.for_vocabulary(weights, {1: 3, 2: 5}, 9)
    assert np.allclose(other.arrays["feature"][[1, 2]], weights.arrays["feature"][[3, 5]]) and len(other.arrays["feature"]) == 10
    one, two = model.group_states(weights, [np.array([1, 2])]), model.group_states(weights, [np.array([1, 2]), np.array([3, 4, 5])])
    assert one.shape == (1, 8) and np.allclose(two[0], two[0]) and not np.allclose(two[0], two[1])


def test_spectrum_counts_deal_lines_by_their_number(spark, monkeypatch):
    from tessera import queries

    data = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, queries.a_spectrum_counts(spark, data).collect()))
    n = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(queries, "TASK_LINES", 500, raising=False)
    dealt = queries.a_spectrum_counts(spark, data)
    assert f", {-(-n // 500)}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == whole and whole
