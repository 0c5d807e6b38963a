"""Arrays as row sources, label arrays, and tables published after a check."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays, published, stores


def csr_folder(path, rows):
    """rows: a list of {feature: value}."""
    path.mkdir()
    np.save(path / "indptr.npy", np.cumsum([0, *map(len, rows)]).astype(np.int32))
    np.save(path / "indices.npy", np.array([f for r in rows for f in r], np.uint16))
    np.save(path / "data.npy", np.array([v for r in rows for v in r.values()], np.float32))
    return str(path)


ROWS = [{f: float(f * 3 + s) + 0.5 for f in range(s % 5 * 4)} for s in range(40)] + [{}, {f: 1.0 for f in range(500)}, {}, {7: 2.0}]
LONG = sorted((s, f, v) for s, r in enumerate(ROWS) for f, v in r.items())


@pytest.mark.parametrize("entries", [7, 100, 1 << 20])
def test_compressed_rows_round_trip(spark, tmp_path, entries):
    path = csr_folder(tmp_path / "c", ROWS)
    frame = arrays.read_csr(spark, path, entries=entries)
    assert sorted(map(tuple, frame.collect())) == LONG
    assert frame.rdd.getNumPartitions() == -(-len(LONG) // entries)  # a row of 500 entries is many tasks
    for lo, hi in ((0, 3), (10, 30), (41, 42), (43, 99), (40, 41), (50, 60)):
        assert sorted(map(tuple, arrays.read_csr(spark, path, lo, hi, entries).collect())) == [x for x in LONG if lo <= x[0] < hi]
    assert sorted(map(tuple, frame.where("sample = 12 AND v > 5").collect())) == [x for x in LONG if x[0] == 12 and x[2] > 5]


def test_a_range_plans_only_its_own_entries(spark, tmp_path):
    path = csr_folder(tmp_path / "c", ROWS)
    reader = arrays.CsrReader({"path": path, "entries": "50", "first": "10", "last": "20"})
    starts = np.cumsum([0, *map(len, ROWS)])
    runs = reader.partitions()
    assert [runs[0].lo, runs[-1].hi] == [starts[10], starts[20]] and all(r.hi - r.lo <= 50 for r in runs)
    assert [(r.lo, r.hi) for r in arrays.CsrReader({"path": path, "first": "41", "last": "42"}).partitions()] == [(starts[41], starts[42])]
    assert arrays.read_csr(spark, path, 10, 20, 50).rdd.getNumPartitions() == 2


def test_ranges_of_one_folder_do_not_mix(spark, tmp_path):
    path = csr_folder(tmp_path / "c", ROWS)
    low, high, every = arrays.read_csr(spark, path, last=20), arrays.read_csr(spark, path, first=20), arrays.read_csr(spark, path)
    assert low.count() + high.count() == every.count() == low.union(high).count() == len(LONG)
    assert every.where("sample < 5").count() + every.where("sample >= 5").count() == every.count()


def test_dense_arrays(spark, tmp_path):
    matrix = np.zeros((44, 500), np.float32)
    for s, f, v in LONG:
        matrix[s, f] = v
    (tmp_path / "d").mkdir()
    np.save(tmp_path / "d" / "dense.npy", matrix)
    frame = arrays.read_csr(spark, str(tmp_path / "d"), entries=2000)
    assert sorted(map(tuple, frame.collect())) == LONG and frame.rdd.getNumPartitions() == 11
    assert sorted(map(tuple, arrays.read_csr(spark, str(tmp_path / "d"), first=41, entries=2000).collect())) == [x for x in LONG if x[0] > 40]


def test_arrays_written_by_spark(spark, tmp_path):
    path = str(tmp_path / "w")
    expr = spark.createDataFrame(LONG, arrays.SCHEMA).repartition(3)
    arrays.save_csr(expr, path, entries=64)
    assert sorted(map(tuple, arrays.read_csr(spark, path).collect())) == LONG
    assert sorted(map(tuple, arrays.read_csr(spark, path, 20, 42, 10).collect())) == [x for x in LONG if 20 <= x[0] <= 41]
    with pytest.raises(Exception, match="already holds arrays"):
        arrays.save_csr(expr, path)
    assert len(list((tmp_path / "w").glob("blocks-*"))) == 1  # the refused writer took its blocks away
    arrays.save_csr(expr.where("sample < 10"), path, overwrite=True)
    assert sorted(map(tuple, arrays.read_csr(spark, path).collect())) == [x for x in LONG if x[0] < 10]


def test_a_missing_folder_raises(spark, tmp_path):
    with pytest.raises(Exception, match="neither a manifest"):
        arrays.read_csr(spark, str(tmp_path / "none")).collect()


# Label arrays --------------------------------------------------------------------------------------


def labels(n=9, universe=(0, 2, 3, 7, 8), positives=((0, 2), (3, 8), (0, 7))):
    matrix = np.full((n, n), np.nan, np.float32)
    matrix[np.ix_(universe, universe)] = 0
    matrix[list(universe), list(universe)] = np.nan
    for i, j in positives:
        matrix[i, j] = matrix[j, i] = 1
    return matrix


def compact(matrix):
    i, j = np.nonzero(matrix == 1)
    return {"universe": np.flatnonzero(~np.isnan(matrix).all(1)).astype(np.uint16), "rows": i.astype(np.uint16), "cols": j.astype(np.uint16), "shape": np.array(matrix.shape), "format_version": np.array(1)}


def test_both_forms_give_equal_tables(spark, tmp_path):
    np.savez_compressed(tmp_path / "a_ground_truth_matrix.npz", matrix=labels())
    np.savez_compressed(tmp_path / "b_ground_truth_matrix.npz", **compact(labels()))
    rows = arrays.read_label_arrays(spark, str(tmp_path), 9)
    a, b = (sorted(map(tuple, rows.where(F.col("db") == db).drop("db").collect()), key=repr) for db in "ab")
    assert a == b and len(a) == 8 and ("positive", 3, 8) in a and ("universe", 7, None) in a
    assert rows.rdd.getNumPartitions() == 2
    alone = arrays.read_label_arrays(spark, str(tmp_path / "a_ground_truth_matrix.npz"))
    assert {r.db for r in alone.collect()} == {"a"} and alone.count() == 8


def _broken(change):
    matrix = labels()
    change(matrix)
    return matrix


@pytest.mark.parametrize("parts,size,says", [
    ({"matrix": labels()}, 10, "the order has 10"),
    (compact(labels()), 10, "the order has 10"),
    ({"matrix": labels()[:5]}, None, "square"),
    ({**compact(labels()), "shape": np.array([9, 8])}, None, "square"),
    ({"matrix": _broken(lambda m: m.__setitem__((0, 2), 0))}, None, "symmetric"),
    ({"matrix": _broken(lambda m: m.__setitem__((0, 2), 2))}, None, "other than"),
    ({"matrix": _broken(lambda m: m.__setitem__((0, 0), 0))}, None, "unknown pairs"),
    ({**compact(labels()), "rows": compact(labels())["cols"]}, None, "diagonal"),
    ({**compact(labels()), "universe": np.array([0, 2, 9], np.uint16)}, None, "outside the matrix"),
    ({"other": np.zeros(3)}, None, "neither form"),
])
def test_wrong_label_arrays_raise(spark, tmp_path, parts, size, says):
    np.savez_compressed(tmp_path / "a_ground_truth_matrix.npz", **parts)
    with pytest.raises(Exception, match=says):
        arrays.read_label_arrays(spark, str(tmp_path), size).collect()


def test_label_arrays_without_labels(spark, tmp_path):
    np.savez_compressed(tmp_path / "a_ground_truth_matrix.npz", matrix=np.full((4, 4), np.nan))
    np.savez_compressed(tmp_path / "b_ground_truth_matrix.npz", **compact(np.full((4, 4), np.nan)))
    assert arrays.read_label_arrays(spark, str(tmp_path), 4).collect() == []


# Published tables ----------------------------------------------------------------------------------


def test_a_failed_check_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")

    def refuse(staged):
        assert staged.count() == 3
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        published.publish(spark.range(3), path, refuse)
    assert published.version_of(spark, path) is None and not list((tmp_path / "t").glob("version-*"))
    with pytest.raises(FileNotFoundError):
        published.published(spark, path)
    published.publish(spark.range(4), path)
    assert published.published(spark, path).count() == 4


def test_of_two_writers_one_publishes(spark, tmp_path):
    path, meet, said = str(tmp_path / "t"), threading.Barrier(2), []

    def write(n):
        try:
            published.publish(spark.range(n), path, lambda staged: meet.wait(60) and None)  # both are written before either is named
            said.append(n)
        except FileExistsError:
            said.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (3, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert said.count(None) == 1 and published.published(spark, path).count() == next(n for n in said if n)
    assert len(list((tmp_path / "t").glob("version-*"))) == 1


def test_overwriting_replaces_the_version(spark, tmp_path):
    path = str(tmp_path / "t")
    published.publish(spark.range(3), path)
    published.publish(spark.range(6), path, overwrite=True)
    assert published.published(spark, path).count() == 6 and len(list((tmp_path / "t").glob("version-*"))) == 1


def test_labels_that_change_between_writing_and_check_are_refused(spark, tmp_path):
    unsteady = spark.range(100).select(F.lit("universe").alias("kind"), (F.rand() * 1e9).cast("long").alias("i"), F.lit(None).cast("long").alias("j"))
    steady = spark.createDataFrame([("universe", 1, None)], unsteady.schema)
    with pytest.raises(OSError, match="not what was given"):
        published.publish(unsteady, str(tmp_path / "l"), published.same_rows(steady))
    stores.save_labels(steady, str(tmp_path / "l"))
    assert stores.load_labels(spark, str(tmp_path / "l")).count() == 1
