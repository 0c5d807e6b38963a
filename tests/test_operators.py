"""Hand-computed cases, failures, and results that don't depend on partitions or row order."""

import itertools
import math
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import binning, embedding, graph, lookups, metrics, pairs, ranking, sampling, summaries, vectors
from tessera.plans import model
from tessera.sources.tables import written


def expr(spark, **samples):
    return spark.createDataFrame([(i, f, float(v)) for i, (_, values) in enumerate(samples.items()) for f, v in values.items()], "sample long, feature long, v double")


def bins_of(frame):
    return {r.feature: r.bin for r in frame.collect()}


def test_rank_bin(spark):
    found = binning.rank_bin(expr(spark, a={1: 5, 2: 1, 3: 3, 4: 9}), 2)
    assert bins_of(found) == {2: 1, 3: 1, 1: 2, 4: 2}


def test_bin_arithmetic_is_double(spark):
    found = bins_of(binning.rank_bin(expr(spark, a={i: i for i in range(1, 26)}), 50))
    assert found[7] == int(np.ceil(7 / 25 * 50)) == 15


def test_bins_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    table = expr(spark, **{f"s{i}": {j: rng.integers(1, 4) for j in range(60)} for i in range(5)})
    a = sorted(map(tuple, binning.rank_bin(table, 7).collect()))
    b = sorted(map(tuple, binning.rank_bin(table.repartition(13).orderBy(F.rand(3)), 7).collect()))
    assert a == b


def test_bins_out_of_range(spark):
    with pytest.raises(ValueError):
        binning.rank_bin(expr(spark, a={1: 1}), 256)


def test_detected(spark):
    table = spark.createDataFrame([(0, 1, 0.0), (0, 2, -1.0), (0, 3, float("nan")), (0, 4, None), (0, 5, 2.0)], "sample long, feature long, v double")
    assert [r.feature for r in binning.detected(table).collect()] == [5]
    assert binning.detected(table, stored_entries=True).count() == 5


TIED = {"a": {1: 7, 2: 7, 3: 7, 4: 2, 5: 2, 6: 1}}


@pytest.mark.parametrize(("largest", "expected"), [(3, (1, 2, 0)), (2, (1, 1, 3)), (1, (1, 0, 5))])
def test_value_groups(spark, largest, expected):
    row = binning.value_group_counts(expr(spark, **TIED), largest).first()
    assert (row.n_ind, row.n_grp, row.n_dropped) == expected
    tokens = binning.value_groups(binning.rank_bin(expr(spark, **TIED), 3), largest).collect()
    assert sum(r.kind == "group" for r in tokens) == expected[1]
    alone = next(r for r in tokens if r.kind == "individual")
    assert (alone.members, alone.bin) == ([6], 1)


def test_bins_of_ties_share_a_span(spark):
    found = bins_of(binning.rank_bin(expr(spark, **TIED), 3))
    assert (found[6], sorted([found[4], found[5]]), sorted(found[i] for i in (1, 2, 3))) == (1, [1, 2], [2, 3, 3])


@pytest.mark.parametrize(("n", "ratio", "least", "context"), [(10, 0.85, 1, 8), (1, 0.85, 1, 1), (1, 0.5, 0, 0)])
def test_context_split(spark, n, ratio, least, context):
    chosen = sampling.subsample(expr(spark, a={i: 1 for i in range(n)}), 100)
    assert sampling.context_split(chosen, ratio, least).where("role = 1").count() == context


def test_absent_features_are_absent(spark):
    table = expr(spark, a={i: 1 for i in range(1, 9)}, b={1: 1})
    found = sampling.absent(table, table.select("sample").distinct(), 10, 5).collect()
    assert {r.feature for r in found if r["sample"] == 0} == {9, 10}
    assert sum(r["sample"] == 1 for r in found) == 5
    assert not {(r["sample"], r.feature) for r in found} & {(r["sample"], r.feature) for r in table.collect()}


def test_epochs_differ(spark):
    table = expr(spark, a={i: 1 for i in range(50)})
    orders = [[r.feature for r in sampling.subsample(table, 50, epoch=e).orderBy("pos").collect()] for e in (0, 1, 1)]
    assert orders[0] != orders[1] == orders[2]


def test_group_choice_keeps_whole_groups(spark):
    groups = binning.value_groups(binning.rank_bin(expr(spark, **TIED), 3), 3).where("kind = 'group'")
    assert sampling.choose_groups(groups, 1).count() == 1


UNIVERSE, POSITIVE = [(0,), (1,), (3,)], [(0, 1)]


def labels(spark):
    return spark.createDataFrame(POSITIVE, "i long, j long"), spark.createDataFrame(UNIVERSE, "i long")


def test_label_counts(spark):
    assert tuple(pairs.label_counts(*labels(spark), 4).first()) == (1, 2, 3)


def test_labels_round_trip(spark):
    coded = pairs.label_tables(*labels(spark))
    again = pairs.encode_labels(pairs.decode_labels(coded))
    assert sorted(map(str, again.collect())) == sorted(map(str, coded.collect()))


@pytest.mark.parametrize("cells", [[(0, 1, 1), (1, 0, 0)], [(0, 1, 2), (1, 0, 2)], [(0, 0, 1), (0, 1, 1), (1, 0, 1)], [(0, 1, 1), (1, 0, 1), (0, 2, 0), (2, 0, 0)]])
def test_bad_labels_raise(spark, cells):
    with pytest.raises(ValueError):
        pairs.encode_labels(spark.createDataFrame(cells, "i long, j long, label int"))


def test_compact_labels(spark):
    pos = spark.createDataFrame([(1, 2), (2, 1), (4, 3), (None, 1)], "i long, j long")
    uni = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "i long")
    cells = [(1, 2, 1), (2, 1, 1), (3, 4, 1), (1, 3, 0), (1, 1, None), (1, 9, None), (None, 1, None)]

    def coded(rows):
        return pairs.compact_labels(pos, uni, spark.createDataFrame(rows, "i long, j long, label int"))

    found = sorted((r.kind, r.i, r.j) for r in coded(cells).collect() if r.kind == "positive")
    assert found == [("positive", 1, 2), ("positive", 3, 4)]
    assert coded(cells).where("kind = 'universe'").count() == 4
    for wrong in ((1, 3, 1), (3, 4, 0), (3, 4, None), (1, 9, 0)):
        with pytest.raises(ValueError, match="another label"):
            coded([*cells, wrong])
    with pytest.raises(ValueError, match="outside"):
        pairs.compact_labels(pos, uni.where("i < 4"))
    with pytest.raises(ValueError, match="decoded whole"):
        pairs.decode_labels(coded(cells), most=3)


def test_labels_of_a_universe_in_many_blocks(spark):
    """Every pair of the universe once, whatever the blocks and however many members there are; no default limit."""
    pos, uni = [(0, 1), (1, 7), (5, 9), (3, 8)], range(11)
    coded = pairs.label_tables(spark.createDataFrame(pos, "i long, j long"), spark.createDataFrame([(i,) for i in uni], "i long"))
    for block in (1, 3, 64):
        found = sorted(map(tuple, pairs.decode_labels(coded, block=block).collect()))
        assert found == [(i, j, int((min(i, j), max(i, j)) in pos)) for i in uni for j in uni if i != j]
    large = pairs.label_tables(spark.createDataFrame([(0, 20_001)], "i long, j long"), spark.range(20_002).withColumnRenamed("id", "i"))
    assert pairs.decode_labels(large).where("i = 0").agg(F.count("*"), F.sum("label")).first() == (20_001, 1)


def test_a_row_is_decoded_to_one_block_at_most(spark):
    """Spark holds all rows that come of one row: above the joins a member is met with the members of one block, not a block with a block."""
    coded = pairs.label_tables(spark.createDataFrame([(0, 1), (2, 99)], "i long, j long"), spark.range(9).withColumnRenamed("id", "i"))
    found = pairs.decode_labels(coded, block=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Join")[0].count("Generate explode") == 1 and "SortMergeJoin" in plan
    assert sorted(map(tuple, found.collect())) == [(i, j, int({i, j} == {0, 1})) for i in range(9) for j in range(9) if i != j]


def test_shared_histogram_of_many_members(spark):
    """50,000 members have more pairs than 32 bits hold; the bucket of none is exact."""
    found = pairs.shared_histogram(spark.createDataFrame([(1, 2, 3)], "pa long, pb long, shared long"), 50_000).collect()
    assert {r.shared: r.pairs for r in found} == {0: 50_000 * 49_999 // 2 - 1, 3: 1}


def shared_by_hand(members):
    terms, shared = {}, {}
    for t, p in members:
        if t is not None and p is not None:
            terms.setdefault(t, set()).add(p)
    for own in terms.values():
        for a, b in itertools.combinations(sorted(own), 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    return shared


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_terms_of_any_size_are_paired(spark, block):
    """No term is left out for its size: those of more than a block are paired block by block."""
    members = [(t, (7 * t + i * i) % 40) for t in range(6) for i in range(4 * t)] + [(9, 1), (9, 1), (None, 1), (None, 2), (9, None), (9, 2)]
    found = pairs.comembership(spark.createDataFrame(members, "t long, p long"), block=block).collect()
    assert len(found) == len({(r.pa, r.pb) for r in found}) and {(r.pa, r.pb): r.shared for r in found} == shared_by_hand(members)


def test_shared_histogram_counts_orders_of_any_size(spark):
    from tessera import queries
    from tessera.plans import fixtures as fx

    d = "/root/testdata/sf0.001"
    shared = shared_by_hand([tuple(r) for r in fx.members(spark, d).collect()])
    found = {r.shared: r.pairs for r in queries.a_shared_hist(spark, d).collect()}
    assert {k: n for k, n in found.items() if k} == {k: list(shared.values()).count(k) for k in set(shared.values())}


def scored(spark):
    s = {(0, 1): 0.9, (1, 3): 0.8, (0, 2): 0.5, (2, 3): 0.3, (1, 2): 0.2, (0, 3): 0.1}
    table = spark.createDataFrame([(a, b, x) for (i, j), x in s.items() for a, b in ((i, j), (j, i))], "i long, j long, s double")
    return pairs.pair_label(table, *labels(spark)).withColumnRenamed("label", "y")


def test_enrichment_curve(spark):
    curve = ranking.enrichment_curve(scored(spark), 3)
    assert [(r.k, r.enr, r.n_used) for r in curve.orderBy("k").collect()] == [(1, 2.0, 2), (2, 1.5, 2), (3, 1.0, 2)]
    assert ranking.area(curve).first().auc == 4.5


def test_top_k_enrichment(spark):
    row = ranking.top_k_enrichment(scored(spark).where("i < j"), 1).first()
    assert (row.background, row.top, row.ratio) == (0.333333, 1.0, 3.0)


def test_micro_and_macro(spark):
    table = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 0.0), ("b", 1.0, 0.0)], "sample string, pred double, true double")
    assert metrics.micro(table).first().mse == round(5 / 3, 6)
    assert metrics.macro(table).first().mse == 1.5
    assert metrics.weighted(spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, n int")).first().loss == 1.25


def test_symmetrize(spark):
    sums = spark.createDataFrame([(0, 1, 0.6, 2), (1, 0, 0.2, 2), (0, 0, 9.0, 2)], "i long, j long, sum double, cnt long")
    assert [(r.i, r.j, round(r["mean"], 9)) for r in pairs.symmetrize(sums).collect()] == [(0, 1, 0.2)]


@pytest.mark.parametrize(("sizes", "median"), [([1, 2, 3, 4], 3), ([5], 5), ([1, 1, 9], 1)])
def test_upper_median(spark, sizes, median):
    assert summaries.size_stats(spark.createDataFrame([(x,) for x in sizes], "n long")).first().upper_median == median


def test_one_sided_nodes(spark):
    mapping = spark.createDataFrame([("g1", "A")], "g string, acc string")
    found = [lookups.one_sided_nodes(spark.createDataFrame([e], "g1 string, g2 string"), mapping).collect() for e in (("g1", "g2"), ("g2", "g1"))]
    assert [[r.acc for r in x] for x in found] == [["A"], []]


def test_priority_pick(spark):
    entries = spark.createDataFrame([("g", 0, "T", False, False), ("g", 1, "S", True, False), ("g", 2, "M", False, True)], "g string, at int, acc string, rev boolean, inm boolean")
    assert lookups.priority_pick(entries, "g", F.col("rev"), F.col("inm"), "at").first().acc == "M"


def test_complex_expansion(spark):
    edges = spark.createDataFrame([("COMPLEX:P1_P2", "P1")], "s string, t string").select(lookups.expand_complex(F.col("s")).alias("s"), lookups.expand_complex(F.col("t")).alias("t"))
    assert [tuple(r) for r in lookups.complex_pairs(edges, "s", "t").collect()] == [("P1", "P2")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (200, 200)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 50: 50, 70: 50, 100: 50, 200: 200}


def test_text_functions(spark):
    row = spark.createDataFrame([(" a; b ;;a", "sp|P1|X_H GN=ABC OS", "path:hsa1", "Cycle - Homo sapiens (human)", "ENSG01.2 and ENSG77")], "a string, b string, c string, d string, e string")
    found = row.select(fn.split_clean(F.col("a")), fn.gene_name(F.col("b")), fn.kegg_id(F.col("c")), fn.pathway_name(F.col("d")), fn.ensembl_ids(F.col("e")), fn.truncated(F.lit("ABC"), 2)).first()
    assert list(found) == [["a", "b"], "ABC", "hsa1", "Cycle", ["ENSG01", "ENSG77"], "AB"]


def test_softmax_and_reducers(spark):
    w = vectors.softmax(spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 5.0)], "g string, x double"), ["g"], "x").orderBy("g").collect()
    assert [r.w for r in w] == [0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        embedding.reduce_dimensions(spark.createDataFrame([(1, [1.0])], "k long, v array<double>"), "k", "v", "isomap")


def test_model_masks_targets(spark):
    """A target's bin, and other targets, don't change what the model says about it."""
    w = model.Weights(20, seed=5)
    role, feature = np.array([1, 1, 2, 2]), np.array([3, 4, 5, 6])
    a, maps = model.forward(w, role, feature, np.array([1, 2, 3, 4]))
    b, _ = model.forward(w, role, feature, np.array([1, 2, 9, 4]))
    assert np.allclose(a, b)
    assert np.allclose(maps[0].sum(-1), 1) and np.all(maps[0][:, :, 3:] == 0)


def test_drawn_weights_are_the_same_and_stay_small():
    whole, drawn = model.Weights(1000, d=8, seed=3), model.Weights(1000, d=8, seed=3, drawn=True)
    sent = pickle.loads(pickle.dumps(drawn))
    for name, x in whole.arrays.items():
        assert np.array_equal(np.asarray(drawn.arrays[name]), x) and np.array_equal(np.asarray(sent.arrays[name]), x)
    assert np.array_equal(sent.arrays["feature"][np.array([999, 0, 17])], whole.arrays["feature"][[999, 0, 17]])
    assert len(pickle.dumps(model.Weights(1_000_000, drawn=True))) < 2_000_000 < 1_000_000 * 32 * 8


def test_states_asked_for_equal_forward():
    w, rng = model.Weights(300, seed=5), np.random.default_rng(0)
    role, feature, bins = rng.integers(1, 3, 200), rng.permutation(300)[:200], rng.integers(1, 11, 200)
    x, maps = model.forward(w, role, feature, bins)
    asks = np.concatenate([[0], 1 + np.flatnonzero(role == 2)])
    assert np.allclose(model.states(w, role, feature, bins, asks), x[asks], atol=1e-12)
    at = 1 + np.flatnonzero(role == 1)
    assert np.allclose(model.context_attention(w, role, feature, bins), np.stack(maps).mean((0, 1))[at][:, at], atol=1e-14)
    assert np.allclose(model.context_attention(w, role, feature, bins, 1, 2), maps[1][2][at][:, at], atol=1e-14)


def test_cells_of_the_map_are_sent_in_less_than_six_bytes():
    """Equal to 2^-48, from 0 to 1, in any shape; eight bytes a cell were too many for the disk."""
    rng = np.random.default_rng(3)
    e = np.exp(rng.normal(0, 2, (400, 400)))
    for m in (e / e.sum(1, keepdims=True), np.array([[0.0, 1.0, 0.5 ** 47, 1 / 3]]), np.ones((1, 1))):
        lower, upper = model._packed_cells(model._planes(m))
        back = model._unpacked_cells(pa.py_buffer(lower), pa.py_buffer(upper), *m.shape)
        assert abs(back - m).max() <= 2.0**-48 and back.shape == m.shape
        assert m.size < 100 or len(lower) + len(upper) < 5.5 * m.size


def test_symmetric_map_equals_pair_sums(spark):
    from tessera import queries

    packed, weights = queries._packed(spark, "/root/testdata/sf0.001")
    want = {(r.i, r.j): r["mean"] for r in pairs.symmetrize(pairs.accumulate(model.attention_weights(packed, weights))).collect()}
    for block in (32, 1024):
        found = model.symmetric_map(packed, weights, block=block).collect()
        assert len(found) == len(want) and all(abs(want[r.i, r.j] - r["mean"]) < 1e-12 for r in found)


def test_metrics_of_heads_read_predictions_once(spark):
    from tessera import queries

    d = "/root/testdata/sf0.001"
    both = queries.m_predict_metrics(spark, d)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    found = queries.m_predict(spark, d)
    for r in both.collect():
        assert tuple(r)[1:] == tuple(metrics.micro(found, f"pred_{r['head']}", "true_bin").first())


def test_plan_shapes(spark):
    """Co-membership makes no Cartesian product, and top k per row limits its groups before the window."""
    members = spark.createDataFrame([(1, 1), (1, 2)], "t long, p long")
    assert "Cartesian" not in pairs.comembership(members, 4)._jdf.queryExecution().toString()
    scores = spark.createDataFrame([(1, 2, 0.5)], "i long, j long, s double")
    assert "WindowGroupLimit" in pairs.top_k_per_row(scores, 3)._jdf.queryExecution().toString()


def test_model_queries_take_all_detected_features(spark):
    from tessera import queries
    from tessera.plans import fixtures as fx
    from tessera.plans import model

    d = "/root/testdata/sf0.001"
    bins = fx.binned(spark, d)
    detected = {r["sample"]: r["count"] for r in bins.groupBy("sample").count().collect()}
    packed, weights = queries._packed(spark, d)
    assert max(detected.values()) > 100
    assert {r["sample"]: len(r["feature"]) for r in packed.collect()} == {k: min(n, 1024) for k, n in detected.items()}
    want = {r["sample"]: r["emb"] for r in model.embed(model.pack(bins.selectExpr("sample", "feature", "bin", "1 AS role")), weights).collect()}
    found = {r["sample"]: r["emb"] for r in queries.m_sst_embed(spark, d).collect()}
    assert found.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(want[k], found[k]))


def _attention_by_hand(rows, scale):
    by = {}
    for sample, feature, a in rows:
        by.setdefault(sample, []).append((feature, a))
    out = {}
    for sample, own in by.items():
        top = max(a / scale for _, a in own)
        e = {j: math.exp(a / scale - top) for j, a in own}
        out |= {(sample, i, j): e[j] / sum(e.values()) for i in e for j in e}
    return out


def test_attention_of_long_samples_by_blocks(spark):
    rows = [(s, f, float((f * 7 + s) % 11)) for s, n in ((1, 3), (2, 50), (3, 8), (4, 9)) for f in range(n)]
    tokens = spark.createDataFrame([*rows, (None, 1, 2.0)], "sample long, feature long, a double")
    for scale in (4.0, -3.0):
        found = pairs.head_attention(tokens, {5: scale, 6: 2.0}, block=8).collect()
        got = {(r.sample, r.i, r.j): r.w for r in found if r["head"] == 5}
        want = _attention_by_hand(rows, scale)
        assert got.keys() == want.keys() and len(found) == 2 * len(want)
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_head_sums_equal_pair_sums(spark):
    """Short and long samples, frequent and rare features, tokens without a value, some rows alone: the sums of all pairs."""
    rows = [(s, f, None if (s + f) % 13 == 5 else float((f * 7 + s) % 11)) for s, n in ((1, 3), (2, 30), (3, 8), (4, 9), (5, 1), (6, 8)) for f in range(n)]
    tokens = spark.createDataFrame([*rows, (None, 1, 2.0)], "sample long, feature long, a double")
    scales = {5: 4.0, 6: -3.0}
    sums = pairs.accumulate(pairs.head_attention(tokens, scales, block=8), "head")
    want = {(r.head, r.i, r.j): (r.cnt, r.sum) for r in sums.collect()}
    same = {h: {(r.i, r.j): r["mean"] for r in pairs.symmetrize(sums.where(F.col("head") == h).drop("head")).collect()} for h in scales}

    def near(a, b):
        return a == b if a is None or b is None else abs(a - b) < 1e-12

    for block, hot in ((8, 2), (8, 100), (64, 2), (64, 100)):
        got = {(h, r.i, r.j): (r.cnt, r[f"sum{h}"]) for r in pairs.head_sums(tokens, scales, block=block, hot=hot).collect() for h in scales}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and near(got[k][1], want[k][1]) for k in want)
        both = pairs.head_sums(tokens, scales, True, block=block, hot=hot)
        for h in scales:
            found = {(r.i, r.j): r["mean"] for r in pairs.symmetric(both, h).collect()}
            assert found.keys() == same[h].keys() and all(near(found[k], same[h][k]) for k in found)
        some = {(r.i, r.j): r.cnt for r in pairs.head_sums(tokens, scales, rows=tokens.where("feature < 2").selectExpr("feature AS i"), block=block, hot=hot).collect()}
        assert some == {(i, j): c for (h, i, j), (c, _) in want.items() if h == 5 and i < 2}


def test_attention_sums_shuffle_no_pairs(spark):
    """The pairs are made behind the last exchange, and only those of rows with a positive for the best head."""
    from tessera import queries

    plan = queries.x_head_maps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Exchange")]
    assert "posexplode(js" in top and "keys=[i" in top


def test_attention_of_a_sample_of_20000_tokens(spark):
    """No array of the sample, and no block much larger than what was asked for; the weights of each row add up to 1."""
    n, block = 20_000, 1024
    tokens = spark.range(n).select(F.lit(1).cast("long").alias("sample"), F.col("id").alias("feature"), (F.col("id") % 97).cast("double").alias("a"))
    found = pairs.head_attention(tokens, {1: 10.0}, block)
    sums = found.where("i % 5000 = 0").groupBy("i").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()
    assert len(sums) == 4 and all(r.n == n and abs(r.w - 1) < 1e-9 for r in sums)
    held = spark.read.parquet([p for p in written(spark) if "/token_blocks-" in p][-1])
    assert held.count() == 20 and held.agg(F.max(F.size("t"))).first()[0] < 1.25 * block


def test_enrichment_rates_count_unscored_labels(spark):
    """Row 0 has positives 1 and 4 among four others, and only 1, 2 and 3 were scored: its rate is 2 / 4, not 1 / 3."""
    pos, uni = spark.createDataFrame([(0, 1), (0, 4)], "i long, j long"), spark.range(5).withColumnRenamed("id", "i")
    scored = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 0), (0, 3, 0.7, 0)], "i long, j long, s double, y int")
    rates = ranking.label_rates(pos, uni)
    assert {tuple(r) for r in rates.collect()} == {(0, 2, 4), (1, 1, 4), (2, 0, 4), (3, 0, 4), (4, 1, 4)}
    curve = {r.k: (r.enr, r.n_used) for r in ranking.enrichment_curve(scored, 3, rates=rates).collect()}
    assert curve == {1: (2.0, 3), 2: (1.0, 3), 3: (round(1 / 3 / 0.5, 6), 3)}


def test_names_of_one_prefix_and_sparse_keys_never_meet_in_one_task(spark):
    """200,000 keys of one prefix, and as many 5,000 apart, are placed range by range."""
    n = 200_000
    names = spark.range(n).select(F.format_string("ENSG%011d", F.col("id") * 7).alias("name"), (F.col("id") * 5000).alias("sample"), (F.col("id") % 3).alias("n_detected"))
    placed = lookups.alphabetical(names.repartition(4), "name")
    assert placed.where(F.col("place") * 7 != F.substring("name", 5, 11).cast("long")).isEmpty() and placed.count() == n
    totals = binning.offsets(names, "sample", "n_detected")
    third = F.floor(F.col("sample") / 5000 / 3)
    assert totals.where(F.col("start_off") != third * 3 + F.when(F.col("sample") / 5000 % 3 == 2, 1).otherwise(0)).isEmpty()
    for path in [p for p in written(spark) if "/ranges-" in p][-2:]:
        parts = [c for c in spark.read.parquet(path).columns if c.startswith("part_")][0]
        assert spark.read.parquet(path).groupBy(parts).count().agg(F.max("count")).first()[0] < 0.75 * n  # adaptive execution leaves two ranges here
