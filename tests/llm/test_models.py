"""Learned operators: held-out accuracy, exact parts against brute force, edge cases."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import gru_lm, pu_quality, toxicity

DATA = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_quality_on_held_out_rows(spark):
    found = pu_quality.score(read(spark, "documents"), read(spark, "labels"), ~pu_quality.held_out())
    both = found.join(read(spark, "labels"), "doc_id").where(pu_quality.held_out()).toPandas()
    assert found.count() == 1000 and (both.predicted == both.quality).mean() > 0.95


def test_quality_learns_from_positives_only(spark):
    """Turning the labels of bad rows into null changes nothing but which rows are sampled."""
    x = np.random.default_rng(0).normal(size=(2000, 3))
    good = x[:, 0] > -1
    assert 0.75 < pu_quality.Model(x[good][:900], x).prior < 0.95


def test_quality_from_a_table_of_positives_only(spark):
    """Without a single label of 0 the unlabelled documents still count: bad ones get low scores."""
    labels = read(spark, "labels").where("quality = 1")
    found = pu_quality.score(read(spark, "documents"), labels, ~pu_quality.held_out())
    both = found.join(read(spark, "labels"), "doc_id").where(pu_quality.held_out()).toPandas()
    assert (both.predicted == both.quality).mean() > 0.9 and (both[both.quality == 0].predicted == 0).mean() > 0.8


def slow_features(text):
    """The features of one text by plain loops."""
    raw = (text or "").encode()
    groups = [g.encode() for g in pu_quality._GROUPS]
    classes = [0] * pu_quality.N_CLASSES
    for b in raw:
        k = next((i for i, g in enumerate(groups) if b in g), len(groups) + 1 if b >= 192 else len(groups) + 2 if b >= 128 else len(groups))
        classes[k] += 1 / len(raw)
    w = raw.split()
    n, some = len(w), max(1, len(w))
    counts = {x: w.count(x) for x in set(w)}
    threes = [tuple(w[i : i + 3]) for i in range(n - 2)]
    extra = [math.log1p(len(raw)) / 10, math.log1p(n) / 8, 1 / (1 + n), sum(map(len, w)) / some / 10, sum(len(x) <= 2 for x in w) / some, sum(len(x) >= 12 for x in w) / some]
    extra += [sum(a == b for a, b in zip(w, w[1:])) / some, len(counts) / some, max(counts.values(), default=0) / some, (len(threes) - len(set(threes))) / some]
    extra += [sum(65 <= x[0] <= 90 for x in w) / some, sum(x[-1:] in (b"%", b"&", b"$", b"#", b"*", b"!", b"|") for x in w) / some]
    return classes + extra


def test_quality_equals_brute_force(spark):
    """Features by plain loops; scores by a fit on the same rows outside Spark."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    found = {r.doc_id: r.score for r in pu_quality.score(docs, labels, ~pu_quality.held_out()).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    x = {i: pu_quality.all_features(pa.array([t], pa.string()))[0].astype(np.float64) for i, t in texts.items()}
    for i in list(texts)[::9]:
        assert np.allclose(x[i][: -pu_quality.CELLS], slow_features(texts[i]), atol=1e-5)
        assert x[i][-pu_quality.CELLS :].sum() == pytest.approx(float(bool((texts[i] or "").split())), abs=1e-5)
    train = [i for i in sorted(texts) if zlib.crc32(str(i).encode()) % 5]
    model = pu_quality.Model(np.stack([x[i] for i in train if i in good]), np.stack([x[i] for i in train]))
    assert np.allclose([found[i] for i in sorted(texts)], model.score(np.stack([x[i] for i in sorted(texts)])), atol=1e-6)


def test_quality_never_reads_labels_of_bad_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    for other in (labels.where("quality = 1"), labels.withColumn("quality", F.when(F.col("quality") == 1, 1))):
        a, b = (sorted((r.doc_id, r.score) for r in pu_quality.score(docs.repartition(n), x, ~pu_quality.held_out()).collect()) for n, x in ((2, labels), (5, other)))
        assert np.allclose(a, b, atol=1e-9)


def test_class_prior():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, 5000)
    u = np.concatenate([rng.normal(2, 1, 7000), rng.normal(-3, 1, 3000)])
    assert abs(pu_quality.class_prior(p, u) - 0.7) < 0.05


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "x" * 300_000, 3), (None, "a b", 3), (2, "", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, quality int")
    found = pu_quality.score(docs, labels, F.lit(True)).collect()
    assert len(found) == 5 and {r.score for r in found} == {0.5}
    assert pu_quality.score(docs.limit(0), labels, F.lit(True)).count() == 0
    assert pu_quality.keep_good(docs, labels, F.lit(True)).columns == docs.columns


def test_toxicity_on_held_out_rows(spark):
    found = toxicity.score(read(spark, "documents"), read(spark, "labels"), ~toxicity.held_out())
    both = found.join(read(spark, "labels"), "doc_id").where(toxicity.held_out()).toPandas()
    assert found.count() == 1000 and (both.predicted == both.toxic).mean() > 0.9


@pytest.mark.parametrize("frequent", [0.05, 2.0])
def test_index_is_exact(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = np.random.default_rng(7)
    weight = rng.uniform(0.1, 4, 40)

    def vector():
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        return t, rng.integers(1, 4, len(t))

    rows = [vector() for _ in range(900)]
    index = toxicity.Index(list(range(900)), rows, rng.integers(0, 2, 900).tolist(), weight)
    dense = np.zeros((900, 40))
    for i, (t, c) in enumerate(rows):
        dense[i, t] = index.unit(t, c)[1]
    queries = [vector() for _ in range(60)]
    for (t, c), got in zip(queries, index.nearest(queries)):
        q = np.zeros(40)
        q[t] = index.unit(t, c)[1]
        cosine = np.round(np.minimum(dense @ q, 1), 12)
        want = [(cosine[i], i) for i in np.lexsort((np.arange(900), -cosine))[:15] if cosine[i] > 0]
        assert [index.ids[i] for _, i in got] == [i for _, i in want] or np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-11)
        assert len(got) == len(want)


def test_toxicity_equals_brute_force(spark):
    """The whole query: term weights, neighbours and votes from dense vectors of all terms."""
    import collections
    import re

    docs, labels = read(spark, "documents"), read(spark, "labels")
    found = {r.doc_id: r for r in toxicity.score(docs, labels, ~toxicity.held_out()).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in texts}

    def terms(text):
        out = collections.Counter()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()):
            out[w] += 1
            for n in (4, 5):
                if len(w) > n:
                    out[w[:n]] += 1
        return out

    counts = {i: terms(t) for i, t in texts.items()}
    vocabulary = sorted({t for i in y for t in counts[i]})
    place = {t: k for k, t in enumerate(vocabulary)}
    df = np.zeros(len(vocabulary))
    yes, held = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for i, c in counts.items():
        at = [place[t] for t in c if t in place]
        df[at] += 1
        if i in y:
            held[at] += 1
            yes[at] += y[i]
    expected = held * sum(y.values()) / len(y)
    strength = np.clip(((yes - expected) / np.sqrt(expected + 1) - toxicity.FROM) / toxicity.OVER, 0, 1)
    weight = (np.log((len(texts) + 1) / (df + 1)) + 1) * (toxicity.FLOOR + strength)

    def unit(c):
        v = np.zeros(len(vocabulary))
        for t, n in c.items():
            if t in place:
                v[place[t]] = (1 + math.log(n)) * weight[place[t]]
        return v / (np.sqrt((v * v).sum()) or 1)

    examples = sorted(y)
    matrix = np.stack([unit(counts[i]) for i in examples])
    for i in list(texts)[::17]:
        cosine = matrix @ unit(counts[i])
        best = np.sort(cosine)[::-1][:15]
        got = found[i].neighbours
        assert np.allclose([n.cosine for n in got], best[best > 1e-12], atol=1e-9)
        assert all(n.cosine == pytest.approx(cosine[examples.index(n.doc_id)], abs=1e-9) and n.label == y[n.doc_id] for n in got)


def test_toxicity_hangs_on_the_text_alone(spark):
    """A copy of each text under another id, far from the first, gets the score of the text; so do ids exchanged among equal texts."""
    docs, labels = read(spark, "documents").select("doc_id", "text"), read(spark, "labels")
    copies = docs.select((F.lit(10_000_000) - F.col("doc_id") * 3).alias("doc_id"), "text")
    found = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs.union(copies), labels, ~toxicity.held_out()).collect()}
    assert all(found[r.doc_id] == found[10_000_000 - r.doc_id * 3] for r in docs.select("doc_id").collect())


def test_calibration_knows_no_own_label():
    """Where labels are noise, votes by folds say nothing: the steps stay near the rate, though each text would find itself."""
    rng = np.random.default_rng(3)
    vectors = [(np.sort(rng.choice(200, 6, replace=False)), np.ones(6, np.int64)) for _ in range(600)]
    y = rng.integers(0, 2, 600)
    at, values = toxicity.calibrated(list(range(600)), vectors, y, np.ones(200))
    assert abs(np.interp(0.5, at, values) - 0.5) < 0.1 and np.interp(0.65, at, values) < 0.75


def test_isotonic():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    at, values = toxicity.isotonic(x, np.array([0, 1, 0, 0, 1, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(values) >= 0).all()


def test_toxicity_is_calibrated(spark):
    """Held-out rows of a larger table: in each range of scores about that share is toxic."""
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    found = toxicity.score(spark.read.parquet(f"{big}/documents.parquet"), labels, ~toxicity.held_out())
    both = found.join(labels, "doc_id").where(toxicity.held_out()).select("score", "predicted", "toxic").toPandas()
    assert (both.predicted == both.toxic).mean() > 0.97 and both.predicted[both.toxic == 1].mean() > 0.9
    for low, high in ((0, 0.1), (0.1, 0.6), (0.6, 1.01)):
        mine = both[(both.score >= low) & (both.score < high)]
        if len(mine) >= 15:
            assert abs(mine.score.mean() - mine.toxic.mean()) < 0.15


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "bad word"), (3, "bad word"), (None, "bad")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none, F.lit(True)).collect()} == {0.0}
    some = spark.createDataFrame([(3, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, some, F.lit(True)).count() == 5
    assert toxicity.score(docs.limit(0), some, F.lit(True)).count() == 0


def lm_docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        words = ["Alpha", "beta", "gamma", "delta"] if i % 2 else ["uno", "dos", "tres", "cuatro"]
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))))
    return [*rows, (300, None), (301, ""), (302, "never seen words"), (7, rows[7][1]), (None, "uno dos")]


def test_base_score_and_model(spark):
    rows = lm_docs(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = gru_lm.score(docs, ~gru_lm.held_out()).collect()
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts: dict = {}
    for t in train:
        for w in [*(t or "").lower().split(), "\n"]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    texts = {i: [*(t or "").lower().split(), "\n"] for i, t in rows}
    assert len(found) == len(rows)
    for r in found:
        w = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w))
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert gru_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_score_does_not_depend_on_files(spark):
    """The same rows in two and in nine partitions, in other orders: equal scores."""
    docs = read(spark, "documents")
    a, b = ({r.doc_id: r.score for r in gru_lm.score(docs.repartition(n, *by), ~gru_lm.held_out()).collect()} for n, by in ((2, ("doc_id",)), (9, ("text",))))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) / (1 + abs(a[i])) for i in a) < 1e-5


def test_model_beats_base_on_held_out_texts(spark):
    found = gru_lm.score(read(spark, "documents"), ~gru_lm.held_out()).where(gru_lm.held_out()).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert found.s / found.n > found.b / found.n + 0.1


def small_lexicon():
    h = np.array([gru_lm.END, *range(10, 150)], np.uint64)
    bucket = np.array([0, *np.random.default_rng(0).integers(0, gru_lm.SHAPES * gru_lm.BUCKETS, 140)])
    n = np.arange(141, 0, -1)
    size = gru_lm.SHAPES * gru_lm.BUCKETS
    return gru_lm.Lexicon(h, bucket, n, int(n.sum()), 141, np.bincount(bucket, n, size), np.bincount(bucket, minlength=size))


def test_gradients():
    """Back-propagation against finite differences, through a text's start inside the window."""
    lex = small_lexicon()
    rng = np.random.default_rng(0)
    targets = rng.integers(0, lex.members, (12, 2))
    inputs = np.concatenate([np.full((1, 2), lex.members), targets[:-1]])
    inputs[5, 1] = lex.members
    valid = np.arange(24).reshape(12, 2) < 22
    flat = gru_lm.initial(lex).astype(np.float64)
    h = rng.normal(size=(2, gru_lm.HIDDEN))

    def loss(values):
        net = gru_lm.Network(values, lex)
        states = net.states(inputs, h)[0][1:]
        mine = np.zeros_like(valid)
        mine[1 :: gru_lm.EVERY] = valid[1 :: gru_lm.EVERY]
        return -net.outputs(states[mine], targets[mine], None)[0].mean()

    net = gru_lm.Network(flat, lex)
    net.learn(inputs, targets, valid, h, 1)
    grad = np.sqrt(np.maximum(net.squares - 1e-6, 0))  # the first step's squares are those of the gradient
    names = gru_lm.unpack(np.arange(len(flat)), lex)
    used = np.unique(inputs[inputs < lex.members])
    picks = [names["x"][s, k] for s in used[:4].tolist() for k in (0, 40)] + [names["c"][3, lex.of[targets[1, 0]]], names["cb"][2], names["w"][targets[1, 0], 5], names["wb"][targets[5, 1]]]
    for at in picks:
        up, down = flat.copy(), flat.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert grad[at] == pytest.approx(abs(loss(up) - loss(down)) / 2e-4, abs=2e-4)


def test_state_is_carried_across_windows(monkeypatch):
    lex = small_lexicon()
    net = gru_lm.Network(gru_lm.initial(lex), lex)
    symbols = np.random.default_rng(1).integers(0, lex.members, 50)
    whole = net.run(symbols, np.array([0, 50]), False)[0]
    monkeypatch.setattr(gru_lm, "STEPS", 7)
    assert net.run(symbols, np.array([0, 50]), False)[0] == pytest.approx(whole, rel=1e-5)
    two = net.run(np.concatenate([symbols[:7], symbols]), np.array([0, 7, 57]), False)
    assert two[1] == pytest.approx(whole, rel=1e-5)


def test_probabilities_sum_to_one():
    lex = small_lexicon()
    net = gru_lm.Network(gru_lm.initial(lex), lex)
    state = np.random.default_rng(2).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    logs, _ = net.outputs(np.repeat(state, lex.members, 0), np.arange(lex.members), None)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_every_place_of_a_text_is_learned_from():
    """Each place's word moves its own output bias, whichever place of the window it stands at."""
    lex = small_lexicon()
    symbols = np.arange(1, 65) % lex.heads if lex.heads > 64 else np.arange(64) % lex.members
    seen = []

    class Watched(gru_lm.Network):
        def outputs(self, states, targets, grads):
            seen.extend(targets.tolist())
            return super().outputs(states, targets, grads)

    Watched(gru_lm.initial(lex), lex).run(symbols, np.array([0, len(symbols)]), True)
    assert sorted(seen) == sorted(symbols.tolist())

def test_rows_of_a_block_change_nothing(monkeypatch):
    """Logs, slopes of states and slopes of weights: equal in blocks of 3 rows and in one, and to the plain formula."""
    lex = small_lexicon()
    rng = np.random.default_rng(4)
    net = gru_lm.Network(rng.normal(0, 0.5, len(gru_lm.initial(lex))), lex)
    states, symbols = rng.normal(size=(80, gru_lm.HIDDEN)), rng.integers(0, lex.members, 80)
    symbols[:20] = 7
    found = []
    for rows in (3, 1000):
        monkeypatch.setattr(gru_lm, "ROWS", rows)
        grads: dict = {}
        logs, back = net.outputs(states, symbols, grads)
        found.append([logs, back, *(grads[k] for k in ("c", "cb", "w", "wb"))])
    p, cls = net.p, lex.of[symbols]
    c = states @ p["c"] + p["cb"]
    m = np.where(lex.of == cls[:, None], states @ p["w"].T + p["wb"], -np.inf)
    one_c, one_m = (x - np.log(np.exp(x).sum(1, keepdims=True)) for x in (c, m))
    rows = np.arange(80)
    slope_c, slope_m = np.exp(one_c), np.exp(one_m)
    slope_c[rows, cls] -= 1
    slope_m[rows, symbols] -= 1
    plain = [one_c[rows, cls] + one_m[rows, symbols], slope_c @ p["c"].T + slope_m @ p["w"], states.T @ slope_c, slope_c.sum(0), slope_m.T @ states, slope_m.sum(0)]
    for a, b, exact in zip(*found, plain):
        assert a == pytest.approx(b, abs=1e-9) and a == pytest.approx(exact, abs=1e-9)


def test_a_window_costs_what_its_words_cost(monkeypatch):
    """Gates are computed for the words that a window moved, not for all members; the second window is computed in the memory of the first."""
    lex = small_lexicon()
    net = gru_lm.Network(gru_lm.initial(lex), lex)
    targets = np.random.default_rng(5).integers(0, 40, (gru_lm.STEPS, gru_lm.STREAMS))
    inputs = np.concatenate([np.full((1, gru_lm.STREAMS), lex.members), targets[:-1]])
    valid, h = np.ones(targets.shape, bool), np.zeros((gru_lm.STREAMS, gru_lm.HIDDEN), np.float32)
    h = net.learn(inputs, targets, valid, h, 0)
    sizes, tanh = [], np.tanh
    monkeypatch.setattr(gru_lm.np, "tanh", lambda x: sizes.append(x.size) or tanh(x))
    tracemalloc.start()
    net.learn(inputs, targets, valid, h, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) <= 40 * 2 * gru_lm.HIDDEN
    assert peak < 3 * targets.size * gru_lm.HIDDEN * 4  # three arrays of the window's states
