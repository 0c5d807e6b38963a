"""Pair algebra: co-membership, accumulated association, ternary reference labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import write_table

#: Tokens of a sample that are gathered together; samples of more are paired block by block.
BLOCK = 1024
#: Samples of more than a block (some 40 bytes each) that are broadcast.
LONG = 1 << 16
#: Samples of a feature beyond which its pairs are added up before they are shuffled.
HOT = 1 << 20
#: Members of a block of a universe that is decoded, and tasks that its pairs of blocks are dealt to at most.
DECODED, DECODE_TASKS = 1024, 2000


def term_sizes(members: DataFrame, largest: int | None = None) -> DataFrame:
    """(t, n) of the terms with at most ``largest`` distinct members."""
    n = members.groupBy("t").agg(F.count_distinct("p").alias("n"))
    return n if largest is None else n.where(F.col("n") <= largest)


def keep_terms(members: DataFrame, largest: int) -> DataFrame:
    return members.join(term_sizes(members, largest).select("t"), "t", "left_semi")


def comembership(members: DataFrame, largest: int | None = None, block: int = BLOCK) -> DataFrame:
    """(pa, pb, shared), pa < pb: the terms that two members share, of those of at most ``largest`` members if that is given.

    Terms are counted first (map-side) and larger ones dropped before any is gathered.  Pairs are made within the arrays of terms of up
    to ``block`` members; the members of a longer one are dealt into blocks by hash, and each pair of its blocks is one row of pairs.
    So there is no self-join, no array of a hot term, and a task holds two blocks.
    """
    known = members.where("t IS NOT NULL AND p IS NOT NULL") if largest is None else keep_terms(members, largest)
    if largest is not None and largest <= block:
        return _counted_pairs(_term_pairs(known))
    long = write_table(term_sizes(known).where(F.col("n") > block), "long_terms")
    many = long.limit(LONG + 1).count()
    if not many:
        return _counted_pairs(_term_pairs(known))
    near = F.broadcast(long) if many <= LONG else long
    return _counted_pairs(_term_pairs(known.join(near.select("t"), "t", "left_anti")).unionByName(_block_pairs(known.join(near, "t"), block)))


def _counted_pairs(found: DataFrame) -> DataFrame:
    return found.groupBy("pa", "pb").agg(F.count("*").alias("shared"))


def _term_pairs(members: DataFrame) -> DataFrame:
    """(pa, pb): a row for each pair of each term, made within the term's array."""
    terms = members.groupBy("t").agg(F.sort_array(F.collect_set("p")).alias("m"))
    return terms.select(F.explode(array_pairs(F.col("m"))).alias("x")).select(F.col("x.a").alias("pa"), F.col("x.b").alias("pb"))


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """``_term_pairs`` of terms of any size, whose number of members comes as ``n``: block by block."""
    blocks = F.ceil(F.col("n") / block)
    dealt = members.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("p"), F.col("blocks")))
    held = write_table(dealt.groupBy("t", "blocks", "b").agg(F.collect_set("p").alias("m")), "term_blocks")
    left = held.select("t", F.col("b").alias("bi"), F.col("m").alias("rows"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("bj"))
    right = held.select("t", F.col("b").alias("bj"), F.col("m").alias("columns"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("bi"))
    met = left.join(right, ["t", "bi", "bj"]).select("bi", "bj", "columns", F.explode("rows").alias("x")).select("bi", "bj", "x", F.explode("columns").alias("y"))
    return met.where("bi < bj OR x < y").select(F.least("x", "y").alias("pa"), F.greatest("x", "y").alias("pb"))


def array_pairs(items: Column) -> Column:
    """All pairs (a before b) of an array."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def shared_histogram(pairs: DataFrame, n_members: Column | int) -> DataFrame:
    """(shared, pairs, pct): pairs by shared terms, with the bucket of none counted, never made."""
    n = (F.lit(n_members) if isinstance(n_members, int) else n_members).cast("long")  # n * n passes 32 bits from 46,341 members on
    hist = pairs.groupBy("shared").agg(F.count("*").alias("pairs"))
    total = F.shiftright(n * (n - 1), 1)
    zero = hist.agg((total - F.coalesce(F.sum("pairs"), F.lit(0))).alias("pairs")).select(F.lit(0).cast("long").alias("shared"), "pairs")
    return hist.unionByName(zero).select("shared", "pairs", F.round(100.0 * F.col("pairs") / total, 6).alias("pct"))


def threshold_sweep(hist: DataFrame, universe: DataFrame, everything: DataFrame, thresholds: list[int]) -> DataFrame:
    """(thr, pos, neg, unk, ratio) for each least number of shared terms, among the members of the universe and all."""
    cuts = hist.sparkSession.createDataFrame([(t,) for t in thresholds], "thr int")
    swept = cuts.join(hist, F.col("shared") >= F.col("thr"), "left").groupBy("thr").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pos"))
    half = F.count("*") * (F.count("*") - 1) / 2
    sizes = universe.agg(half.cast("long").alias("inside")).crossJoin(everything.agg(half.cast("long").alias("every")))  # one row
    neg = F.col("inside") - F.col("pos")
    ratio = F.round(F.try_divide(F.col("pos").cast("double"), neg.cast("double")), 6).alias("ratio")
    return swept.crossJoin(F.broadcast(sizes)).select("thr", "pos", neg.alias("neg"), (F.col("every") - F.col("inside")).alias("unk"), ratio)


def universe(members: DataFrame) -> DataFrame:
    return members.select(F.col("p").alias("i")).distinct()


def positives(members: DataFrame, largest: int) -> DataFrame:
    return comembership(members, largest).select(F.col("pa").alias("i"), F.col("pb").alias("j"))


def label_counts(pos: DataFrame, uni: DataFrame, n_all: int) -> DataFrame:
    """(pos, neg, unknown) over the pairs i < j of all members: negatives and unknowns by counting alone."""
    counted = uni.agg(F.count("*").alias("u")).crossJoin(pos.agg(F.count_if(F.col("i") < F.col("j")).alias("pos")))
    inside = (F.col("u") * (F.col("u") - 1) / 2).cast("long")
    return counted.select("pos", (inside - F.col("pos")).alias("neg"), (F.lit(n_all * (n_all - 1) // 2) - inside).alias("unknown"))


def pair_label(pairs: DataFrame, pos: DataFrame, uni: DataFrame) -> DataFrame:
    """``pairs`` (i, j) with label 1 (positive), 0 (both in the universe), or null (unknown, and i = j)."""
    known = pairs.join(uni.select("i", F.lit(True).alias("ki")), "i", "left").join(uni.select(F.col("i").alias("j"), F.lit(True).alias("kj")), "j", "left")
    both = pos.select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.lit(1).alias("yes")).distinct()
    found = known.join(both, (F.least("i", "j") == F.col("lo")) & (F.greatest("i", "j") == F.col("hi")), "left")
    label = F.when(F.col("ki") & F.col("kj") & (F.col("i") != F.col("j")), F.coalesce("yes", F.lit(0)))
    return found.withColumn("label", label.cast("int")).drop("ki", "kj", "lo", "hi", "yes")


def encode_labels(cells: DataFrame) -> DataFrame:
    """(kind, i, j) from labelled cells (i, j, label): the universe and the positives i < j; raises unless lossless.

    Lossless means symmetric labels 0 or 1, a null diagonal, and a label on every pair of the universe.
    """
    known = cells.where(F.col("label").isNotNull())
    uni = known.select("i").distinct()
    sides = [F.count("*").alias("n"), F.count_if(F.col("i") < F.col("j")).alias("up"), F.min("label").alias("low"), F.max("label").alias("high")]
    both = known.groupBy(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(*sides)
    right = (F.col("n") == 2) & (F.col("up") == 1) & (F.col("low") == F.col("high")) & F.col("low").isin(0, 1)
    found = both.agg(F.count("*").alias("pairs"), F.count_if(~right).alias("wrong")).crossJoin(uni.agg(F.count("*").alias("n"))).first()
    if found.wrong or 2 * found.pairs != found.n * (found.n - 1):
        raise ValueError("labels are not a symmetric 0/1 matrix over one universe with an unknown diagonal")
    ones = known.where(F.col("label") == 1)
    return label_tables(ones.where("i < j"), uni)


def label_tables(pos: DataFrame, uni: DataFrame) -> DataFrame:
    """The compact form of labels: (kind, i, j), universe rows with a null j and positive rows i < j."""
    return uni.select(F.lit("universe").alias("kind"), "i", F.lit(None).cast("long").alias("j")).unionByName(pos.select(F.lit("positive").alias("kind"), "i", "j"))


def compact_labels(pos: DataFrame, uni: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(kind, i, j) from positives and the universe, without a pair that isn't positive.

    Raises if an end of a positive lies outside the universe, or if one of the ``cells`` (i, j, label) given isn't what the
    compact form says of it (null: unknown).  A positive given in both directions or twice is one.
    """
    ones = canonical_pairs(pos, "i", "j").select(F.col("a").alias("i"), F.col("b").alias("j"))
    known = uni.where("i IS NOT NULL").select("i").distinct()
    ends = ones.select(F.explode(F.array("i", "j")).alias("i"))
    if not ends.join(known, "i", "left_anti").isEmpty():
        raise ValueError("a positive lies outside the universe")
    if cells is not None:
        said = pair_label(cells.select("i", "j", F.col("label").alias("given")), ones, known)
        if not said.where(~F.col("given").eqNullSafe(F.col("label"))).isEmpty():
            raise ValueError("a cell has another label than the positives and the universe give it")
    return label_tables(ones, known)


def decode_labels(coded: DataFrame, most: int | None = None, block: int = DECODED) -> DataFrame:
    """(i, j, label) of all pairs i <> j of the universe: quadratic in it by definition; one of over ``most`` members, if given, is an error.

    The universe is cut into blocks of about ``block`` members by hash.  A member meets each block in one row: the members of the
    block, and its positives among them.  So rows of pairs are made in the task that returns them and never shuffled; what is shuffled is each
    member and each block once for every block.  A row gives no more than a block of pairs, as Spark holds all that come of one row at once.
    """
    uni = write_table(coded.where("kind = 'universe' AND i IS NOT NULL").select("i").distinct(), "universe")
    n = uni.count()
    if most is not None and n > most:
        raise ValueError(f"a universe of {n} members is not decoded whole; label the pairs asked for with pair_label")
    blocks = max(1, -(-n // block))
    at = {c: F.pmod(F.xxhash64(c), F.lit(blocks)) for c in "ij"}
    held = write_table(uni.groupBy(at["i"].alias("b")).agg(F.sort_array(F.collect_list("i")).alias("m")), "universe_blocks")
    pos = coded.where("kind = 'positive' AND i <> j").select("i", "j")
    both = pos.union(pos.select("j", "i")).distinct()
    ones = both.groupBy(at["i"].alias("bi"), at["j"].alias("bj"), "i").agg(F.collect_list("j").alias("js")).groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("i", "js"))).alias("ones"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = uni.select("i", at["i"].alias("bi"), each.alias("bj"))
    right = held.select(F.col("b").alias("bj"), F.col("m").alias("columns"), each.alias("bi")).join(ones, ["bi", "bj"], "left")
    dealt = [x.repartition(min(blocks * blocks, DECODE_TASKS), "bi", "bj") for x in (left, right)]
    met = dealt[0].join(dealt[1].hint("merge"), ["bi", "bj"])  # with the members broadcast, all rows would come of the few blocks' tasks
    rows = met.select("columns", "i", F.try_element_at("ones", F.col("i")).alias("js"))
    label = F.when(F.array_contains("js", F.col("j")), 1).otherwise(0)
    return rows.select("i", "js", F.explode("columns").alias("j")).where("i <> j").select("i", "j", label.alias("label"))


def attention(tokens: DataFrame, scale: float, block: int = BLOCK) -> DataFrame:
    """(sample, i, j, w): softmax over a sample's own tokens j of a_j / scale, for each i."""
    return head_attention(tokens, {1: scale}, block).drop("head")


def head_attention(tokens: DataFrame, scales: dict[int, float], block: int = BLOCK) -> DataFrame:
    """(head, sample, i, j, w): ``attention`` over all tokens (sample, feature, a), at the scale of each head.

    Samples of up to ``block`` tokens are one array each, gathered once for all heads.  Longer ones, found by a count
    first, never are: see ``blocked_attention``.  A token without a value has no weight and gives none; one
    without a sample is left out.
    """
    known = tokens.where(F.col("sample").isNotNull())
    sizes = known.groupBy("sample").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("a").alias("high"))
    long = write_table(sizes.where(F.col("n") > block), "long_samples")
    many = long.limit(LONG + 1).count()
    if not many:
        return _whole_attention(known, scales)
    near = F.broadcast(long) if many <= LONG else long
    short = known.join(near.select("sample"), "sample", "left_anti")
    return _whole_attention(short, scales).unionByName(blocked_attention(known.join(near, "sample"), scales, block, many <= LONG))


def _heads(scales: dict[int, float]) -> Column:
    """One row a head: its number and its scale."""
    return F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.lit(float(s)).alias("scale")) for h, s in scales.items()]))


def _whole_attention(tokens: DataFrame, scales: dict[int, float]) -> DataFrame:
    """``head_attention`` of samples that fit into an array."""
    per = tokens.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("feature", "a"))).alias("t"))
    per = per.select("sample", "t", _heads(scales).alias("h")).select("sample", "t", "h.head", "h.scale")
    top = per.select("*", F.array_max(F.transform("t", lambda x: x["a"] / F.col("scale"))).alias("top"))
    raised = top.select("head", "sample", F.transform("t", lambda x: F.struct(x["feature"].alias("j"), F.exp(x["a"] / F.col("scale") - F.col("top")).alias("e"))).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["e"], F.lit(0.0)))
    keys = raised.select("head", "sample", total.alias("total"), "t", F.explode("t.j").alias("i"))
    return keys.select("head", "sample", "i", "total", F.explode("t").alias("x")).select("head", "sample", "i", F.col("x.j").alias("j"), (F.col("x.e") / F.col("total")).alias("w"))


def blocked_attention(tokens: DataFrame, scales: dict[int, float], block: int = BLOCK, few: bool = True) -> DataFrame:
    """``head_attention`` of long samples: tokens come with the count ``n`` and the range ``low``..``high`` of their sample's values.

    The state of a softmax is its maximum and its sum, and both merge: the maximum is known from the range, the sums
    are added up map-side, so no task sees a sample.  Tokens are dealt into n / block blocks by hash; each pair of
    blocks is one row that meets in one task of its own, so a sample is as many tasks as its pairs need, and a task holds two
    blocks.  Each block is sent once for every block of its sample: n / block copies for n * n pairs.
    """
    blocks = F.ceil(F.col("n") / block)
    tops = {h: F.when(F.lit(s) > 0, F.col("high")).otherwise(F.col("low")) / F.lit(float(s)) for h, s in scales.items()}
    sums = tokens.groupBy("sample", "low", "high").agg(*[F.sum(F.exp(F.col("a") / F.lit(float(s)) - tops[h])).alias(f"sum{h}") for h, s in scales.items()])
    state = sums.select("sample", F.array(*[F.struct(F.lit(h).alias("head"), F.lit(float(s)).alias("scale"), tops[h].alias("top"), F.col(f"sum{h}").alias("total")) for h, s in scales.items()]).alias("heads"))
    dealt = tokens.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("feature"), F.col("blocks")))
    held = write_table(dealt.groupBy("sample", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("feature", "a"))).alias("t")), "token_blocks")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = held.select("sample", F.col("block").alias("bi"), F.col("t.feature").alias("rows"), each.alias("bj"))
    right = held.select("sample", F.col("block").alias("bj"), "t", each.alias("bi"))
    met = left.join(right, ["sample", "bi", "bj"]).join(F.broadcast(state) if few else state, "sample")
    per = met.select("sample", "rows", "t", F.explode("heads").alias("h"))
    weight = F.transform("t", lambda x: F.struct(x["feature"].alias("j"), (F.exp(x["a"] / F.col("h.scale") - F.col("h.top")) / F.col("h.total")).alias("w")))
    weighed = per.select(F.col("h.head").alias("head"), "sample", "rows", weight.alias("t"))
    return weighed.select("head", "sample", F.explode("rows").alias("i"), "t").select("head", "sample", "i", F.explode("t").alias("x")).select("head", "sample", "i", "x.j", "x.w")


def head_sums(tokens: DataFrame, scales: dict[int, float], both: bool = False, rows: DataFrame | None = None, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(i, j, cnt, sum<head>...): ``accumulate(head_attention(...), "head")`` with a column a head.

    With ``both``, i < j, and sums are arrays of both directions': (i to j, j to i); they are met in the same samples.  ``rows`` (i) names
    the only i that are wanted.  What is shuffled is a row a token, by its feature: the features and values of its sample (of those
    behind it, with ``both``) and each head's normaliser, from which the task that adds up makes the weights.  A feature of more than ``hot``
    samples, and samples longer than ``block``, are added up in pairs map-side first.
    """
    known = write_table(tokens.where(F.col("sample").isNotNull()).select("sample", "feature", F.col("a").cast("double").alias("a")), "tokens")
    sizes = known.groupBy("sample").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("a").alias("high"))
    long = write_table(sizes.where(F.col("n") > block), "long_samples")
    often = write_table(known.groupBy(F.col("feature").alias("i")).agg(F.count("*").alias("n")).where(F.col("n") > hot).select("i"), "hot_features")
    many, any_hot = long.limit(LONG + 1).count(), not often.isEmpty()
    near = F.broadcast(long) if many <= LONG else long
    short = known.join(near.select("sample"), "sample", "left_anti") if many else known
    per = short.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("feature", "a"))).alias("t")).select(F.col("t.feature").alias("js"), F.col("t.a").alias("a"))
    tops = {h: (F.array_max("a") if s > 0 else F.array_min("a")) / F.lit(float(s)) for h, s in scales.items()}
    total = lambda h, s: F.aggregate("a", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.exp(x / F.lit(float(s)) - tops[h]), F.lit(0.0)))
    per = per.select("js", "a", *[(tops[h] + F.ln(total(h, s))).alias(f"z{h}") for h, s in scales.items()])
    zs = [f"z{h}" for h in scales]
    own = per.select("js", "a", *zs, F.posexplode("js").alias("p", "i"))
    if both:
        own = own.where(F.col("p") < F.size("js") - 1).select("i", F.get("a", F.col("p")).alias("own"), *[F.slice(c, F.col("p") + 2, F.size("js")).alias(c) for c in ("js", "a")], *zs)
    else:
        own = own.select("i", "js", "a", *zs)
    if rows is not None:
        own = own.join(rows.select("i").distinct(), "i", "left_semi")

    def added(dealt: DataFrame) -> DataFrame:
        met = dealt.select(*[c for c in dealt.columns if c != "js"], F.posexplode("js").alias("q", "j"))
        weight = lambda x, h, s: F.exp(x / F.lit(float(s)) - F.col(f"z{h}"))
        a = F.get("a", F.col("q"))
        if both:
            sums = [F.array(F.sum(weight(a, h, s)), F.sum(weight(F.col("own"), h, s))).alias(f"sum{h}") for h, s in scales.items()]
            met = met.where("i < j")
        else:
            sums = [F.sum(weight(a, h, s)).alias(f"sum{h}") for h, s in scales.items()]
        return met.groupBy("i", "j").agg(F.count("*").alias("cnt"), *sums)

    if any_hot:
        found = added(own.join(F.broadcast(often), "i", "left_anti").repartition("i")).unionByName(added(own.join(F.broadcast(often), "i", "left_semi")))
    else:
        found = added(own.repartition("i"))
    if not many:
        return found
    cells = blocked_attention(known.join(near, "sample"), scales, block, many <= LONG)
    if rows is not None:
        cells = cells.join(rows.select("i").distinct(), "i", "left_semi")
    one = F.col("head") == next(iter(scales))
    mine = {h: F.when(F.col("head") == h, F.col("w")) for h in scales}
    if both:
        lo, hi, up = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("i") < F.col("j")
        sums = [F.array(F.sum(F.when(up, w)), F.sum(F.when(~up, w))).alias(f"sum{h}") for h, w in mine.items()]
        cells = cells.where("i <> j").groupBy(lo, hi).agg(F.count_if(one & up).alias("cnt"), *sums)
        again = [F.array(F.sum(F.col(f"sum{h}")[0]), F.sum(F.col(f"sum{h}")[1])).alias(f"sum{h}") for h in scales]
    else:
        cells = cells.groupBy("i", "j").agg(F.count_if(one).alias("cnt"), *[F.sum(w).alias(f"sum{h}") for h, w in mine.items()])
        again = [F.sum(f"sum{h}").alias(f"sum{h}") for h in scales]
    return found.unionByName(cells).groupBy("i", "j").agg(F.sum("cnt").alias("cnt"), *again)


def head_maps(sums: DataFrame, heads: Iterable[int]) -> DataFrame:
    """(head, i, j, cnt, mean) from ``head_sums``."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.try_divide(F.col(f"sum{h}"), F.col("cnt").cast("double")).alias("mean")) for h in heads]))
    return sums.select("i", "j", "cnt", each.alias("h")).select("h.head", "i", "j", "cnt", "h.mean")


def symmetric(sums: DataFrame, head: int = 1) -> DataFrame:
    """``symmetrize`` from ``head_sums`` of both directions."""
    up, down = (F.try_divide(F.col(f"sum{head}")[k], F.col("cnt").cast("double")) for k in (0, 1))
    mean = F.coalesce((up + down) / 2, up, down)
    return sums.select("i", "j", mean.alias("mean"))


def accumulate(weights: DataFrame, *by: str) -> DataFrame:
    """(by..., i, j, sum, cnt): mergeable pair sums, so the same aggregation runs over a stream."""
    return weights.groupBy(*by, "i", "j").agg(F.sum("w").alias("sum"), F.count("*").alias("cnt"))


def mean_map(sums: DataFrame) -> DataFrame:
    return sums.withColumn("mean", F.try_divide(F.col("sum"), F.col("cnt").cast("double"))).drop("sum")


def symmetrize(sums: DataFrame) -> DataFrame:
    """(i, j, mean), i < j: the mean of both directions' means, of one where only one was met; no diagonal."""
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    return mean_map(sums).where("i <> j").groupBy(lo.alias("i"), hi.alias("j")).agg(F.avg("mean").alias("mean"))


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b, distinct, without self pairs or nulls."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("a"), hi.alias("b")).distinct()


def top_k_per_row(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The k largest scores s of each (by..., i), nulls last and ties to smaller j, diagonal excluded, with their place k."""
    place = F.row_number().over(Window.partitionBy(*by, "i").orderBy(F.col("s").desc_nulls_last(), "j"))
    return scores.where("i <> j").withColumn("k", place).where(F.col("k") <= k)


def split_by_vocabulary(pairs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pairs (i, j) whose ends are both in the vocabulary (i); (kept, skipped) counts)."""
    known = vocabulary.select("i").distinct()
    kept = pairs.join(known, "i", "left_semi").join(known.withColumnRenamed("i", "j"), "j", "left_semi")
    counts = kept.agg(F.count("*").alias("kept")).crossJoin(pairs.agg(F.count("*").alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("skipped"))
    return kept, counts


def submatrix(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """Cells (i, j, ...) whose row and column are kept (idx, place), under their places."""
    rows, columns = (kept.select(F.col("idx").alias(x), F.col("place").alias(f"__{x}")) for x in "ij")
    rest = [c for c in cells.columns if c not in ("i", "j")]
    return cells.join(rows, "i").join(columns, "j").select(F.col("__i").alias("i"), F.col("__j").alias("j"), *rest)


def membership(members: DataFrame, terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row, column, value): the 0/1 membership matrix of (t, p) by its cells of 1, under the places of terms and members (key, place)."""
    rows, columns = terms.select(F.col("key").alias("t"), F.col("place").alias("row")), vocabulary.select(F.col("key").alias("p"), F.col("place").alias("column"))
    return members.distinct().join(rows, "t").join(columns, "p").select("row", "column", F.lit(1).alias("value"))
