"""Enrichment of positives among top scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pairs import top_k_per_row
from tessera.operators.ranges import place


def enrichment_curve(scored: DataFrame, k: int, *by: str, rates: DataFrame | None = None) -> DataFrame:
    """(by..., k, enr, n_used) from (by..., i, j, s, y): at each place, the mean over rows with a positive of precision
    so far over the row's own rate of positives.

    ``rates`` (i, pos, lab) are counts over the whole row of the label matrix, whether its pairs were scored or not
    (``label_rates``); without it the scored pairs are all there is.  The top k are taken first, labelled or not;
    unlabelled ones then count neither way.  With ``rates`` the scored pairs are read once.
    """
    own = scored.where("i <> j").groupBy(*by, "i").agg(F.sum("y").alias("pos"), F.count("y").alias("lab")) if rates is None else rates
    keys = [*by, "i"] if rates is None else ["i"]
    rate = own.where("pos >= 1 AND lab >= 1")
    upto = Window.partitionBy(*by, "i").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    top = top_k_per_row(scored, k, *by).withColumn("p", F.coalesce(F.sum("y").over(upto), F.lit(0))).withColumn("n", F.count("y").over(upto))
    enr = F.try_divide(F.try_divide(F.col("p").cast("double"), F.col("n").cast("double")), F.col("pos").cast("double") / F.col("lab"))
    curve = top.join(rate, keys).groupBy(*by, "k").agg(F.round(F.avg(enr), 6).alias("enr"))
    shared = keys[:-1]
    used = rate.groupBy(*shared).agg(F.count("*").alias("n_used"))
    return curve.join(used, shared) if shared else curve.crossJoin(F.broadcast(used))


def label_rates(pos: DataFrame, uni: DataFrame) -> DataFrame:
    """(i, pos, lab) of each member of a universe: its positives (``pos``: i < j), and all other members, as each pair of them has a label."""
    ends = pos.select(F.explode(F.array("i", "j")).alias("i")).groupBy("i").agg(F.count("*").alias("pos"))
    others = uni.agg((F.count("*") - 1).alias("lab"))
    return uni.join(ends, "i", "left").crossJoin(F.broadcast(others)).select("i", F.coalesce("pos", F.lit(0)).alias("pos"), "lab")


def area(curve: DataFrame, *by: str) -> DataFrame:
    """The sum of a curve, null places as 0."""
    return curve.groupBy(*by).agg(F.coalesce(F.sum("enr"), F.lit(0.0)).alias("auc"))


def top_k_enrichment(scored: DataFrame, k: int) -> DataFrame:
    """(background, top, ratio): positives among all labelled pairs and among the k labelled ones that score highest."""
    lab = scored.where(F.col("y").isNotNull())
    background = lab.agg(F.avg("y").alias("background"))
    top = lab.orderBy(F.col("s").desc_nulls_last(), "i", "j").limit(k).agg(F.avg("y").alias("top"))
    return background.crossJoin(top).select(F.round("background", 6).alias("background"), F.round("top", 6).alias("top"), F.round(F.try_divide("top", "background"), 6).alias("ratio"))


def top_k_enrichment_by(scored: DataFrame, k: int, by: str) -> DataFrame:
    """(by, pairs, background, top, ratio) of each reference database: ``top_k_enrichment`` of its own labelled pairs.

    The k best of all databases are found in one pass: each range of a database keeps its own place, and places are counted by ranges.
    """
    lab = scored.where(F.col("y").isNotNull() & F.col(by).isNotNull())
    whole = lab.groupBy(by).agg(F.count("*").alias("pairs"), F.avg("y").alias("background"))
    placed = place(lab, [F.col("s").desc_nulls_last(), "i", "j"], within=[by])
    best = placed.where(F.col("place") < k).groupBy(by).agg(F.avg("y").alias("top"))
    return whole.join(best, by).select(by, "pairs", F.round("background", 6).alias("background"), F.round("top", 6).alias("top"), F.round(F.try_divide("top", "background"), 6).alias("ratio"))


def top_pairs(pairs: DataFrame, n: int, by: str = "mean") -> DataFrame:
    """The n pairs i < j of the largest value (never null), ties to smaller i, then j."""
    return pairs.where((F.col("i") < F.col("j")) & F.col(by).isNotNull()).orderBy(F.desc(by), "i", "j").limit(n)


def best_head(areas: DataFrame) -> DataFrame:
    """The head of the largest area, the first on ties."""
    return areas.agg(F.max_by("head", F.struct(F.col("auc"), -F.col("head"))).alias("head"), F.max("auc").alias("auc"))


def mean_over(curves: DataFrame, *by: str, value: str = "enr") -> DataFrame:
    """(by..., mean, n): the mean of a value over whatever else tells the rows apart (reference databases); nulls are skipped."""
    return curves.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))
