"""Expression values to rank bins, tied groups and ragged tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rank_to_bin, tie_key
from tessera.operators.ranges import place, running_total

KEYS = ("sample", "feature", "v")


def detected(expr: DataFrame, stored_entries: bool = False) -> DataFrame:
    """The detected values: those above 0 (so neither null nor NaN counts), or every stored entry."""
    return expr if stored_entries else expr.where((F.col("v") > 0) & ~F.isnan(F.col("v").cast("double")))


def rank_bin(expr: DataFrame, bins: int = 10, seed: int = 0) -> DataFrame:
    """``expr`` with the bin of each value's rank within its sample; ties in seeded random order.

    One shuffle, by sample; every detected value counts, whatever is dropped later.
    """
    if not 1 <= bins <= 255:
        raise ValueError("bins must be in 1..255")
    w = Window.partitionBy("sample")
    rank = F.row_number().over(w.orderBy("v", tie_key(seed, "sample", "feature"), "feature"))
    return expr.withColumn("bin", rank_to_bin(rank, F.count("*").over(w), bins))


def detected_count(expr: DataFrame) -> DataFrame:
    return expr.groupBy("sample").agg(F.count("*").alias("n_detected"))


def value_groups(binned: DataFrame, largest: int = 1) -> DataFrame:
    """(sample, kind, members, bin): features with a value of their own are individuals, 2..largest equal
    ones a group with the bin of its first member; larger groups are counted and dropped before any is gathered."""
    n = binned.groupBy("sample", "v").agg(F.count("*").alias("n")).where((F.col("n") == 1) | (F.col("n") <= largest)).drop("n")
    same = (binned["sample"] == n["sample"]) & binned["v"].eqNullSafe(n["v"])
    grouped = binned.join(n, same, "left_semi").groupBy("sample", "v").agg(F.sort_array(F.collect_list(F.struct("feature", "bin"))).alias("m"))
    n = F.size("m")
    return grouped.select(
        "sample", F.when(n == 1, "individual").otherwise("group").alias("kind"), F.col("m.feature").alias("members"), F.col("m")[0]["bin"].alias("bin")
    )


def value_group_counts(expr: DataFrame, largest: int = 1) -> DataFrame:
    """(sample, n_ind, n_grp, n_dropped): features alone, groups kept, and features in dropped groups."""
    n = expr.groupBy("sample", "v").agg(F.count("*").alias("n"))
    return n.groupBy("sample").agg(
        F.count_if(F.col("n") == 1).alias("n_ind"),
        F.count_if((F.col("n") >= 2) & (F.col("n") <= largest)).alias("n_grp"),
        F.coalesce(F.sum(F.when((F.col("n") > largest) & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("n_dropped"),
    )


def offsets(counts: DataFrame, key: str = "sample", count: str = "n_detected") -> DataFrame:
    """(key, start_off, end_off): running totals in key order, over ranges of keys (``running_total``)."""
    upto = running_total(counts.select(key, count), [key], count, "start_off")
    return upto.select(key, "start_off", (F.col("start_off") + F.col(count)).alias("end_off"))


def detection_frequency(expr: DataFrame, least: float = 0.05) -> DataFrame:
    """(feature, freq, log10_freq) of the features detected in at least that share of all samples."""
    n = expr.select("sample").distinct().agg(F.count("*").cast("double").alias("n_samples"))
    freq = expr.groupBy("feature").agg(F.count("*").cast("double").alias("n")).crossJoin(F.broadcast(n))
    share = F.col("n") / F.col("n_samples")
    return freq.where(share >= least).select("feature", F.round(share, 6).alias("freq"), F.round(F.log10(share), 6).alias("log10_freq"))


def length_normalised(expr: DataFrame, lengths: DataFrame, length: Column) -> DataFrame:
    """(sample, feature, saf): each value over the length of its feature; a zero length gives null."""
    return expr.join(lengths, "feature").select("sample", "feature", F.round(F.try_divide(F.col("v"), length.cast("double")), 6).alias("saf"))


def places(keys: DataFrame, key: str) -> DataFrame:
    """(key, place): the place of each distinct key in ascending order, from 0."""
    return place(keys.select(key).distinct(), [key])


def jitter(expr: DataFrame, seed: int = 3, scale: float = 1e-6) -> DataFrame:
    """``expr`` with values raised by up to ``scale`` of themselves, at random by key: breaks ties, keeps the order of others."""
    share = F.conv(F.substring(tie_key(seed, "sample", "feature"), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return expr.withColumn("v", F.col("v").cast("double") * (1 + F.lit(scale) * share))
