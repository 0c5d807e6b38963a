"""Counts, histograms, cutoffs and other summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def distinct_counts(table: DataFrame, *columns: str) -> DataFrame:
    return table.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def size_stats(sizes: DataFrame, size: str = "n") -> DataFrame:
    """(min, upper_median, mean, max): the median is the element at n // 2, found on the histogram of sizes,
    so that only distinct sizes meet in one task."""
    hist = sizes.groupBy(F.col(size).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy())
    placed = hist.withColumn("upto", upto).withColumn("total", total)
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("v")))
    return placed.agg(F.min("v").alias("min"), median.alias("upper_median"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.max("v").alias("max"))


def cutoff_sweep(members: DataFrame, cutoffs: list[int | None]) -> DataFrame:
    """(cutoff, kept, removed, covered): terms within each size cutoff and the members they cover (null: no cutoff)."""
    sizes = members.groupBy("t").agg(F.count_distinct("p").alias("n"))
    least = members.join(sizes, "t").groupBy("p").agg(F.min("n").alias("n"))  # a member is covered once its smallest term is kept
    cuts = F.broadcast(members.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff int"))
    within = F.coalesce(F.col("n") <= F.col("cutoff"), F.lit(True))
    hist, cover = sizes.groupBy("n").count(), least.groupBy("n").count()
    kept = hist.crossJoin(cuts).groupBy("cutoff").agg(F.sum(F.when(within, F.col("count")).otherwise(0)).alias("kept"), F.sum(F.when(within, 0).otherwise(F.col("count"))).alias("removed"))
    covered = cover.crossJoin(cuts).groupBy("cutoff").agg(F.sum(F.when(within, F.col("count")).otherwise(0)).alias("covered"))
    return kept.join(covered, kept["cutoff"].eqNullSafe(covered["cutoff"])).select(kept["cutoff"], "kept", "removed", "covered")


def last_wins(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return table.groupBy(key).agg(F.max_by(value, order).alias(value))


def largest_terms(members: DataFrame, n: int) -> DataFrame:
    return members.groupBy("t").agg(F.count_distinct("p").alias("n")).orderBy(F.desc("n"), "t").limit(n)


def tier_summary(artifacts: DataFrame, present: Column) -> DataFrame:
    """(tier, files, present, to_fetch): files of each tier, those at hand, and the MB still to fetch."""
    return artifacts.groupBy("tier").agg(
        F.count("*").alias("files"), F.count_if(present).alias("present"), F.round(F.coalesce(F.sum(F.when(~present, F.col("megabytes"))), F.lit(0.0)), 6).alias("to_fetch")
    )


def fetch_plan(artifacts: DataFrame, tiers: list[str], at_hand: DataFrame) -> DataFrame:
    """The artifacts of the tiers that are not at hand."""
    return artifacts.where(F.col("tier").isin(tiers)).join(at_hand.select("key"), "key", "left_anti")


def pivot_fill(counts: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Long to wide with 0 for what is missing; the columns are given, so no pass looks for them."""
    return counts.groupBy(row).pivot(column, values).agg(F.sum(value)).na.fill(0)


def strided(table: DataFrame, index: str, step: int) -> DataFrame:
    """Every step-th row by index, for display."""
    return table.where(F.col(index) % step == 0)


def pending(artifacts: DataFrame, present: Column, show: int = 12) -> DataFrame:
    """(rank, key, megabytes, more): the largest artifacts that are not at hand, and how many more there are."""
    gone = artifacts.where(~present)
    first = gone.orderBy(F.desc("megabytes"), "key").limit(show)
    rank = F.row_number().over(Window.orderBy(F.desc("megabytes"), "key"))  # over at most ``show`` rows
    n = gone.agg(F.greatest(F.count("*") - show, F.lit(0)).alias("more"))
    return first.withColumn("rank", rank).crossJoin(F.broadcast(n)).select("rank", "key", "megabytes", "more")
