"""The fixture tables seen as measurements, terms, scores and attention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pairs
from tessera.operators.binning import rank_bin
from tessera.sources.tables import read


def expression(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as samples, parts as 1-based features (0 pads sequences), summed quantities as values (whole numbers with many ties)."""
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") + 1).alias("feature")).agg(F.sum("l_quantity").alias("v"))


def binned(spark: SparkSession, d: str) -> DataFrame:
    return rank_bin(expression(spark, d), 10)


def members(spark: SparkSession, d: str) -> DataFrame:
    """Orders as terms, parts as members."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_partkey").alias("p")).distinct()


def evidence(spark: SparkSession, d: str, least: float = 45.0) -> DataFrame:
    """The memberships with trusted evidence: returned lines of at least that quantity."""
    lines = read(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= least))
    return lines.select(F.col("l_orderkey").alias("t"), F.col("l_partkey").alias("p")).distinct()


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, s, y): summed price of a supplier and part; 1 if any line was returned, else 0 if any was accepted."""
    flag = F.max(F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0))
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.round(F.sum("l_extendedprice"), 2).alias("s"), flag.alias("y"))


def order_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("a"))


def attention(spark: SparkSession, d: str, scale: float = 10.0) -> DataFrame:
    return pairs.attention(order_tokens(spark, d), scale)
