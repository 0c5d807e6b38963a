"""Places and running totals in a total order, without a task that meets all rows."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import write_table


def running_total(rows: DataFrame, by: Sequence[str | Column], value: str | Column, name: str, within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each in the order ``by``, from 0, as ``name``.

    ``within`` names columns (never null) whose equal rows are summed apart; ``total`` names a column for the
    sum of all rows summed together.  Rows that are equal in ``by`` follow one another in any order.

    Rows are dealt into ranges by a sample of their keys and written with the number of their range, so that
    nothing moves when a task is run again.  Ranges are summed apart; only those sums (one a range and
    ``within``) are added up over ranges.  A row number closes the key, so that rows of one key are split too.
    """
    tag = uuid4().hex
    part, salt, sum_, base, whole = (f"{x}_{tag}" for x in ("part", "salt", "sum", "base", "whole"))
    each = F.col(value) if isinstance(value, str) else value
    dealt = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*within, *by, salt).withColumn(part, F.spark_partition_id())
    held = write_table(dealt, "ranges")
    sums = held.groupBy(*within, part).agg(F.sum(each).alias(sum_))
    over = Window.partitionBy(*within).orderBy(part)
    bases = sums.select(*within, part, (F.sum(sum_).over(over) - F.col(sum_)).alias(base), F.sum(sum_).over(Window.partitionBy(*within)).alias(whole))
    before = Window.partitionBy(part, *within).orderBy(*by, salt).rowsBetween(Window.unboundedPreceding, -1)
    own = held.withColumn(name, F.coalesce(F.sum(each).over(before), F.lit(0))).join(bases, [part, *within])
    placed = own.withColumn(name, F.col(base) + F.col(name))
    if total:
        placed = placed.withColumn(total, F.col(whole))
    return placed.select(*rows.columns, name, *([total] if total else []))


def place(rows: DataFrame, by: Sequence[str | Column], name: str = "place", within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """``rows`` with their place in the order ``by`` (within each ``within``), from 0, and the number of rows as ``total``."""
    return running_total(rows, by, F.lit(1).cast("long"), name, within, total)
