"""Prediction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def micro(predictions: DataFrame, pred: str = "pred", truth: str = "true") -> DataFrame:
    """(mse, mae, n) over all targets."""
    e = F.col(pred) - F.col(truth)
    return predictions.agg(F.round(F.avg(e * e), 6).alias("mse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.count(e).alias("n"))


def micro_heads(predictions: DataFrame, heads: dict[str, str], truth: str = "true") -> DataFrame:
    """(head, mse, mae, n) over all targets for each head's column, in one pass over the predictions."""
    e = {h: F.col(c) - F.col(truth) for h, c in heads.items()}
    found = [F.struct(F.lit(h).alias("head"), F.round(F.avg(x * x), 6).alias("mse"), F.round(F.avg(F.abs(x)), 6).alias("mae"), F.count(x).alias("n")) for h, x in e.items()]
    return predictions.agg(F.array(*found).alias("h")).select(F.explode("h").alias("h")).select("h.*")


def macro(predictions: DataFrame, pred: str = "pred", truth: str = "true") -> DataFrame:
    """(mse, n_samples): the mean of the samples' own means, over samples that have targets."""
    e = F.col(pred) - F.col(truth)
    per = predictions.groupBy("sample").agg(F.avg(e * e).alias("mse")).where(F.col("mse").isNotNull())
    return per.agg(F.round(F.avg("mse"), 6).alias("mse"), F.count("*").alias("n_samples"))


def weighted(batches: DataFrame, loss: str = "loss", size: str = "n") -> DataFrame:
    """The mean batch loss weighted by batch size, targets or not."""
    return batches.agg(F.round(F.try_divide(F.sum(F.col(loss) * F.col(size)), F.sum(size)), 6).alias("loss"))


def best_epoch(losses: DataFrame, delta: float, patience: int) -> DataFrame:
    """(run, best_epoch, best_loss, last_epoch, stopped) from (run, epoch, loss): the checkpoint that early stopping keeps.

    An epoch is the best when its loss is below the best so far by more than ``delta``; after ``patience`` epochs in a row that
    aren't, the run stops and later epochs count no more.  A loss that is null or not a number is never the best.  Ordered
    by epoch, then loss; one fold a run over its own epochs.  Without a best epoch those columns are null.
    """
    steps = F.sort_array(F.collect_list(F.struct("epoch", "loss")))
    start = F.struct(F.lit(None).cast("long").alias("epoch"), F.lit(None).cast("double").alias("loss"), F.lit(0).alias("waited"), F.lit(None).cast("long").alias("last"))

    def step(state, x):
        better = x["loss"].isNotNull() & ~F.isnan(x["loss"]) & (state["loss"].isNull() | (x["loss"] < state["loss"] - F.lit(float(delta))))
        after = F.when(better, F.struct(x["epoch"].cast("long").alias("epoch"), x["loss"].cast("double").alias("loss"), F.lit(0).alias("waited"), x["epoch"].cast("long").alias("last")))
        after = after.otherwise(F.struct(state["epoch"].alias("epoch"), state["loss"].alias("loss"), (state["waited"] + 1).alias("waited"), x["epoch"].cast("long").alias("last")))
        return F.when(state["waited"] >= patience, state).otherwise(after)

    folded = losses.groupBy("run").agg(F.aggregate(steps, start, step).alias("s"))
    return folded.select("run", F.col("s.epoch").alias("best_epoch"), F.col("s.loss").alias("best_loss"), F.col("s.last").alias("last_epoch"), (F.col("s.waited") >= patience).alias("stopped"))
