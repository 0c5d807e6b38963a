"""Streaming forms of the mergeable aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.pairs import accumulate
from tessera.sources.published import publish, published, version_of


def pair_sums(weights: DataFrame) -> DataFrame:
    """Running (i, j, sum, cnt) over a stream of (sample, i, j, w): sums and counts merge, so no watermark is needed."""
    return accumulate(weights)


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, late ones accepted up to ``late`` (an extra beside the batch counts)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


class PairSums:
    """Sums over pairs of a stream's batches, kept in a folder so that a batch counts once however often it is delivered.

    A batch's sums are a table published under its id; a delivery that finds it published does nothing, and one that broke off
    had published nothing.  ``sums`` adds the batches up, which is what ``accumulate`` of all of them would give.
    ``compact`` merges the batches before an id into one table and from then on takes them for merged.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []

    def merged_before(self) -> int:
        """The id before which all batches are in one table; 0 where nothing was compacted."""
        ids = [int(n.removeprefix("upto-")) for n in self._names() if n.startswith("upto-")]
        return max((i for i in ids if version_of(self.spark, f"{self.path}/upto-{i}")), default=0)

    def merge(self, weights: DataFrame, batch: int) -> bool:
        """Add a batch, (i, j, w) or sums (i, j, sum, cnt) with a row a pair; False where it was in already."""
        if batch < self.merged_before() or version_of(self.spark, f"{self.path}/batch-{batch}"):
            return False
        try:
            publish(accumulate(weights) if "w" in weights.columns else weights.select("i", "j", "sum", "cnt"), f"{self.path}/batch-{batch}")
        except FileExistsError:  # another delivery of the same batch was faster
            return False
        return True

    def sums(self) -> DataFrame:
        """(i, j, sum, cnt) over all batches."""
        done = self.merged_before()
        names = [f"upto-{done}"] if done else []
        names += [n for n in self._names() if n.startswith("batch-") and int(n.removeprefix("batch-")) >= done and version_of(self.spark, f"{self.path}/{n}")]
        if not names:
            return self.spark.createDataFrame([], "i long, j long, sum double, cnt long")
        parts = [published(self.spark, f"{self.path}/{n}") for n in names]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return every.groupBy("i", "j").agg(F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"))

    def compact(self, before: int) -> None:
        """Merge the batches with ids below ``before``; none of them may be on its way."""
        if before <= self.merged_before():
            return
        done = self.merged_before()
        names = ([f"upto-{done}"] if done else []) + [n for n in self._names() if n.startswith("batch-") and done <= int(n.removeprefix("batch-")) < before]
        parts = [published(self.spark, f"{self.path}/{n}") for n in names if version_of(self.spark, f"{self.path}/{n}")]
        if not parts:
            return
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        publish(every.groupBy("i", "j").agg(F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt")), f"{self.path}/upto-{before}")
        for n in names:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def follow(self, stream: DataFrame, weigh: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger: object) -> StreamingQuery:
        """Start merging the batches of a stream, each turned into what ``merge`` takes by ``weigh``."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.merge(weigh(rows), batch) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()
