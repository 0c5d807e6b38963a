"""Vector algebra on array columns."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_pool(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, dim, mean): the mean of each component, dims from 0."""
    return vectors.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def group_mean(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(group, dim, mean): the mean vector of each group's members; ``groups`` (group, feature), ``vectors`` (feature, vector)."""
    return mean_pool(groups.join(vectors, "feature"), "group", "vector")


def softmax(table: DataFrame, by: list[str], value: str, name: str = "w") -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return table.withColumn("__e", e).withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def pca(vectors: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, pc1..pck) of centred vectors; the means are one aggregation; each component's largest loading is positive."""
    size = vectors.select(F.size(vector).alias("n")).first().n
    means = vectors.select(*[F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(size)]).first()
    centre = F.array(*[F.lit(float(m)) for m in means])
    centred = vectors.select(key, array_to_vector(F.zip_with(F.col(vector).cast("array<double>"), centre, lambda x, m: x - m)).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    y = vector_to_array("y")
    return model.transform(centred).select(key, *[(y[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])
