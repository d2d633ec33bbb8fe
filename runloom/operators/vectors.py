"""Vector series: norms, cosines and projections of embeddings, by higher-order functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null, of another length, or zero."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n)


def step_series(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """df with cos_step (to the vector before) and move (length of the difference); null at a group's start."""
    prev = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    d = df.withColumn("_p", prev)
    diff = F.zip_with(F.col(vector), F.col("_p"), lambda x, y: x.cast("double") - y.cast("double"))
    return d.withColumn("cos_step", cosine(F.col(vector), F.col("_p"))).withColumn("move", F.when(F.col("_p").isNotNull(), norm(diff))).drop("_p")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): mean vector of each group; combined map-side coordinate by coordinate."""
    x = df.select(group, F.posexplode(vector).alias("i", "x"))
    m = x.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def to_centroid(df: DataFrame, group: str, vector: str) -> DataFrame:
    return df.join(centroids(df, group, vector), group).withColumn("cos_centroid", cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def first_component(df: DataFrame, vector: str) -> list[float]:
    """The first principal axis, its sign fixed by a positive first non-zero coordinate. Covariances are summed in Spark."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=1, inputCol="v", outputCol="p").fit(df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v")))
    axis = [float(x) for x in model.pc.toArray()[:, 0]]
    sign = next((1 if x > 0 else -1 for x in axis if abs(x) > 1e-12), 1)
    return [sign * x for x in axis]


def project(df: DataFrame, vector: str, axis: list[float]) -> DataFrame:
    return df.withColumn("pca1", dot(F.col(vector), F.array(*[F.lit(x) for x in axis])))
