"""Customer clustering and churn with pyspark.ml.

Training reads its rows many times, so they are kept in memory and on disk.
They are dealt by key into a fixed number of sorted parts first: where a model
starts from a draw of rows, the draw does not depend on the session's layout.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

FIXED_PARTS = 64


def _kept(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(FIXED_PARTS, key).sortWithinPartitions(key).persist()


def _numeric(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def kmeans_segments(
    df: DataFrame, features: list[str], key: str = "customer_id", n_segments: int = 4, seed: int = 42
) -> DataFrame:
    """Cluster standardised features; one row per key with its segment."""
    rows = _kept(_numeric(df.select(key, *features), features), key)
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        KMeans(featuresCol="scaled", predictionCol="cluster", k=n_segments, seed=seed, maxIter=200, tol=1e-9),
    ]
    model = Pipeline(stages=stages).fit(rows)
    centres = [c.tolist() for c in model.stages[-1].clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: centres[i])  # segments are numbered by centre
    scaled = vector_to_array("scaled")
    distance = lambda c: F.aggregate(
        F.zip_with(scaled, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x
    )
    distances = F.array(*[distance(centres[i]) for i in order])
    segment = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(len(centres))]), F.col("cluster") + 1)
    return (
        model.transform(rows)
        .withColumn("segment", segment)
        .withColumn("distance", F.element_at(distances, F.col("segment") + 1))
        .withColumn("is_nearest", F.col("distance") <= F.array_min(distances) + 1e-9)
        .select(key, *features, "segment", "distance", "is_nearest")
    )


def is_settled(segmented: DataFrame, features: list[str], within: float = 1e-4) -> DataFrame:
    """One row: whether the mean of each segment's rows is the point their distances were taken from.

    The squared distances to a segment's own mean add up to the least sum that
    any centre can have; at rest the model's centres reach it.
    """
    spread = segmented.agg(*[F.coalesce(F.when(F.stddev(c) > 0, F.stddev(c)), F.lit(1.0)).alias(c) for c in features])
    unit = spread.select(F.struct(*features)).scalar()
    scaled = segmented.withColumn("_unit", unit)
    per_segment = scaled.groupBy("segment").agg(
        F.sum("distance").alias("got"),
        sum((F.var_pop(F.col(c) / F.col(f"_unit.{c}")) for c in features), F.lit(0.0)).alias("least"),
        F.count(F.lit(1)).alias("n"),
    )
    total = F.sum(F.col("least") * F.col("n"))
    return per_segment.agg((F.sum("got") <= total * (1 + within) + within).alias("settled"))


CHURN_FEATURES = ["orders", "spent", "lines", "recency_days", "tenure_days"]


def churn_model(
    features: DataFrame, columns: list[str] | None = None, label: str = "churned", key: str = "customer_id"
) -> DataFrame:
    """Logistic regression on the features; one row per key with features and score."""
    columns = columns or CHURN_FEATURES
    rows = _kept(_numeric(features.select(key, label, *columns), columns), key)
    stages = [
        VectorAssembler(inputCols=columns, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=500, tol=1e-10),
    ]
    model = Pipeline(stages=stages).fit(rows)
    return model.transform(rows).select(
        key,
        label,
        *columns,
        vector_to_array("probability")[1].alias("churn_probability"),
        F.col("prediction").cast("int").alias("predicted"),
    )


def is_optimal(scored: DataFrame, columns: list[str] | None = None, label: str = "churned", within: float = 1e-3) -> DataFrame:
    """One row: whether the scores solve the regression's equations.

    At the optimum the residuals add up to zero, alone and weighted with every
    feature; both are taken per row and in units of the feature's deviation.
    """
    columns = columns or CHURN_FEATURES
    residual = F.col("churn_probability") - F.col(label).cast("double")
    sums = [F.abs(F.avg(residual)) <= within]
    for c in columns:
        unit = F.when(F.stddev(c) > 0, F.stddev(c)).otherwise(1.0)
        sums.append(F.abs(F.avg(residual * F.col(c)) - F.avg(residual) * F.avg(c)) / unit <= within)
    return scored.agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)]).select(
        F.forall(F.array(*[F.coalesce(f"_{i}", F.lit(True)) for i in range(len(sums))]), lambda x: x).alias("optimal")
    )
