"""Random forests on pixels or cells."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.config import BANDS, INDICES
from cellmosaic.functions.spectral import indices


def features(df: DataFrame) -> DataFrame:
    """Adds the indices and ``x``, the vector of bands and indices as doubles."""
    own = df.withColumns(indices())
    wide = own.withColumns({f"_{c}": F.col(c).cast("double") for c in (*BANDS, *INDICES)})
    return VectorAssembler(inputCols=[f"_{c}" for c in (*BANDS, *INDICES)], outputCol="x").transform(wide).drop(*[f"_{c}" for c in (*BANDS, *INDICES)])


def train(sample: DataFrame, trees: int = 200, seed: int = 42, depth: int = 30) -> PipelineModel:
    """A forest with classes weighted to equal shares. ``depth`` has 30 as its most here; leaves hold five rows or more."""
    per = sample.groupBy("label").agg(F.count("*").alias("_n"))
    weights = per.withColumn("w", F.sum("_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_n"))).drop("_n")
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", weightCol="w", predictionCol="pred", numTrees=trees, minInstancesPerNode=5, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed
    )
    return Pipeline(stages=[forest]).fit(features(sample).join(F.broadcast(weights), "label"))  # weights: a row a class


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``pred``."""
    return model.transform(features(df)).withColumn("pred", F.col("pred").cast("int")).drop("x", "rawPrediction", "probability")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
