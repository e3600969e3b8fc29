"""Classifiers on feature vectors through MLlib pipelines, which train and score on the cluster."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = {
    "decision_tree": lambda seed: DecisionTreeClassifier(impurity="entropy", maxDepth=5, maxBins=128, minInstancesPerNode=5, seed=seed),
    "random_forest": lambda seed: RandomForestClassifier(numTrees=10, maxDepth=5, bootstrap=False, subsamplingRate=2 / 3, featureSubsetStrategy="all", impurity="entropy", seed=seed),
    "logistic_regression": lambda seed: LogisticRegression(regParam=0.0, standardization=False, maxIter=50),
}


def train(df: DataFrame, features: list[str], label: str, model: str = "decision_tree", seed: int = 42):
    """A fitted pipeline, which can be saved, loaded and applied to streams."""
    rows = df.withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), MODELS[model](seed)]).fit(rows)


def predict(fitted, df: DataFrame, keep: list[str]) -> DataFrame:
    out = fitted.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))


def report(fitted, df: DataFrame, keep: list[str], model: str) -> DataFrame:
    """predict() with the classes' names and the model's."""
    out = predict(fitted, df, keep)
    classes = F.transform(F.sequence(F.lit(0), F.size("probability") - 1), lambda i: F.concat(F.lit("class_"), i.cast("string")))
    return out.select(*keep, "prediction", "probability", classes.alias("classes"), F.lit(model).alias("model"))
