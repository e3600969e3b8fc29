"""A registry of fitted MLlib pipelines: each saved under its name and version, with a description beside it."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABOUT = "name string, version int, kind string, about string"


def save(spark: SparkSession, root: str, name: str, version: int, fitted: PipelineModel, **about) -> str:
    """Write the model; a version that exists is an error."""
    path = f"{root}/models/{name}/{version}"
    fitted.write().save(path)
    row = (name, version, type(fitted.stages[-1]).__name__, json.dumps(about, sort_keys=True))
    spark.createDataFrame([row], ABOUT).coalesce(1).write.mode("append").json(f"{root}/about")
    return path


def models(spark: SparkSession, root: str) -> DataFrame:
    """One row a model and version."""
    return spark.read.schema(ABOUT).json(f"{root}/about")


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> PipelineModel:
    """The model of that version, the latest one without."""
    if version is None:
        version = models(spark, root).where(F.col("name") == name).agg(F.max("version")).first()[0]
        if version is None:
            raise ValueError(f"no model {name!r}")
    return PipelineModel.load(f"{root}/models/{name}/{version}")
