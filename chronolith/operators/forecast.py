"""Forecasts of each series: smoothing as folds over the time-ordered values, and simple extrapolations.

Bounds of step i (from 0) are prediction -/+ z * se * sqrt(1 + widening * i).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = {0.9: 1.645, 0.95: 1.96, 0.99: 2.576}  # fixed values


def _series(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row a series: xs, its values in time order."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double")).alias("xs"))


def _steps(df: DataFrame, keys: list[str], h: int, prediction: Column, se: Column, confidence: float, widening: float) -> DataFrame:
    i = F.col("step") - 1
    width = F.lit(Z.get(confidence, 1.96)) * se * F.sqrt(1 + widening * i)
    out = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumn("prediction", prediction)
    return out.select(*keys, "step", "prediction", (F.col("prediction") - width).alias("lower"), (F.col("prediction") + width).alias("upper"))


def ses(df: DataFrame, keys, order, value, alpha=0.3, h=3, confidence=0.95) -> DataFrame:
    """Simple exponential smoothing: flat at the last level."""
    level = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.get("xs", F.lit(0)), lambda lv, x: alpha * x + (1 - alpha) * lv)
    return _steps(_series(df, keys, order, value).withColumn("lv", level), keys, h, F.col("lv"), F.lit(0.0), confidence, 0.1)


def holt(df: DataFrame, keys, order, value, alpha=0.5, beta=0.3, h=3, confidence=0.95) -> DataFrame:
    """Holt's linear trend; series of fewer than three values give no rows."""
    xs = _series(df, keys, order, value).where(F.size("xs") >= 3)
    start = F.struct(F.get("xs", F.lit(0)).alias("l"), ((F.get("xs", F.lit(2)) - F.get("xs", F.lit(0))) / 2).alias("b"))

    def step(s, x):
        lv = alpha * x + (1 - alpha) * (s["l"] + s["b"])
        return F.struct(lv.alias("l"), (beta * (lv - s["l"]) + (1 - beta) * s["b"]).alias("b"))

    fitted = xs.withColumn("s", F.aggregate(F.slice("xs", 2, F.size("xs") - 1), start, step))
    return _steps(fitted, keys, h, F.col("s.l") + F.col("step") * F.col("s.b"), F.lit(0.1), confidence, 0.1)


def holt_winters(df: DataFrame, keys, order, value, alpha=0.3, beta=0.1, gamma=0.2, period=4, h=4, confidence=0.95) -> DataFrame:
    """Additive Holt-Winters; its state is a season of values, so a series is one group. Fewer than two seasons give no rows."""
    import numpy as np
    import pandas as pd

    names = [*keys, "step", "prediction"]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", step int, prediction double"

    def run(key, pdf):
        x, m = pdf.sort_values(order)[value].to_numpy(dtype=float), period
        if len(x) < 2 * m:
            return pd.DataFrame(columns=names)
        level, slope = x[:m].mean(), (x[m] - x[0]) / m
        season = np.array([x[i::m].sum() / (len(x) // m) for i in range(m)]) - x.mean()  # whole seasons count, a begun one adds
        for i in range(1, len(x)):
            before, s = level, season[i % m]
            level = alpha * (x[i] - s) + (1 - alpha) * (level + slope)
            slope = beta * (level - before) + (1 - beta) * slope
            season[i % m] = gamma * (x[i] - level) + (1 - gamma) * s
        return pd.DataFrame([(*key, k, level + k * slope + season[(m - 1 + k) % m]) for k in range(1, h + 1)], columns=names)

    out = df.groupBy(*keys).applyInPandas(run, schema)
    width = F.lit(Z.get(confidence, 1.96)) * 0.1 * F.sqrt(1 + 0.1 * (F.col("step") - 1))
    return out.withColumn("lower", F.col("prediction") - width).withColumn("upper", F.col("prediction") + width)


def _ends(df: DataFrame, keys, order, value) -> DataFrame:
    """One row a series: n, first and last value in time order, ties by value; aggregates only."""
    at, v = F.struct(order, value), F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last"))


def moving_average(df: DataFrame, keys, order, value, weights=(1.0, 2.0, 3.0), h=3, confidence=0.95) -> DataFrame:
    """Weighted mean of the last len(weights) values; shorter series give no rows. Only those values are shuffled."""
    k = len(weights)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(value)))
    rows = df.select(*keys, order, F.col(value).cast("double").alias(value)).withColumn("__back", back).where(F.col("__back") <= k)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), k - F.col("__back"))
    means = rows.groupBy(*keys).agg(F.count("*").alias("__n"), (F.sum(F.col(value) * weight) / float(sum(weights))).alias("__m")).where(F.col("__n") == k)
    return _steps(means, keys, h, F.col("__m"), F.lit(0.1), confidence, 0.05)


def naive(df: DataFrame, keys, order, value, h=3, confidence=0.95) -> DataFrame:
    """The last value; the standard error is the sum of absolute steps over the count."""
    before = F.lag(F.col(value).cast("double")).over(Window.partitionBy(*keys).orderBy(order, value))
    rows = df.select(*keys, order, F.col(value).cast("double").alias(value)).withColumn("__step", F.abs(F.col(value) - before))
    at = F.struct(order, value)
    ends = rows.groupBy(*keys).agg(F.max_by(value, at).alias("__last"), (F.coalesce(F.sum("__step"), F.lit(0.0)) / F.count("*")).alias("__se"))
    return _steps(ends, keys, h, F.col("__last"), F.col("__se"), confidence, 0.1)


def drift(df: DataFrame, keys, order, value, h=3, confidence=0.95) -> DataFrame:
    """The last value plus the mean step."""
    slope = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(0.0)
    return _steps(_ends(df, keys, order, value), keys, h, F.col("last") + F.col("step") * slope, F.lit(0.0), confidence, 0.1)


MODELS = {"ses": ses, "holt": holt, "holt_winters": holt_winters, "moving_average": moving_average, "naive": naive, "drift": drift}


def forecast(df: DataFrame, keys, order, value, model: str = "ses", h: int = 3, confidence: float = 0.95, **options) -> DataFrame:
    """Any model's forecast in long form: keys, step, prediction, lower, upper, confidence, model."""
    if model not in MODELS:
        raise ValueError(f"no model {model!r}")
    out = MODELS[model](df, keys, order, value, h=h, confidence=confidence, **options)
    return out.select(*keys, F.col("step").cast("int").alias("step"), "prediction", "lower", "upper", F.lit(confidence).alias("confidence"), F.lit(model).alias("model"))
