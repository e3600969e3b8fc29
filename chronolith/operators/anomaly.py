"""Anomaly detectors over whole series: z-score, interquartile range, smoothing residuals, isolation forest, ensemble."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates


def _stats(df: DataFrame, keys: list[str], value: str, z: bool, q: bool) -> DataFrame:
    """df with its series' mean, deviation and quartiles: one aggregation, one join in which null keys are equal."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    aggs = {"__m": F.avg(value), "__s": F.when(sd < 1e-10, 1.0).otherwise(sd)} if z else {}
    return aggregates.same_keys(df, aggregates.grouped(df, keys, aggs, {"__q1": (value, 25), "__q3": (value, 75)} if q else {}), keys)


def _z(value: str) -> Column:
    return F.abs((F.col(value) - F.col("__m")) / F.col("__s"))


def _outside(value: str, mult: float) -> Column:
    low, high = F.col("__q1") - mult * (F.col("__q3") - F.col("__q1")), F.col("__q3") + mult * (F.col("__q3") - F.col("__q1"))
    return F.greatest(low - F.col(value), F.col(value) - high, F.when(F.col(value).isNotNull(), 0.0))


def zscore(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0) -> DataFrame:
    """df with score |z| and is_anomaly; a deviation under 1e-10 counts as 1. A null value has a null score."""
    out = _stats(df, keys, value, True, False).withColumn("score", _z(value))
    return out.withColumn("is_anomaly", F.col("score") > threshold).drop("__m", "__s")


def iqr(df: DataFrame, keys: list[str], value: str, mult: float = 1.5) -> DataFrame:
    """df with score (distance outside q1 - mult * iqr .. q3 + mult * iqr) and is_anomaly; quartiles are nearest-rank."""
    out = _stats(df, keys, value, False, True).withColumn("score", _outside(value, mult))
    return out.withColumn("is_anomaly", F.col("score") > 0).drop("__q1", "__q3")


def ensemble(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0, mult: float = 1.5) -> DataFrame:
    """df with the mean of both scores, anomalous if over the mean of threshold and mult."""
    out = _stats(df, keys, value, True, True).withColumn("score", (_z(value) + _outside(value, mult)) / 2)
    return out.withColumn("is_anomaly", F.col("score") > (threshold + mult) / 2).drop("__m", "__s", "__q1", "__q3")


def detect(df: DataFrame, keys: list[str], ts: str, value: str, zscore: float | None = 3.0, iqr: float | None = 1.5, forest: tuple[int, int] | None = None) -> DataFrame:
    """All detectors asked for in long form: a row for each row of df and detector, with keys, ts, value, score, is_anomaly, threshold, model."""
    marks = []
    if zscore is not None:
        marks.append(F.struct(_z(value).alias("score"), (_z(value) > zscore).alias("is_anomaly"), F.lit(float(zscore)).alias("threshold"), F.lit("zscore").alias("model")))
    if iqr is not None:
        marks.append(F.struct(_outside(value, iqr).alias("score"), (_outside(value, iqr) > 0).alias("is_anomaly"), F.lit(float(iqr)).alias("threshold"), F.lit("iqr").alias("model")))
    rows, out = df.select(*keys, ts, value), []
    if marks:
        out.append(_stats(rows, keys, value, zscore is not None, iqr is not None).select(*keys, ts, value, F.inline(F.array(*marks))))
    if forest:
        scored = isolation_forest(rows, value, *forest, keep_threshold=True)
        out.append(scored.select(*keys, ts, value, "score", "is_anomaly", "threshold", F.lit("isolation_forest").alias("model")))
    return functools.reduce(DataFrame.unionByName, out)


def smoothing_residuals(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.3, k: float = 3.0) -> DataFrame:
    """df with the residual against the level before (exponential smoothing) as score, anomalous if over k deviations."""
    from ..functions.series import ema

    level = ema(df, keys, order, value, alpha, "__level")
    w = Window.partitionBy(*keys).orderBy(*order)
    level = level.withColumn("score", F.abs(F.col(value) - F.coalesce(F.lag("__level").over(w), F.col(value))))
    sd = F.coalesce(F.stddev_samp("score").over(Window.partitionBy(*keys)), F.lit(0.0))
    return level.withColumn("is_anomaly", (F.col("score") > k * sd) & (sd > 0)).drop("__level")


def path_norm(n: int) -> float:
    return 1.0 if n <= 1 else 2 * math.log(n - 1) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, value: str, trees: int = 50, sample: int = 256, seed: int = 42, keep_threshold: bool = False) -> DataFrame:
    """df with score exp(-mean depth / c(sample)) over random one-dimensional split trees, anomalous over mean + 2 population deviations.

    The trees are grown from one seeded sample of at most ``sample`` values and are the only thing that is broadcast.
    """
    n = df.count()
    rows = df.select(value).where(F.col(value).isNotNull())
    got = rows.sample(fraction=min(1.0, 4 * sample / max(1, n)), seed=seed).orderBy(F.xxhash64(value), value).limit(4 * sample).toPandas()[value].sort_values().to_numpy()
    rng = np.random.default_rng(seed)
    got = rng.choice(got, min(sample, len(got)), replace=False) if len(got) else got
    limit = int(math.log2(max(2, sample)))

    def grow(x: np.ndarray, depth: int) -> list[tuple[float, float, int]]:
        if depth >= limit or len(x) <= 1 or x.min() == x.max():
            return [(depth,)]
        cut = rng.uniform(x.min(), x.max())
        return [*grow(x[x < cut], depth + 1), cut, *grow(x[x >= cut], depth + 1)]

    forest = []
    for _ in range(trees if len(got) else 0):
        flat = grow(got, 0)
        forest.append((np.array([x for x in flat if not isinstance(x, tuple)]), np.array([x[0] for x in flat if isinstance(x, tuple)])))
    shared, c = df.sparkSession.sparkContext.broadcast(forest), path_norm(sample)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype=float)
        depth = sum((d[np.searchsorted(cuts, x, side="right")] for cuts, d in shared.value), np.zeros(len(x)))
        return pd.Series(np.exp(-depth / max(1, len(shared.value)) / c))

    out = df.withColumn("score", score(F.col(value)))
    stats = out.agg((F.avg("score") + 2 * F.coalesce(F.stddev_pop("score"), F.lit(0.0))).alias("threshold"))  # one row
    out = out.crossJoin(F.broadcast(stats)).withColumn("is_anomaly", F.col("score") > F.col("threshold"))
    return out if keep_threshold else out.drop("threshold")
