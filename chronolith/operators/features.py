"""Features of each series: distribution, shape in time, trend, change points and spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A


def statistical(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, median, std, var, min, max, range, q1, q3, iqr, skewness, kurtosis, entropy, cv, energy of each series.

    Skewness and kurtosis take population moments over the sample deviation; entropy is that of |x| / sum |x| in bits.
    """
    v = F.col(value)
    n = F.count(v)
    aggs = {
        "n": n, "mean": F.avg(v), "std": A.stddev(v), "var": A.variance(v), "min": F.min(v), "max": F.max(v), "energy": F.sum(v * v), "sk": F.skewness(v), "ku": F.kurtosis(v),
        "total": F.sum(F.abs(v)), "xlogx": F.sum(F.when(F.abs(v) > 0, F.abs(v) * F.log2(F.abs(v)))),
    }
    s = A.grouped(df, keys, aggs, {"median": (value, 50), "q1": (value, 25), "q3": (value, 75)})
    f = (F.col("n") - 1) / F.col("n")
    flat = F.col("std") < 1e-10
    return s.select(
        *keys, "mean", "median", "std", "var", "min", "max", (F.col("max") - F.col("min")).alias("range"), "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(flat, 0.0).otherwise(F.col("sk") * F.pow(f, 1.5)).alias("skewness"),
        F.when(flat, 0.0).otherwise((F.col("ku") + 3) * f * f - 3).alias("kurtosis"),
        F.when(F.col("total") < 1e-10, 0.0).otherwise(F.log2("total") - F.coalesce("xlogx", F.lit(0.0)) / F.col("total")).alias("entropy"),
        F.when(F.abs("mean") < 1e-10, 0.0).otherwise(F.col("std") / F.abs("mean")).alias("cv"), "energy",
    )


def temporal(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Zero and mean crossings, lag-1 autocorrelation, peaks, troughs, change points and stationarity of each series.

    A change point turns by more than 2 * sqrt(sum (x - m)^2) / n.
    """
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    v = F.col(value)
    x = df.select(*keys, v.alias("v"), F.lag(v).over(w).alias("p"), F.lag(v, 2).over(w).alias("pp"), F.lead(v).over(w).alias("nx"), F.avg(v).over(whole).alias("m"), F.stddev_pop(v).over(whole).alias("sd"), F.row_number().over(w).alias("i"), F.count(v).over(whole).alias("n"))
    d, dp = F.col("v") - F.col("p"), F.col("p") - F.col("pp")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    c0 = F.sum((F.col("v") - F.col("m")) ** 2)
    half = F.col("i") <= F.floor(F.col("n") / 2)
    v1, v2 = F.var_pop(F.when(half, F.col("v"))), F.var_pop(F.when(~half, F.col("v")))
    return x.groupBy(*keys).agg(
        one(F.col("v") * F.col("p") < 0).alias("zero_crossings"),
        one((F.col("v") - F.col("m")) * (F.col("p") - F.col("m")) < 0).alias("mean_crossings"),
        F.when((F.count("*") <= 1) | (c0 / F.count("*") < 1e-10), 0.0).otherwise(F.sum((F.col("v") - F.col("m")) * (F.col("p") - F.col("m"))) / F.when(c0 > 0, c0).otherwise(1.0)).alias("autocorrelation"),
        one((F.col("v") > F.col("p")) & (F.col("v") > F.col("nx"))).alias("peaks"),
        one((F.col("v") < F.col("p")) & (F.col("v") < F.col("nx"))).alias("troughs"),
        one((d * dp < 0) & (F.abs(d) > 2 * F.col("sd") / F.sqrt("n"))).alias("change_points"),
        F.when(F.count("*") < 4, 1.0).when(F.greatest(v1, v2) > 0, F.least(v1, v2) / F.when(F.greatest(v1, v2) > 0, F.greatest(v1, v2)).otherwise(1.0)).otherwise(0.0).alias("stationarity"),
    )


def trend(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Regression on the index 0..n-1: slope, intercept, mean squared residual and direction."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    x = df.select(*keys, F.col(value).alias("v"), i.cast("double").alias("i"))
    slope, intercept = A.linear_regression(F.col("v"), F.col("i"))
    out = x.groupBy(*keys).agg(F.coalesce(slope, F.lit(0.0)).alias("slope"), F.coalesce(intercept, F.avg("v")).alias("intercept"), F.coalesce(F.regr_syy("v", "i") - F.pow(F.regr_sxy("v", "i"), 2) / F.nullif(F.regr_sxx("v", "i"), F.lit(0.0)), F.lit(0.0)).alias("ss"), F.count("*").alias("n"))
    direction = F.when(F.col("slope") > 0.01, 1).when(F.col("slope") < -0.01, -1).otherwise(0)
    return out.select(*keys, "slope", "intercept", (F.col("ss") / F.col("n")).alias("residual_var"), direction.alias("direction"))


def spectral(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Dominant frequency, centroid, 85 % rolloff, entropy (of the magnitudes) and energy of each series' Fourier transform."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", dominant double, centroid double, rolloff double, entropy double, energy double"

    def run(key, pdf):
        x = pdf.sort_values(order)[value].to_numpy(dtype=float)
        n = len(x)
        mag = np.abs(np.fft.rfft(x))[: n // 2]
        e, f = mag**2, np.arange(n // 2) / max(1, n)
        total = e.sum()
        if not total:
            return pd.DataFrame([(*key, 0.0, 0.0, 0.0, 0.0, 0.0)], columns=[*keys, "dominant", "centroid", "rolloff", "entropy", "energy"])
        p = mag[mag > 0] / mag.sum()
        top = f[len(mag) - 1 - int(np.argmax(mag[::-1]))]
        return pd.DataFrame([(*key, top, (f * e).sum() / total, f[int(np.argmax(np.cumsum(e) >= 0.85 * total))], -(p * np.log2(p)).sum(), total)], columns=[*keys, "dominant", "centroid", "rolloff", "entropy", "energy"])

    return df.groupBy(*keys).applyInPandas(run, schema)


# The vector's groups, each with its columns in order (fixed order); the strengths are constants of the method.
GROUPS = {
    "statistical": ["mean", "median", "std", "var", "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis", "entropy", "cv", "energy"],
    "temporal": ["zero_crossings", "mean_crossings", "autocorrelation", "peaks", "troughs", "stationarity", "trend_strength", "seasonality_strength"],
    "trend": ["slope", "intercept", "residual_var", "direction", "change_points"],
    "spectral": ["dominant", "centroid", "rolloff", "spectral_entropy", "spectral_energy"],
}
STRENGTHS = {"trend_strength": 0.5, "seasonality_strength": 0.3}


def vector(df: DataFrame, keys: list[str], order: list[str], value: str, include: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """keys and features, 33 doubles a series in a fixed order; a group that is not included is zeros."""
    out = df.select(*keys).distinct()
    if "statistical" in include:
        out = A.same_keys(out, statistical(df, keys, value), keys, "left")
    if {"temporal", "trend"} & set(include):
        some = temporal(df, keys, order, value)
        out = A.same_keys(out, some.select(*keys, *[F.lit(x).alias(n) for n, x in STRENGTHS.items()], *[c for c in some.columns if c not in keys]), keys, "left")
    if "trend" in include:
        out = A.same_keys(out, trend(df, keys, order, value), keys, "left")
    if "spectral" in include:
        out = A.same_keys(out, spectral(df, keys, order, value).withColumnsRenamed({"entropy": "spectral_entropy", "energy": "spectral_energy"}), keys, "left")
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if g in include else F.lit(0.0) for g, names in GROUPS.items() for c in names]
    return out.select(*keys, F.array(*parts).alias("features"))
