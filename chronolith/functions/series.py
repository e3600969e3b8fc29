"""Functions of one series in time order. All take the same window of the series, so that a query sorts once."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_of(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def delta(v: Column, w) -> Column:
    return F.coalesce(v - F.lag(v).over(w), F.lit(0.0))


def rate(v: Column, ts: Column, w) -> Column:
    """Change a second since the row before; 0 for the first row and where no time passed."""
    dt = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return F.when(dt > 0, (v - F.lag(v).over(w)) / (dt / 1e6)).otherwise(0.0)


def moving_avg(v: Column, w, k: int) -> Column:
    return F.avg(v).over(w.rowsBetween(-(k - 1), 0))


def moving_stddev(v: Column, w, k: int) -> Column:
    return F.coalesce(F.stddev_samp(v).over(w.rowsBetween(-(k - 1), 0)), F.lit(0.0))


def forward_fill(v: Column, w, leading: float | None = 0.0) -> Column:
    filled = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return filled if leading is None else F.coalesce(filled, F.lit(leading))


def interpolate(v: Column, w) -> Column:
    """Value k of a gap of length c between a and b is a + k/c * (b - a), k from 0; gaps at an end take the nearest value, 0 if all is null."""
    n = F.row_number().over(w)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(v.isNotNull(), n)
    a, i = F.last(v, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(back)
    b, j = F.first(v, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
    inner = a + (n - i - 1) / F.when(j - i > 1, j - i - 1).otherwise(1) * (b - a)
    return F.coalesce(v, inner, a, b, F.lit(0.0))


def zscore(v: Column, mean: Column, sd: Column) -> Column:
    return F.when(F.abs(sd) < 1e-10, 0.0).otherwise((v - mean) / F.when(F.abs(sd) < 1e-10, 1.0).otherwise(sd))


def anomaly_score(v: Column, w, keys: list[str], k: int, threshold: float) -> Column:
    """|z| over the last k rows where it is over the threshold, else 0; 0 before row k and in series shorter than k."""
    frame = w.rowsBetween(-(k - 1), 0)
    z = F.abs(zscore(v, F.avg(v).over(frame), F.coalesce(F.stddev_samp(v).over(frame), F.lit(0.0))))
    return F.when((F.row_number().over(w) >= k) & (z > threshold), z).otherwise(0.0)


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, name: str = "ema") -> DataFrame:
    """df with the exponential moving average e = alpha * v + (1 - alpha) * e of each series; a null v leaves e as it is.

    A recursion, so a series is worked off in order in one task: partitions hold many sorted series, which stream by.
    """
    alpha = min(max(alpha, 0.0), 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, last = None, None
        for b in batches:
            out = []
            series = zip(*[b[k].astype(object).where(b[k].notna(), None) for k in keys], strict=True) if keys else itertools.repeat(())
            for key, v in zip(series, b[value].astype(float).tolist(), strict=False):
                if key != last:
                    level, last = None, key
                if v == v:
                    level = v if level is None else alpha * v + (1 - alpha) * level
                out.append(level)
            yield b.assign(**{name: pd.array(out, dtype="Float64")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else df.repartition(1).sortWithinPartitions(*order)
    return rows.mapInPandas(run, schema)


def bucketed(df: DataFrame, ts: str, width: str, keys: list[str], ranks: dict[str, tuple[str, float]] | None = None, **aggs: Column) -> DataFrame:
    """Aggregates, and percentiles ranks = {name: (column, p)}, by tumbling bucket (and keys); the bucket is the start of its window."""
    from .aggregates import grouped
    from .durations import interval

    if ranks:
        return grouped(df.withColumn("bucket", F.window(ts, interval(width))["start"]), ["bucket", *keys], aggs, ranks)
    out = df.groupBy(F.window(ts, interval(width)), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("window.start").alias("bucket"), *keys, *aggs)


def spine(df: DataFrame, bucket: str, width: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for every bucket from the first to the last of df (of each series, if keys are given), with df's columns or nulls."""
    from .durations import interval

    ends = df.groupBy(*keys).agg(F.min(bucket).alias("__a"), F.max(bucket).alias("__b"))
    out = ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr(f"interval {interval(width)}"))).alias(bucket))
    if not keys:
        return out.join(df, bucket, "left")
    from .aggregates import same_keys

    return same_keys(out, df, [*keys, bucket], "left").select(*df.columns)
