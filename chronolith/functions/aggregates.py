"""Aggregates by name, with the semantics of a time-series engine: nearest-rank percentiles, sample deviations that are 0 for one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# grouped() looks for a percentile between sketched bounds this far below and above it; groups up to SMALL are looked
# through as a whole. The sketch's error and one rank stay below MARGIN for any larger group.
ACCURACY, SMALL, MARGIN = 4_000, 10_000, 5e-4


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by keys, null keys being equal; right's other columns follow left's."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, match, how).drop(*[f"__{k}" for k in keys])


def grouped(df: DataFrame, keys: list[str], aggs: dict[str, Column], ranks: dict[str, tuple[str, float]]) -> DataFrame:
    """One row a group: keys, aggs, and by name the nearest-rank percentiles ranks = {name: (column, p)}.

    A percentile is the sorted non-null value at round-half-up(p/100 * (n - 1)), p clamped to 0..100, null if there is
    none. A first pass sketches bounds around each, which share partial aggregates; a second one counts what lies below
    and the distinct values between them, so that no group's values meet in one row or, for large groups, in one task.
    """
    if not ranks:
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    columns = sorted({v for v, _ in ranks.values()})
    cuts: list[list[float]] = [[] for _ in columns]
    looked = []
    for i, (v, p) in enumerate(ranks.values()):
        q, j = min(max(p, 0.0), 100.0) / 100, columns.index(v)
        few, at = f"__n{j} <= {SMALL}", len(cuts[j])
        cuts[j] += [max(0.0, q - MARGIN), min(1.0, q + MARGIN)]
        # A null value stands for all values below the bounds.
        value = f"CASE WHEN {few} OR `{v}` >= get(__cuts{j}, {at}) THEN CAST(`{v}` AS DOUBLE) END"
        looked.append(f"struct({i} AS __i, floor({q!r}D * (__n{j} - 1) + 0.5D) + 1 AS __rank, {value} AS __v, `{v}` IS NOT NULL AND ({few} OR `{v}` <= get(__cuts{j}, {at + 1})) AS __in)")
    sketches = [F.expr(x) for j, v in enumerate(columns) for x in (f"count(`{v}`) AS __n{j}", f"percentile_approx(`{v}`, array({', '.join(f'{x!r}D' for x in cuts[j])}), {ACCURACY}) AS __cuts{j}")]
    base = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*sketches)
    quoted = [f"`{k}`" for k in keys]
    found = df.select(*keys, *[v for v in columns if v not in keys]).join(base, F.expr(" AND ".join(f"`{k}` <=> `__{k}`" for k in keys) or "true"))
    found = found.selectExpr(*quoted, f"inline(array({', '.join(looked)}))").where("__in")
    counts = found.groupBy(*keys, "__i", "__rank", "__v").agg(F.expr("count(1) AS __c"))
    upto = f"sum(__c) OVER (PARTITION BY {', '.join([*quoted, '__i'])} ORDER BY __v ASC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS __upto"
    picks = counts.selectExpr("*", upto).where("__upto >= __rank AND __upto - __c < __rank").selectExpr(*quoted, "__i", "__v", *[f"NULL AS `{n}`" for n in aggs])
    groups = df.groupBy(*keys).agg(F.expr("CAST(NULL AS INT) AS __i"), F.expr("CAST(NULL AS DOUBLE) AS __v"), *[c.alias(n) for n, c in aggs.items()])
    picked = [f"CAST(max(CASE WHEN __i = {i} THEN __v END) AS {df.schema[v].dataType.simpleString()}) AS `{n}`" for i, (n, (v, _)) in enumerate(ranks.items())]
    return groups.union(picks).groupBy(*keys).agg(*[F.expr(f"any_value(`{n}`, true) AS `{n}`") for n in aggs], *[F.expr(x) for x in picked])


def percentile_by_rank(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """One nearest-rank percentile of each group."""
    return grouped(df, keys, {}, {name: (value, p)})


def first(value: Column, ts: Column) -> Column:
    return F.min_by(value, ts)


def last(value: Column, ts: Column) -> Column:
    return F.max_by(value, ts)


def stddev(value: Column) -> Column:
    return F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))


def variance(value: Column) -> Column:
    return F.when(F.count(value) > 0, F.coalesce(F.var_samp(value), F.lit(0.0)))


def delta(value: Column, ts: Column) -> Column:
    return last(value, ts) - first(value, ts)


def rate(value: Column, ts: Column) -> Column:
    """(last - first) a second; 0 for a single point or no time span."""
    span = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return F.when(span > 0, delta(value, ts) / span).otherwise(0.0)


def trend(value: Column, ts: Column, threshold: float) -> Column:
    """1, -1 or 0: whether the mean step (last - first) / (n - 1) is over the threshold, under its negative, or neither."""
    step = F.when(F.count(value) > 1, delta(value, ts) / (F.count(value) - 1)).otherwise(0.0)
    return F.when(step > threshold, 1).when(step < -threshold, -1).otherwise(0)


def linear_regression(y: Column, x: Column) -> tuple[Column, Column]:
    """Slope and intercept; null with fewer than two points or x without spread."""
    ok = (F.count(y) > 1) & (F.abs(F.count(y) * F.sum(x * x) - F.sum(x) * F.sum(x)) >= 1e-10)
    return F.when(ok, F.regr_slope(y, x)), F.when(ok, F.regr_intercept(y, x))


# Aggregates of a value in time order, by name; percentiles; aliases (fixed names).
BY_NAME = {
    "count": lambda v, t: F.count(v),
    "sum": lambda v, t: F.sum(v),
    "mean": lambda v, t: F.avg(v),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "first": first,
    "last": last,
    "stddev": lambda v, t: stddev(v),
    "variance": lambda v, t: variance(v),
    "rate": rate,
    "delta": delta,
}
PERCENTILES = {"median": 50.0, "p50": 50.0, "p95": 95.0, "p99": 99.0, "p999": 99.9}
ALIASES = {"avg": "mean", "average": "mean", "std_dev": "stddev", "var": "variance"}


def named(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str]], ts: str) -> DataFrame:
    """One row a group with wanted = {alias: (aggregate's name, column)}, in that order."""
    aggs, ranks = {}, {}
    for alias, (name, value) in wanted.items():
        name = ALIASES.get(name.lower(), name.lower())
        if name in PERCENTILES:
            ranks[alias] = (value, PERCENTILES[name])
        elif name in BY_NAME:
            aggs[alias] = BY_NAME[name](F.col(value), F.col(ts) if ts else None)
        else:
            raise ValueError(f"no aggregate {name!r}")
    return grouped(df, keys, aggs, ranks).select(*keys, *wanted)


# Functions of series, detectors and forecasts by name, with what they give (fixed names).
SERIES = {
    "rate": "change a second", "delta": "change since the row before", "moving_avg": "mean of the last k rows", "ema": "exponential moving average", "moving_stddev": "deviation of the last k rows",
    "forward_fill": "last value that is not null", "interpolate": "straight line over nulls", "zscore": "distance from the mean in deviations", "anomaly_score": "z-score of the last k rows over a threshold",
    "bucket": "start of the time bucket", "trend": "direction of the mean step", "linear_regression": "slope and intercept", "correlation": "Pearson's correlation", "covariance": "sample covariance",
    "fill": "a row for every bucket", "percentile": "nearest-rank percentile", "holt_winters": "seasonal forecast", "forecast": "forecast by a model", "anomaly": "detectors' scores",
}


def list_functions(spark) -> DataFrame:
    """(name, kind) of all aggregates and their aliases, and (name, what it gives) of the other functions."""
    rows = [(k, "aggregate") for k in (*BY_NAME, *PERCENTILES)] + [(k, f"aggregate, {v}") for k, v in ALIASES.items()]
    return spark.createDataFrame(sorted({**dict(rows), **SERIES}.items()), "name string, description string")
