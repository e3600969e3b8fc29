"""A fluent query over one DataFrame; every step stays a lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates
from ..functions.durations import interval


@dataclass(frozen=True)
class Query:
    df: DataFrame
    ts: str | None = None
    aggs: tuple[tuple[str, str, str], ...] = ()  # alias, aggregate, column
    keys: tuple[str, ...] = ()
    width: str | None = None

    def columns(self, *names: str) -> Query:
        return replace(self, df=self.df.select(*names))

    def filter(self, condition: Column | str) -> Query:
        return replace(self, df=self.df.where(condition))

    def time_range(self, start: str, end: str) -> Query:
        """start <= ts < end."""
        kind = self.df.schema[self.ts].dataType
        return replace(self, df=self.df.where((F.col(self.ts) >= F.lit(start).cast(kind)) & (F.col(self.ts) < F.lit(end).cast(kind))))

    def since(self, span: str, now: str) -> Query:
        """ts >= now - span."""
        kind = self.df.schema[self.ts].dataType
        return replace(self, df=self.df.where(F.col(self.ts) >= F.lit(now).cast(kind) - F.expr(f"interval {interval(span)}")))

    def group_by(self, *keys: str, every: str | None = None) -> Query:
        return replace(self, keys=keys, width=every)

    def aggregate(self, name: str, value: str, alias: str) -> Query:
        return replace(self, aggs=(*self.aggs, (alias, name, value)))

    def order_by(self, *columns) -> Query:
        return Query(self.build().orderBy(*columns), self.ts)

    def limit(self, n: int) -> Query:
        return Query(self.build().limit(n), self.ts)

    def union(self, other: Query) -> Query:
        return Query(self.build().unionByName(other.build()), self.ts)

    def join(self, other: DataFrame, on, how: str = "inner") -> Query:
        return Query(self.build().join(other, on, how), self.ts)

    def build(self) -> DataFrame:
        if not self.aggs:
            return self.df
        df, keys = self.df, [*self.keys]
        if self.width:
            df, keys = df.withColumn("bucket", F.window(self.ts, interval(self.width))["start"]), [*keys, "bucket"]
        return aggregates.named(df, keys, {alias: (name, value) for alias, name, value in self.aggs}, self.ts)
