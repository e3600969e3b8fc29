"""Event-time streams: tumbling and session windows, duplicates, and per-key state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import interval


def stream(spark: SparkSession, path: str, ts: str = "ts", files_per_trigger: int = 100) -> DataFrame:
    """A Parquet folder as a stream with event time in UTC; a few files a trigger hold back the pressure."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(rows: DataFrame, ts: str, width: str, keys: list[str], late: str = "10m", **aggs) -> DataFrame:
    out = rows.withWatermark(ts, interval(late)).groupBy(F.window(ts, interval(width)), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("window.start").alias("bucket"), *keys, *aggs)


def sessions(rows: DataFrame, ts: str, gap: str, key: str, late: str = "10m") -> DataFrame:
    out = rows.withWatermark(ts, interval(late)).groupBy(F.session_window(ts, interval(gap)), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(rows: DataFrame, ts: str, keys: list[str], late: str = "10m") -> DataFrame:
    return rows.withWatermark(ts, interval(late)).dropDuplicatesWithinWatermark(keys)


def stateful_ema(rows: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """The running exponential moving average of each key, kept in state between batches: one row a key and batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches, state: GroupState):
        pdf = pd.concat(list(batches)).sort_values(order)
        level, n = state.get if state.exists else (None, 0)
        for v in pdf[value]:
            level = v if level is None else alpha * v + (1 - alpha) * level
        state.update((float(level), n + len(pdf)))
        yield pd.DataFrame({key: [k[0]], "n": [n + len(pdf)], "ema": [float(level)]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ema double", "ema double, n long", "append", GroupStateTimeout.NoTimeout)


def run_once(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off what is there into Parquet files, exactly once by the sink's log, and read the result."""
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def run_batches(out: DataFrame, process, checkpoint: str) -> list[dict]:
    """Work off what is there, each batch by process(batch, number), and return the query's progress."""
    q = out.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]


def progress(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """A stream's progress as rows: batch, input rows, rows a second, milliseconds."""
    rows = [(p["batchId"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0.0), int(p["batchDuration"])) for p in reports]
    return spark.createDataFrame(rows, "batch long, input_rows long, rows_per_second double, millis long")
