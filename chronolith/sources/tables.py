"""Time-partitioned Parquet tables: creation, writing, pruned reading, statistics, retention, deletion and downsampling.

Rows lie in folders _bucket=YYYY-MM-DD-HH of their own time. Transactions, logs and caches are left to Spark's commit protocol.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import aggregates
from ..functions.durations import interval, seconds

FORMATS = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd"}
# Tiers by age: the shortest that covers a row's age holds it, older ones are frozen; compression level and row group bytes (fixed values).
TIERS = (("hot", "7d", 1, 64 << 10), ("warm", "30d", 3, 256 << 10), ("cold", "365d", 5, 1 << 20), ("frozen", None, 7, 4 << 20))
META = "_table"  # a table's description, in a folder that readers pass over
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class DownsampleRule:
    """Buckets of width, aggregated by how, kept for keep."""

    name: str
    width: str
    how: str = "mean"
    keep: str = "365d"


def create(spark: SparkSession, path: str, schema: str, ts: str, tags: tuple[str, ...] = (), bucket: str = "hour", keep: str = "30d") -> None:
    """Write the table's description; rows come by write()."""
    about = {"schema": StructType.fromDDL(schema).json(), "ts": ts, "tags": list(tags), "bucket": bucket, "keep": keep}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/{META}")


def describe(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{META}").first()[0])


def insert(spark: SparkSession, path: str, rows: list[tuple] | DataFrame) -> None:
    """Append rows to a created table, cast to its columns."""
    about = describe(spark, path)
    schema = StructType.fromJson(json.loads(about["schema"]))
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
    write(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), path, about["ts"], about["bucket"])


def write(df: DataFrame, path: str, ts: str, bucket: str = "hour", mode: str = "append", tier: str = "warm") -> None:
    """Append rows, each to the bucket of its own time; one shuffle by bucket keeps files few, and splits a hot bucket by its size."""
    _, _, level, group = next(t for t in TIERS if t[0] == tier)
    rows = df.withColumn("_bucket", F.date_format(ts, FORMATS[bucket])).hint("rebalance", "_bucket")
    out = rows.write.mode(mode).partitionBy("_bucket").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    out.option("parquet.block.size", group).parquet(path)


def read_range(spark: SparkSession, path: str, ts: str, start: datetime, end: datetime, bucket: str = "hour") -> DataFrame:
    """Rows with start <= ts < end; whole buckets outside are pruned by folder, row groups by statistics."""
    lo, hi = (F.date_format(F.lit(x), FORMATS[bucket]) for x in (start, end))
    rows = read(spark, path)
    return rows.where((F.col("_bucket") >= lo) & (F.col("_bucket") <= hi) & (F.col(ts) >= F.lit(start).cast(rows.schema[ts].dataType)) & (F.col(ts) < F.lit(end).cast(rows.schema[ts].dataType)))


def _schema(spark: SparkSession, path: str):
    fields = [f for f in spark.read.parquet(path).schema if f.name != "_bucket"]
    return StructType([*fields, StructField("_bucket", StringType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).schema(_schema(spark, path)).parquet(path)


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, null_count, min, max (as text) and mean of numeric columns; one pass over df."""
    kinds = dict(df.dtypes)
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    aggs = [
        F.struct(F.lit(c).alias("column"), F.count("*").alias("count"), F.sum(F.col(c).isNull().cast("long")).alias("null_count"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), (F.avg(c) if kinds[c] in numeric else F.lit(None).cast("double")).alias("mean"))
        for c in columns
    ]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def expired(df: DataFrame, ts: str, now: str, keep: str = "30d") -> DataFrame:
    """Rows older than the retention period."""
    return df.where(F.col(ts) < F.expr(f"timestamp_ntz '{now}' - interval {interval(keep)}"))


def retained(df: DataFrame, ts: str, now: str, keep: str = "30d") -> DataFrame:
    return df.where(F.col(ts) >= F.expr(f"timestamp_ntz '{now}' - interval {interval(keep)}"))


def tiered(df: DataFrame, ts: str, now: str) -> DataFrame:
    """df with tier: hot, warm or cold by age; older rows are frozen."""
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))
    tier = F.lit(TIERS[-1][0])
    for name, span, *_ in reversed(TIERS[:-1]):
        tier = F.when(age <= seconds(span), name).otherwise(tier)
    return df.withColumn("tier", tier)


def downsample(df: DataFrame, ts: str, width: str, tags: list[str], value: str, how: str) -> DataFrame:
    """The aggregate of each bucket and tags."""
    out = df.withColumn("__at", F.window(ts, interval(width))["start"])
    out = out.withColumn("__ts", F.col(ts)).drop(ts)
    return aggregates.named(out, ["__at", *tags], {value: (how, value)}, "__ts").select(F.col("__at").alias(ts), *tags, value)


def downsample_table(spark: SparkSession, path: str, ts: str, tags: list[str], value: str, rule: DownsampleRule) -> str:
    """Write the rule's table beside the source's, with the rule as its description, and return its path."""
    to, out = f"{path}_{rule.name}", downsample(read(spark, path), ts, rule.width, tags, value, rule.how)
    write(out, to, ts, "day", mode="overwrite")
    spark.createDataFrame([(json.dumps({"source": path, "ts": ts, "tags": tags, **asdict(rule)}),)], "about string").coalesce(1).write.mode("overwrite").text(f"{to}/{META}")
    return to


def table_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, partitions, files and bytes."""
    files = read(spark, path).groupBy("_bucket", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("b"))
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("_bucket").alias("partitions"), F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def drop_expired(spark: SparkSession, path: str, now: datetime, keep: str = "30d", bucket: str = "hour") -> int:
    """Delete the folders of buckets that end before now - keep, and return how many; their names are listed, no row is read."""
    width = {"hour": 3600, "day": 86400}[bucket]
    start = F.unix_seconds(F.to_timestamp("_bucket", FORMATS[bucket]))
    limit = F.unix_seconds(F.lit(now).cast("timestamp")) - seconds(keep)
    gone = [r[0] for r in read(spark, path).select("_bucket").distinct().where(start + width <= limit).collect()]
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_bucket={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)


def delete(spark: SparkSession, path: str, to: str, condition: str) -> DataFrame:
    """Write the table without the rows for which condition is true to a new folder, and return it."""
    kept = read(spark, path).where(~F.coalesce(F.expr(condition), F.lit(False)))
    kept.hint("rebalance", "_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(to)
    return read(spark, to)


def compact(spark: SparkSession, path: str, to: str, bucket: str, file_bytes: int = FILE_BYTES) -> None:
    """Rewrite one bucket's files as few, about file_bytes each."""
    rows = read(spark, path).where(F.col("_bucket") == bucket)
    size = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct().agg(F.sum("b")).first()[0] or 0
    rows.repartition(max(1, -(-size // file_bytes))).write.mode("append").partitionBy("_bucket").option("compression", "zstd").parquet(to)


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def import_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Rows of CSV files with a header; columns are matched by position, what cannot be read becomes null."""
    return spark.read.option("header", True).option("sep", sep).option("enforceSchema", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").schema(schema).csv(path)
