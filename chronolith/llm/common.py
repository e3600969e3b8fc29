"""Shared helpers: scratch tables in the cluster's shared folder, partition counts, text hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="chronolith-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local_scratch()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return it as read back.

    This cuts lineage: a lost executor costs no more than the running job's own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each holds about rows_each rows, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def join_by_key(rows: DataFrame, stats: DataFrame, keys: list[str], n_rows: int, most: int = 2_000) -> DataFrame:
    """rows.join(stats, keys), where stats has at most one row a key and n, how many of the n_rows rows have it.

    Keys with over n_rows / most rows, of which there are fewer than most, are split into parts of about that many rows,
    so that no hot key is one task's: their rows get a salt, and their stats one row for each salt. A row's salt follows
    from its content and its task's number, so that a task that is run again deals its rows alike. Hot keys are told by
    their hash; what shares one is split with them.
    """
    stats, mark = materialise(stats, "keys"), F.xxhash64(*keys)
    hot = stats.where(F.col("n") > max(128, n_rows // most)).select(mark, "n").collect()
    if not hot:
        return rows.join(stats, keys)
    by_parts: dict[int, list[int]] = {}
    for value, n in hot:
        by_parts.setdefault(1 << (n * most // max(1, n_rows)).bit_length(), []).append(value)
    parts = F.lit(1)
    for k, values in sorted(by_parts.items()):
        parts = F.when(mark.isin(values), k).otherwise(parts)
    salt = F.when(mark.isin([r[0] for r in hot]), F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), parts).cast("int")).otherwise(0)
    salted = rows.withColumn("__salt", salt)
    return salted.join(stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "__salt"]).drop("__salt")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
