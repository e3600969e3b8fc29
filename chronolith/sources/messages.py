"""Message rows: JSON and CSV bodies, and routing to partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def from_json(body: Column, schema: str) -> Column:
    return F.from_json(body, schema)


def to_csv(*columns: str, sep: str = ",") -> Column:
    return F.to_csv(F.struct(*columns), {"sep": sep})


def from_csv(body: Column, schema: str, sep: str = ",") -> Column:
    return F.from_csv(body, schema, {"sep": sep})


def djb2(key: Column) -> Column:
    """5381, then times 33 plus each byte of the key's UTF-8 form, modulo 2^64, as decimal(20)."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.hex(F.substring(F.encode(key, "UTF-8"), i, F.lit(1))), 16, 10).cast("decimal(20,0)"))
    codes = F.when(F.octet_length(key) > 0, codes).otherwise(F.array().cast("array<decimal(20,0)>"))
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.aggregate(codes, F.lit(5381).cast("decimal(20,0)"), lambda h, b: ((h * F.lit(33).cast("decimal(2,0)") + b) % two64).cast("decimal(20,0)"))


def route_hash(key: Column, n: int) -> Column:
    return (djb2(key) % n).cast("int")


def route_time(ts: Column, n: int) -> Column:
    return F.hour(ts) % n


# A message as Kafka's source gives it and its sink takes it (fixed names).
MESSAGE = "key binary, value binary, headers array<struct<key:string,value:binary>>, topic string, partition int, offset bigint, timestamp timestamp"


def size_bytes() -> Column:
    """Bytes of a message's key and value."""
    return F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))


CODECS = {"json": (to_json, from_json), "csv": (to_csv, from_csv)}


def codec(name: str):
    """(encode, decode) by name."""
    if name not in CODECS:
        raise ValueError(f"no codec {name!r}")
    return CODECS[name]


def route(strategy: str, n: int, key: Column | None = None, ts: Column | None = None, seed: int = 42) -> Column:
    """A partition 0..n-1 by strategy: hash and range by the key (a null key goes to 0), time by the hour, round_robin by
    position in the task's rows, random by a seeded draw."""
    if strategy in ("hash", "range"):
        return F.when(key.isNull(), 0).otherwise(route_hash(key, n))
    if strategy == "time":
        return route_time(ts, n)
    if strategy == "round_robin":
        return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    if strategy == "random":
        return F.floor(F.rand(seed) * n).cast("int")
    raise ValueError(f"no strategy {strategy!r}")
