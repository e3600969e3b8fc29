"""Connected components of an edge table by alternating star contractions (a distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    moved = join_by_key(both.where("v > u"), least, ["u"], 2 * n)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_by_key(edges, least, ["u"], n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and those on none: then each component hangs on its smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id that has a link; component is the smallest id reachable.

    links: two columns a, b of one orderable integer type; self links and repeats are allowed, null ends are ignored.
    Only aggregates by a node's key and equi-joins are used, of which the first combine a hot node's rows and the others
    split off the few hottest nodes; each
    round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialise(edges.select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    while not _stars(edges):
        n = edges.count()  # a star has no more edges than there were
        edges = materialise(_small_star(_large_star(edges, n), n), "edges")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
