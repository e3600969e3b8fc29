"""Embedding near-dedup by lattice hashing: random projections decoded to points of the E8 lattice.

Each of several tables projects a unit vector to two blocks of eight dimensions, shifts and scales them, and takes the
nearest E8 point of each block; the two points name the vector's cell. A vector also enters the neighbouring cells of
its next-nearest points. Two vectors meet if the home cell of one is a cell of the other in some table; pairs that meet
are verified by cosine in double precision.

Exact copies are one node with a count. Cells are worked off in blocks of ``BLOCK`` vectors against blocks; a task gives
each vector's number of links and its local component, never the pairs. A pair that meets in several cells counts in the
first only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise
from .components import connected_components

SCALE, SEED = 0.5, 20
HOME, NEXT = 0.273, 0.233  # how often one block of a pair at cosine 0.9 has the same point at that scale, and how often only one's point is the other's next
CHANCE = 0.009  # how often one block of a random pair meets at that scale, neighbours included
RANDOM_IN_CELL = 8  # unrelated vectors that a cell may hold on average
RECALL = 0.96  # of pairs at the threshold
BLOCK = 384
SMALL = 48  # cells up to this size are compared many at once


def nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points with integer coordinates of even sum, and the next one found by the other rounding choice."""
    r = np.rint(x)
    gap = x - r
    order = np.argsort(-np.abs(gap), axis=1)
    rows, step = np.arange(len(x)), np.where(gap >= 0, 1.0, -1.0)
    odd = (r.sum(axis=1) % 2) != 0
    best, other = r.copy(), r.copy()
    w0, w1 = order[:, 0], order[:, 1]
    best[rows[odd], w0[odd]] += step[rows[odd], w0[odd]]
    other[rows[odd], w1[odd]] += step[rows[odd], w1[odd]]
    even = ~odd
    for w in (w0, w1):
        other[rows[even], w[even]] += step[rows[even], w[even]]
    return best, other


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled coordinates of the nearest E8 point and of the nearest other candidate, by row."""
    found = np.stack([*nearest_d8(x), *(y + 0.5 for y in nearest_d8(x - 0.5))])
    order = np.argsort(((found - x) ** 2).sum(axis=2), axis=0, kind="stable")
    rows = np.arange(len(x))
    return (2 * found[order[0], rows]).astype(np.int64), (2 * found[order[1], rows]).astype(np.int64)


def tables_for(blocks: int) -> int:
    """Tables that keep the recall: a pair meets in one if all of its blocks have the same point, or all but one, which is the next point of one of the two."""
    meet = HOME**blocks + blocks * HOME ** (blocks - 1) * NEXT
    return math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def shape_for(n: int) -> tuple[int, int]:
    """(blocks a cell, tables) for n vectors: more blocks keep cells small, and more tables keep the recall."""
    blocks = 2
    while n * CHANCE**blocks > RANDOM_IN_CELL:
        blocks += 1
    return blocks, tables_for(blocks)


class Cells:
    """Home cell and neighbouring cells of unit vectors in each table, as 64-bit numbers.

    Vectors and projections are rounded to fixed point and multiplied as integers, so that a vector has the same cells
    wherever and with whichever others they are worked out.
    """

    def __init__(self, dim: int, blocks: int, tables: int, scale: float = SCALE, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.blocks, self.tables = blocks, tables
        self.project = np.rint(rng.standard_normal((tables * blocks, dim, 8)) * scale * 2**16).astype(np.int64)
        self.shift = rng.random((tables * blocks, 8))
        self.mix = rng.integers(1, 2**62, (tables * blocks, 8), dtype=np.int64) | 1

    def of(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + blocks): home first, then the cells where one block has its next point."""
        fixed = np.rint(unit * 2**24).astype(np.int64)
        out = np.empty((len(unit), self.tables, 1 + self.blocks), dtype=np.int64)
        for t in range(self.tables):
            near, other = [], []
            for b in range(t * self.blocks, (t + 1) * self.blocks):
                p, q = decode_e8((fixed @ self.project[b]) / 2.0**40 + self.shift[b])
                near.append((p * self.mix[b]).sum(axis=1))
                other.append((q * self.mix[b]).sum(axis=1))
            home = sum(near)
            out[:, t, 0] = home
            for b in range(self.blocks):
                out[:, t, 1 + b] = home - near[b] + other[b]
        return out


def unit_rows(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of equally long lists, and which rows may link at all."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    ok = np.isfinite(x).all(axis=1)
    top = np.where(ok, np.abs(np.where(np.isfinite(x), x, 0)).max(axis=1), 0)
    ok &= top > 0
    x = np.where(ok[:, None], x, 0) / np.where(ok, top, 1)[:, None]  # scaled first: squares neither overflow nor vanish
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], ok


def _local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j inside each of many small groups."""
    a, b = [], []
    for n in np.unique(sizes):
        if n > 1:
            x, y = np.triu_indices(n, 1)
            s = starts[sizes == n][:, None]
            a.append((s + x).ravel())
            b.append((s + y).ravel())
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verify(part: pd.DataFrame, threshold: float, cells_of: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """(id, n, root): links that count here, by vector, and the vector's local component, for whole groups of rows."""
    part = part.drop_duplicates(["grp", "id"], ignore_index=True) if len(part) else part
    grp = part.grp.to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1]))) if len(grp) else np.empty(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(grp)))
    unit = unit_rows(part.e)[0] if len(part) else np.empty((0, 1))
    t, cell, blk, p, q = (part[c].to_numpy() for c in ("t", "cell", "own", "p", "q"))
    small = sizes <= SMALL
    i, j = _pairs(sizes[small], starts[small])
    ok = np.empty(0, dtype=bool)
    if len(i):
        ok = np.concatenate([np.einsum("ij,ij->i", unit[i[s : s + 200_000]], unit[j[s : s + 200_000]]) >= threshold for s in range(0, len(i), 200_000)])
    found = [(i[ok], j[ok])]
    for s, n in zip(starts[~small], sizes[~small], strict=True):
        u = unit[s : s + n]
        x, y = np.nonzero(np.triu(np.einsum("ik,jk->ij", u, u, optimize=True) >= threshold, 1))
        found.append((x + s, y + s))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    on = (p[i] == q[i]) | (blk[i] != blk[j])  # pairs inside a block belong to the block's own group
    i, j = i[on], j[on]
    linked = np.unique(np.concatenate((i, j)))
    cells = cells_of(unit[linked]) if len(linked) else np.empty((0, 1, 1), dtype=np.int64)
    gi, gj, i, j = i, j, np.searchsorted(linked, i), np.searchsorted(linked, j)
    t, cell = t[linked], cell[linked]
    first = np.ones(len(i), dtype=bool)
    home = lambda k, tt: cells[k, tt, 0]
    for tt in range(cells.shape[1]):  # a pair counts in the first table in which one's home is a cell of the other
        meets = (cells[j, tt, :] == home(i, tt)[:, None]).any(axis=1) | (cells[i, tt, :] == home(j, tt)[:, None]).any(axis=1)
        first &= ~(meets & (tt < t[i]))
    hi, hj = home(i, t[i]), home(j, t[j])
    # Pairs that meet only as visitors of a third vector's home are left out: whether two vectors are linked depends on them alone.
    here = (hi == cell[i]) | (hj == cell[i])  # and counted in the smaller of the two homes, if both are open to it
    via_i, via_j = (cells[j, t[i], :] == hi[:, None]).any(axis=1), (cells[i, t[i], :] == hj[:, None]).any(axis=1)
    place = np.where(via_i & via_j, np.minimum(hi, hj), np.where(via_i, hi, hj))
    count = first & here & (place == cell[i])
    mult = part.n.to_numpy()
    links = np.bincount(gi[count], mult[gj[count]], len(part)) + np.bincount(gj[count], mult[gi[count]], len(part))
    ids = part.id.to_numpy()
    root = ids[_local_components(len(part), gi[here], gj[here])] if here.any() else ids
    out = pd.DataFrame({"id": ids, "n": links.astype(np.int64), "root": root})
    return out[(out.n > 0) | (out.root != out.id)]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest vec_id reachable, itself included), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors link only
    with vectors of their length. Repeated rows are vectors like any other: each gets its row and counts as a link.
    Components are named and joined by vec_id, so that rows that repeat a vec_id are one node of the graph. A null vec_id
    gets a row without links. Scale and tables are set for a threshold of 0.9 or more.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    whole = F.coalesce(F.exists("e", lambda x: x != 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    good = rows.where(whole & F.col("vec_id").isNotNull())
    nodes = materialise(good.groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "lattice-nodes")
    blocks, tables = shape_for(nodes.count())
    made: dict[int, Cells] = {}

    def cells_of(unit: np.ndarray) -> np.ndarray:
        dim = unit.shape[1]
        if dim not in made:
            made[dim] = Cells(dim, blocks, tables, scale, seed)
        return made[dim].of(unit)

    def hash_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(b.e.map(len)):
                unit, ok = unit_rows(g.e)
                cells = cells_of(unit)
                yield pd.DataFrame({"id": g.id.to_numpy()[ok], "cells": list(cells.reshape(len(g), -1)[ok])})

    narrow = nodes.select("id", "e").mapInPandas(hash_cells, "id long, cells array<long>").join(nodes.select("id", F.size("e").alias("dim")), "id")
    narrow = narrow.select("id", "dim", F.posexplode("cells").alias("at", "cell"))
    narrow = materialise(narrow.select("id", "dim", "cell", F.floor(F.col("at") / (1 + blocks)).cast("int").alias("t"), (F.col("at") % (1 + blocks) == 0).cast("int").alias("home")), "lattice-cells")
    shared = narrow.groupBy("dim", "t", "cell").agg(F.count("*").alias("k"), F.max("home").alias("homes"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("homes = 1 and lo < hi")
    cuts = F.ceil(F.col("k") / BLOCK).cast("int")
    shared = shared.select("dim", "t", "cell", F.col("k").alias("n"), cuts.alias("cuts"))
    members = join_by_key(narrow, shared, ["dim", "t", "cell"], narrow.count()).drop("n")
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    members = members.select("id", "dim", "t", "cell", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    members = members.withColumn("grp", F.xxhash64("dim", "t", "cell", "p", "q"))
    members = members.join(nodes, "id").select("grp", "id", "n", "t", "cell", "own", "p", "q", "e")
    members = members.repartition("grp").sortWithinPartitions("grp")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for s in range(0, len(b), 4000):
                part = pd.concat([*held, b.iloc[s : s + 4000]], ignore_index=True)
                last = part.grp.iloc[-1]
                done, held = part[part.grp != last].reset_index(drop=True), [part[part.grp == last]]
                for _, g in done.groupby(done.e.map(len)):
                    yield _verify(g.reset_index(drop=True), threshold, cells_of)
        for part in held:
            if len(part):
                yield _verify(part.reset_index(drop=True), threshold, cells_of)

    found = materialise(members.mapInPandas(verify, "id long, n long, root long"), "lattice-links")
    roots = connected_components(found.select("id", "root"), "id", "root")
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    out = nodes.join(links, "id", "left").join(roots, "id", "left")
    out = out.select("e", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = join_by_key(good, out, ["e"], good.count(), 1000).select("vec_id", "n_links", "component_id")
    rest = rows.where(~whole | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
