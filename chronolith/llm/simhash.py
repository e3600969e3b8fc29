"""SimHash near-dedup: 64-bit fingerprints of word shingles, joined by a binary trie self-join.

The fingerprints' trie is walked against itself, node pair by node pair, adding up differing bits; a pair over the error
budget is dropped with everything below it. To spread the walk over a cluster, the 64 bits are cut into blocks: with a
budget of k, fingerprints that differ in k bits agree in at least b - k of b blocks, so the join runs inside groups that
agree in some choice of b - k blocks, for every such choice. Nothing is missed.

Components need no more than one link between two already linked sets. A first pass links every fingerprint of a group
to the group's smallest; groups left with one component are done, and in the rest the trie walk also drops node pairs
that lie in one component. Large groups are walked in blocks against blocks, so that no task holds a whole hot group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_by_key, materialise, partitions_for
from .components import connected_components

BITS = 64
GROUP_ROWS = 4096  # a group is walked in blocks of about so many fingerprints
CHUNK_ROWS = 40_000  # fingerprints walked at once in a task


def fingerprint(text: str | None, size: int = 4) -> int:
    """The text's fingerprint, unsigned: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long; null and empty texts have 0."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, size) for t in b.text), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, fp long")


def trie_links(group: np.ndarray, fp: np.ndarray, label: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Label pairs (a < b) of fingerprints of one group within budget differing bits.

    All tries of the chunk are walked together, level by level; a node is a range of the sorted fingerprints, a frontier
    row is a pair of nodes of one group with the bits in which they differ so far.
    """
    order = np.lexsort((fp, group))
    group, fp, label = group[order], fp[order], label[order]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.concatenate((starts[1:], [len(group)]))
    changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    al, ah, bl, bh, err = starts, ends, starts, ends, np.zeros(len(starts), dtype=np.int8)
    found = [np.empty((0, 2), dtype=np.int64)]
    for bit in range(BITS - 1, -1, -1):
        # A pair that lies in one component needs no further link.
        same = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single & ~same], bl[single & ~same]
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            found.append(np.unique(np.sort(np.stack((label[i[ok]], label[j[ok]]), axis=1), axis=1), axis=0))
        on = ~(same | single)
        al, ah, bl, bh, err = al[on], ah[on], bl[on], bh[on], err[on]
        if not len(al):
            break
        ones = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        self_pair = al == bl
        nxt = [
            np.stack(x)
            for x in (
                (al, am, bl, bm, err),
                (am, ah, bm, bh, err),
                (al, am, bm, bh, err + 1),
                tuple(y[~self_pair] for y in (am, ah, bl, bm, err + 1)),
            )
        ]
        al, ah, bl, bh, err = np.concatenate(nxt, axis=1)
        on = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al == 1))
        al, ah, bl, bh, err = al[on], ah[on], bl[on], bh[on], err[on]
    else:  # equal fingerprints at the last level: all of them are linked
        if len(al):
            found.append(np.stack((np.minimum(label[al], label[bl]), np.maximum(label[al], label[bl])), axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _block_choices(n: int, budget: int) -> tuple[list[int], int]:
    """Bit masks, one for each choice of blocks that must agree: more blocks for more fingerprints, so that groups stay small."""
    blocks = budget + 1
    while blocks < budget + 4 and n >> (BITS * (blocks - budget) // blocks) > 1024:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(masks, blocks - budget)], blocks


def link_components(fps: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, root): for every distinct fingerprint of fps the smallest one (as a signed long) reachable over links."""
    spark = fps.sparkSession
    n = fps.count()
    masks, _ = _block_choices(n, budget)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    # First pass: to the smallest of the group.
    least = keyed.groupBy("t", "key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("top"), F.count("*").alias("n")).where("pivot < top")
    near = join_by_key(keyed, least, ["t", "key"], n * len(masks)).where((F.col("fp") != F.col("pivot")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= budget))
    first = materialise(connected_components(near.select("fp", "pivot"), "fp", "pivot"), "simhash-first")
    labelled = fps.select("fp").join(first.select(F.col("id").alias("fp"), "component"), "fp", "left")
    labelled = materialise(labelled.select("fp", F.coalesce("component", "fp").alias("label")), "simhash-labelled")
    # Second pass: the trie walk in groups that hold more than one component.
    keyed = labelled.select("fp", "label", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    mixed = keyed.groupBy("t", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    cuts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    members = join_by_key(keyed, mixed.select("t", "key", "n", cuts.alias("cuts")), ["t", "key"], n * len(masks))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    members = members.select(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "label")
    members = members.repartition(partitions_for(spark, n * len(masks), 1_000_000), "grp").sortWithinPartitions("grp")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def run(part: pd.DataFrame) -> pd.DataFrame:
            tags = part[["t", "key", "p", "q"]]
            group = pd.factorize(pd.MultiIndex.from_frame(tags))[0] if len(part) else np.empty(0, dtype=np.int64)
            a, b = trie_links(group, part.fp.to_numpy(np.int64).view(np.uint64), part.label.to_numpy(np.int64), budget)
            return pd.DataFrame({"a": a, "b": b})

        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= CHUNK_ROWS:
                part = pd.concat(held, ignore_index=True)
                last = part.grp.iloc[-1]
                done = part[part.grp != last]
                if len(done):
                    yield run(done)
                held = [part[part.grp == last]]
                rows = len(held[0])
        if held:
            yield run(pd.concat(held, ignore_index=True))

    links = members.mapInPandas(walk, "a long, b long")
    second = connected_components(links, "a", "b").select(F.col("id").alias("label"), "component")
    return labelled.join(second, "label", "left").select("fp", F.coalesce("component", "label").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = 4, size: int = 4) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows each get their row; a
    null doc_id gets a row and never names a component unless the component has no other. Other columns are ignored.
    """
    fps = materialise(fingerprints(docs, size), "simhash-fps")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    roots = materialise(link_components(reps.select("fp"), budget).join(reps, "fp"), "simhash-roots")
    classes = roots.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum(F.lit(1)).alias("k"))
    named = join_by_key(roots.select("fp", "root", F.col("n").alias("rows")), classes.withColumnRenamed("k", "n"), ["root"], roots.count())
    named = named.select("fp", "component_id", F.col("rows").alias("n"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_by_key(fps, named, ["fp"], fps.count()).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 4, size: int = 4) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (nulls last), any one if that is repeated; columns as they are.

    Null, empty and blank texts are one group; rows without a doc_id are judged by their texts like any other.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, size) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "__fp"])

    # Rows get their number when they are written, so that it holds in all that follows.
    rows = docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField("__fp", LongType())]))
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__row").alias("row"))).alias("best")
    reps = materialise(rows.groupBy(F.col("__fp").alias("fp")).agg(best), "simhash-reps")
    roots = link_components(reps.select("fp"), budget).join(reps, "fp")
    keep = roots.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    return rows.join(keep, "__row", "left_semi").select(*docs.columns)
