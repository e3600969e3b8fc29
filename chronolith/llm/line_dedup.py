"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

A line counts as its normal form: A-Z in lower case, white space runs as one space, trimmed. Blank lines are never
dropped. Of each component of lines that are linked at Jaccard >= ``threshold`` (equal lines included) the first
occurrence by (doc_id, line number) stays.

Texts are shuffled once, to fetch the lines of candidate pairs; everything before works on 64-bit values made where a
text is read. Buckets are worked off in two passes. First each line is compared with its bucket's smallest. Buckets of
three or more that still hold several components are then compared in full, in blocks of ``BLOCK`` lines against blocks,
so that a bucket of any size is spread over tasks and no link inside a bucket is lost.

A line also has a sketch: for each value among ``SKETCH``, whether an odd number of its shingles' hashes take it. Two
sketches never differ in more bits than the shingle sets do in members, so a pair whose sketches differ too much is below
the threshold for certain and is not compared in full. Pairs of very long lines are always compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise
from .components import connected_components

SHINGLE, ROWS, BANDS, THRESHOLD = 7, 3, 7, 0.8  # a pair at 0.8 shares a band with probability 0.993, at 0.85 with 0.999
BLOCK = 256
SKETCH = 512  # bits
WORDS = [f"s{i}" for i in range(SKETCH // 64)]  # a sketch's columns


def normal(line: str) -> str:
    # The only printable white space is the plain one.
    line = line.strip(" ") if line.isprintable() and "  " not in line else " ".join(line.split())
    return line.lower() if line.isascii() else line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shingles(line: str, k: int) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def members_of(line: str, k: int) -> np.ndarray | set[str]:
    """The line's shingles: for long lines of code points under 512 a sorted array of the shingles packed into 63 bits, else a set."""
    if len(line) < 200 or k > 7 or not (line.isascii() or ord(max(line)) < 512):
        return shingles(line, k)
    buf = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    packed = np.zeros(len(buf) - k + 1, dtype=np.int64)
    for j in range(k):
        packed = packed << 9 | buf[j : len(buf) - k + 1 + j]
    packed.sort()
    return packed[np.concatenate(([True], packed[1:] != packed[:-1]))]


def alike(x: np.ndarray | set[str], y: np.ndarray | set[str], threshold: float) -> bool:
    """Whether the Jaccard similarity of two lines' members reaches the threshold; sizes settle some pairs before."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    if isinstance(x, set) and isinstance(y, set):
        both = len(x & y)
    elif isinstance(x, set) or isinstance(y, set):
        x, y = (z if isinstance(z, set) else unpacked(z) for z in (x, y))
        both = len(x & y)
    else:
        z = np.sort(np.concatenate((x, y)), kind="stable")  # merges the two sorted runs
        both = int((z[1:] == z[:-1]).sum())
    return both >= threshold * (len(x) + len(y) - both) - 1e-12


def unpacked(packed: np.ndarray, k: int = SHINGLE) -> set[str]:
    return {"".join(chr(v >> 9 * j & 511) for j in range(k - 1, -1, -1)) for v in packed.tolist()}


def jaccard(a: str, b: str, k: int, threshold: float) -> bool:
    return alike(members_of(a, k), members_of(b, k), threshold)


class Members:
    """members_of() of lines by id, kept while the lines held are under ``most`` characters."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.size = most, 0
        self.known: dict[int, np.ndarray | set[str]] = {}

    def of(self, i: int, line: str) -> np.ndarray | set[str]:
        if i not in self.known:
            if self.size + len(line) > self.most:
                self.known.clear()
                self.size = 0
            self.known[i] = members_of(line, SHINGLE)
            self.size += len(line)
        return self.known[i]


def codes(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all lines' shingles (code points), each line's first one, and the lines' numbers of shingles."""
    lines = [x.ljust(k, "\0") for x in lines]
    buf = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    h = np.zeros(len(buf) - k + 1, dtype=np.uint32)
    for j in range(k):
        h = h * np.uint32(0x01000193) + buf[j : len(buf) - k + 1 + j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    inside = np.ones(len(h), dtype=bool)
    ends = np.cumsum(n)
    for j in range(1, k):  # shingles that cross into the next line
        cross = ends - j
        inside[cross[cross < len(h)]] = False
    count = n - k + 1
    return h[inside], np.cumsum(count) - count, count


def slices(lines: list[str], size: int = 65_536) -> Iterator[tuple[int, int]]:
    """Ranges of at most 4,096 lines that hold about ``size`` characters, few enough to stay in the processor's cache."""
    at = 0
    while at < len(lines):
        to, held = at, 0
        while to < len(lines) and held < size and to - at < 4096:
            held += len(lines[to])
            to += 1
        yield at, to
        at = to


def sketches(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(lines, SKETCH / 64) words of the lines' sketches, and the lines' numbers of shingles, repeats included."""
    out, sizes = np.empty((len(lines), SKETCH // 64), dtype=np.int64), np.empty(len(lines), dtype=np.int64)
    for at, to in slices(lines):
        h, _, sizes[at:to] = codes(lines[at:to], k)
        member = np.repeat(np.arange(to - at, dtype=np.int64), sizes[at:to]) << 32 | h
        member.sort()
        member = member[np.concatenate(([True], member[1:] != member[:-1]))]
        times = np.bincount((member >> 32) * SKETCH + member % SKETCH, minlength=(to - at) * SKETCH)
        out[at:to] = np.packbits((times & 1).astype(bool).reshape(-1, SKETCH), axis=1).view(np.int64)
    return out, sizes


class MinHasher:
    """Band keys of lines: ``bands`` 64-bit values a line, each from ``rows`` minima of seeded hashes over shingles."""

    def __init__(self, k: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.rows, self.bands = k, rows, bands
        self.mul = rng.integers(0, 2**32, rows * bands, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, rows * bands, dtype=np.uint32)

    def keys(self, lines: list[str]) -> np.ndarray:
        out = np.empty((len(lines), self.bands), dtype=np.int64)
        for at, to in slices(lines):
            out[at:to] = self._some(lines[at:to])
        return out

    def _some(self, lines: list[str]) -> np.ndarray:
        h, starts, _ = codes(lines, self.k)
        out = np.empty((len(lines), self.bands), dtype=np.uint64)
        for b in range(self.bands):
            key = np.full(len(lines), b + 1, dtype=np.uint64)
            for r in range(b * self.rows, (b + 1) * self.rows):
                key = (key ^ np.minimum.reduceat(h * self.mul[r] + self.add[r], starts).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, b] = key
        return out.view(np.int64)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, pos, h1, h2, k0, k1, ...): lines that are not blank, by number in their document, with hash and band keys.

    Of equal lines read together only the first by (doc_id, tag, pos) is returned; null doc_ids come first.
    """
    names = [f"k{i}" for i in range(BANDS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinHasher()

        def out(first: dict[str, tuple]) -> pd.DataFrame:
            lines = list(first)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), dtype=np.int64).reshape(-1, 2)
            frame = pd.DataFrame(hasher.keys(lines), columns=names)
            frame.insert(0, "h2", digest[:, 1])
            frame.insert(0, "h1", digest[:, 0])
            frame.insert(0, "pos", np.array([at[3] for at in first.values()], dtype=np.int64))
            frame.insert(0, "tag", np.array([at[2] for at in first.values()], dtype=np.int64))
            frame.insert(0, "doc_id", pd.array([at[1] if at[0] else None for at in first.values()], dtype="Int64"))
            return frame

        first: dict[str, tuple] = {}
        size = 0
        for b in batches:
            for doc, tag, text in zip(b.doc_id.astype("Int64"), b.tag, b.text, strict=True):
                named = doc is not pd.NA
                for i, line in enumerate(text.split("\n") if text else ()):
                    if x := normal(line):
                        at = (named, doc if named else 0, tag, i)
                        if at < first.setdefault(x, at):
                            first[x] = at
                size += len(text or "")
                if size > 8_000_000 and first:
                    yield out(first)
                    first, size = {}, 0
        if first:
            yield out(first)

    return docs.select("doc_id", "tag", "text").mapInPandas(run, "doc_id long, tag long, pos long, h1 long, h2 long, " + ", ".join(f"{n} long" for n in names))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line, size, s0, s1, ...): the normal form of each wanted (id, doc_id, tag, pos), its number of shingles and its sketch.

    Repeated rows become one before the join, by the join's own keys, so that texts are shuffled once and each id comes once.
    """
    key = [F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.col("tag")]
    per_doc = wanted.groupBy(*key).agg(F.collect_list(F.struct("pos", "id")).alias("at"))
    once = docs.where("text is not null").groupBy(*key).agg(F.min("text").alias("text"))
    joined = once.join(per_doc, ["named", "doc", "tag"]).select("text", F.col("at.pos").alias("pos"), F.col("at.id").alias("id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, lines = [], []
            for text, pos, some in zip(b.text, b.pos, b.id, strict=True):
                parts = text.split("\n") if text else []
                for p, i in zip(pos, some, strict=True):
                    if p < len(parts):
                        ids.append(i)
                        lines.append(normal(parts[p]))
            sketch, size = sketches(lines)
            yield pd.DataFrame({"id": np.array(ids, dtype=np.int64), "line": lines, "size": size} | {c: sketch[:, i] for i, c in enumerate(WORDS)})

    return joined.mapInPandas(run, "id long, line string, size long, " + ", ".join(f"{c} long" for c in WORDS))


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of candidate pairs (a, b, x, y) those whose lines x and y are similar."""
    held = Members()
    for b in batches:
        ok = [alike(held.of(i, x), held.of(j, y), THRESHOLD) for i, j, x, y in zip(b.a, b.b, b.x, b.y, strict=True)]
        yield b.loc[ok, ["a", "b"]]


def _links_of_groups(part: pd.DataFrame) -> pd.DataFrame:
    """Links between components inside each of whole groups of rows; a link that joins nothing new is left out."""
    out: list[tuple] = []
    lines, label, size, grp = part.line.tolist(), part.label.to_numpy(np.int64), part["size"].to_numpy(np.int64), part.grp.to_numpy()
    sketch = np.ascontiguousarray(part[WORDS].to_numpy(np.int64)).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    ends = [*(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(part)]
    for at, to in itertools.pairwise([0, *ends]):
        root: dict[int, int] = {}
        held = Members()

        def find(x: int, root: dict[int, int] = root) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        step = max(1, 32_768 // max(1, to - at))
        for s in range(at, to, step):
            e = min(s + step, to)
            differ = np.bitwise_count(sketch[s:e, None] ^ sketch[None, s:to]).sum(axis=2, dtype=np.int64)
            near = differ * (1 + THRESHOLD) <= (1 - THRESHOLD) * (size[s:e, None] + size[None, s:to]) + 1e-9
            near &= label[s:e, None] != label[None, s:to]
            for i, j in (np.argwhere(np.triu(near, 1)) + s).tolist():
                if (a := find(int(label[i]))) != (b := find(int(label[j]))) and alike(held.of(i, lines[i]), held.of(j, lines[j]), THRESHOLD):
                    root[max(a, b)] = min(a, b)
                    out.append((int(label[i]), int(label[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _linked_in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between components inside each block pair; rows (grp, id, label, line, ...) come sorted by grp."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if len(part := pd.concat([*held, b], ignore_index=True)):
            last = part.grp == part.grp.iloc[-1]
            held = [part[last]]
            yield _links_of_groups(part[~last])
    for part in held:
        yield _links_of_groups(part)


def tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def keepers(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, pos) of the line occurrences that stay, blank lines aside: one of each component of similar lines.

    tag is the text's 64-bit hash: rows of one doc_id and one text are one document, others are not. Null texts have no
    lines; ties go to the smallest (doc_id, tag, pos), null doc_ids first.
    """
    docs = tagged(docs)
    keys = [f"k{i}" for i in range(BANDS)]
    nodes = _occurrences(docs).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tag", "pos")).alias("at"), *[F.min(k).alias(k) for k in keys])
    nodes = materialise(nodes.select(F.col("h1").alias("id"), "at", *keys), "lines")
    bands = nodes.select("id", F.explode(F.array(*keys)).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top"), F.count("*").alias("n")).where("pivot < top")
    members = materialise(join_by_key(bands, buckets, ["key"], BANDS * nodes.count()).select("key", "id", "pivot", "n"), "lines-members")
    wanted = members.select("id").distinct().join(nodes.select("id", F.col("at.doc_id").alias("doc_id"), F.col("at.tag").alias("tag"), F.col("at.pos").alias("pos")), "id")
    texts = materialise(_texts(docs, wanted), "lines-texts")
    # First pass: to the bucket's smallest.
    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    x, y = (texts.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), *[F.col(w).alias(f"{c}_{w}") for w in WORDS]) for c in "ab")
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS), F.lit(0))
    near = differ * (1 + THRESHOLD) <= (F.col("a_size") + F.col("b_size")) * (1 - THRESHOLD) + 1e-9
    pairs = pairs.join(x, "a").join(y, "b").where(near).select("a", "b")
    x, y = texts.select(F.col("id").alias("a"), F.col("line").alias("x")), texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    first = materialise(connected_components(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(_linked, "a long, b long"), "a", "b"), "lines-first")
    # Second pass: buckets of three or more with several components, in blocks.
    label = F.coalesce("component", "id").alias("label")
    crowded = members.where("n > 2").select("key", "id")
    named = crowded.join(first, "id", "left").select("key", "id", label)
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    cuts = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = join_by_key(named, mixed, ["key"], crowded.count()).withColumn("own", F.pmod(F.xxhash64("id"), cuts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    blocks = blocks.select("id", "label", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp")).join(texts, "id")
    blocks = blocks.repartition("grp").sortWithinPartitions("grp")
    second = connected_components(blocks.select("grp", "id", "label", "line", "size", *WORDS).mapInPandas(_linked_in_blocks, "a long, b long"), "a", "b")
    second = second.select(F.col("id").alias("label"), F.col("component").alias("joined"))
    roots = nodes.select("id", "at").join(first, "id", "left").select("at", "id", label)
    linked = roots.join(second, "label", "left").select("at", F.coalesce("joined", "label").alias("root"))
    return linked.groupBy("root").agg(F.min("at").alias("at")).select("at.doc_id", "at.tag", "at.pos")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with only the lines that stay, in order, joined by line breaks; rows and columns as they are.

    A null text stays null; a text all of whose lines go becomes empty; blank lines stay where they are unless nothing
    else is left. Rows that repeat a doc_id with the same text count as one document: each keeps the same lines. Ties go
    to the smaller (doc_id, hash of the text, line number); null doc_ids come first.
    """
    stays = keepers(docs).groupBy("doc_id", "tag").agg(F.collect_list("pos").alias("pos"))
    stays = stays.select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), F.col("pos").alias("__pos"))
    joined = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__tag")), "left").drop("__doc", "__tag")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, pos in zip(b.text, b["__pos"], strict=True):
                if text:
                    keep = set(pos.tolist()) if pos is not None else set()
                    lines = [x for i, x in enumerate(text.split("\n")) if i in keep or not normal(x)]
                    text = "\n".join(lines) if keep else ""
                out.append(text)
            yield b.drop(columns="__pos").assign(text=out)

    return joined.mapInPandas(cut, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines (not blank), n_kept, kept (line numbers that stay, comma-joined).

    Null and empty texts have none. Repeated rows, null doc_ids and ties are as in dedup(); other columns are ignored.
    """
    stays = keepers(docs).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    stays = stays.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", ",").alias("kept"))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S"))).cast("long")
    counted = docs.select("doc_id", F.xxhash64("text").alias("tag"), lines.alias("n_lines"))
    out = counted.join(stays, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"), F.coalesce("kept", F.lit("")).alias("kept"))
