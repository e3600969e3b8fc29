"""Benchmark decontamination: n-gram windows of the test items, looked up in every training text.

Words are runs of digits, letters and all non-ASCII characters after lower-casing A-Z. A window is 13 consecutive words
of an item (an item of fewer words is one window). A document word inside any occurrence of a window is hit.

The windows are broadcast as a hash set while the benchmark has at most ``MOST_WORDS`` words, and so no more windows,
about 100 bytes each; beyond that, window hashes of the documents are joined with window hashes of the benchmark by a
shuffle and give the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MOST_WORDS = 300_000  # words of a benchmark that is broadcast
SALTS = 16  # parts of a window that very many texts hold, in the shuffle join


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes: in UTF-8 every byte of a non-ASCII character is 0x80 or more."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows_of(words: list[bytes], n: int) -> list[tuple]:
    if len(words) < n:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


class WindowSet:
    """Windows of the items as rows of word numbers, by length: sorted hashes, the rows, and each row's items."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [str(item) for item, _ in items]
        rows, owner = defaultdict(list), defaultdict(list)
        for i, (_, text) in enumerate(items):
            words = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], dtype=np.int32)
            if len(words):
                k = min(n, len(words))
                rows[k].append(np.lib.stride_tricks.sliding_window_view(words, k))
                owner[k].append(np.full(len(words) - k + 1, i, dtype=np.int32))
        self.by_len: dict[int, tuple] = {}
        for k in rows:
            r, o = np.concatenate(rows[k]), np.concatenate(owner[k])
            h = self.hash(r, k)
            order = np.lexsort((o, *r.T[::-1], h))
            r, o, h = r[order], o[order], h[order]
            new = np.concatenate(([True], (r[1:] != r[:-1]).any(axis=1)))
            once = new | np.concatenate(([True], o[1:] != o[:-1]))  # an item that repeats a window has it once
            starts = np.append(np.cumsum(once)[new] - 1, once.sum())
            self.by_len[k] = h[new], r[new], starts, o[once]

    @staticmethod
    def hash(rows: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(rows), dtype=np.uint64)
        for j in range(k):
            h = h * MULTIPLIER + rows[:, j].astype(np.uint64)
        return h

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """A mark for each word that is hit, and the items found."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        hit, found = np.zeros(len(ids) + 1, dtype=np.int64), set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for k, (hashes, rows, starts, owners) in self.by_len.items():
            at = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.empty(0, dtype=np.int64)
            if not len(at):
                continue
            h = self.hash(ids[at[:, None] + np.arange(k)], k)
            place = np.searchsorted(hashes, h)
            for i in np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == h):
                g, window = place[i], ids[at[i] : at[i] + k]
                while g < len(hashes) and hashes[g] == h[i]:  # equal hashes are compared word by word
                    if (rows[g] == window).all():
                        found.update(self.names[o] for o in owners[starts[g] : starts[g + 1]])
                        hit[at[i]] += 1
                        hit[at[i] + k] -= 1
                        break
                    g += 1
        return np.cumsum(hit[:-1]) > 0, found


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def report(docs: DataFrame, bench: DataFrame, n: int = 13, share: int = 20, most_words: int = MOST_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. A null or wordless text gives zeros and false; repeated rows
    each get their row; other columns of docs and bench are ignored; an empty benchmark gives no hits. Items with a
    null or wordless text have no window; a null item_id counts as the string None.
    """
    docs, bench = docs.select("doc_id", "text"), bench.select("item_id", "text")
    if not _fits(bench, most_words):
        return _report_by_join(docs, bench, n, share)
    windows = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in bench.collect()], n))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = windows.value
        for b in batches:
            rows = []
            for doc, text in zip(b.doc_id, b.text, strict=True):
                words = words_of(text)
                hit, found = known.match(words)
                h = int(hit.sum())
                rows.append((doc, len(words), h, len(found), _digest(found), h > 0 and share * h >= len(words)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return docs.mapInPandas(scan, REPORT)


def _fits(bench: DataFrame, most_words: int) -> bool:
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return bench.agg(F.coalesce(F.sum(words), F.lit(0)) + F.count("*")).first()[0] <= most_words


def _found_by_join(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """docs with ``spans`` (at, k) of the windows in their text and ``items`` (as strings), both null where there is none.

    A shuffle join on 128-bit window hashes, for a benchmark too large to broadcast. Equal texts are looked up once; each
    window's texts are dealt to SALTS parts, so that one that a third of all texts hold is no single task's.
    """

    def windows(batches: Iterator[pd.DataFrame], lengths: list[int] | None) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b.key, b.text, strict=True):
                words = words_of(text)
                ks = [n if len(words) >= n else len(words)] if lengths is None else lengths
                rows = [(key, i, k, hashlib.md5(b" ".join(words[i : i + k])).digest()) for k in ks if k for i in range(len(words) - k + 1)]
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "at", "k", "h"])

    schema = "key string, at long, k long, h binary"
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("key"), "text")
    items = items.mapInPandas(lambda b: windows(b, None), schema).select(F.col("key").alias("item"), "h", "k").distinct()
    lengths = [r[0] for r in items.select("k").distinct().collect()]  # at most n values
    keyed = docs.withColumn("__key", F.sha2("text", 256))
    texts = keyed.select(F.col("__key").alias("key"), "text").where("text is not null").dropDuplicates(["key"])
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = texts.mapInPandas(lambda b: windows(b, lengths), schema).withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int"))
    found = spans.join(items, ["h", "k", "salt"]).groupBy(F.col("key").alias("__key"))
    found = found.agg(F.collect_set(F.struct("at", "k")).alias("__spans"), F.collect_set("item").alias("__items"))
    return keyed.join(found, "__key", "left").drop("__key")


def _marks(n_words: int, spans) -> np.ndarray:
    hit = np.zeros(n_words + 1, dtype=np.int64)
    for x in spans if spans is not None else ():
        hit[x["at"]] += 1
        hit[x["at"] + x["k"]] -= 1
    return np.cumsum(hit[:-1]) > 0


def _report_by_join(docs: DataFrame, bench: DataFrame, n: int, share: int) -> DataFrame:
    """As report(), for a benchmark too large to broadcast."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, spans, items in zip(b.doc_id, b.text, b["__spans"], b["__items"], strict=True):
                total = len(words_of(text))
                h, got = int(_marks(total, spans).sum()), set(items) if items is not None else set()
                rows.append((doc, total, h, len(got), _digest(got), h > 0 and share * h >= total))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return _found_by_join(docs, bench, n).mapInPandas(finish, REPORT)


def _without(text: str, hit: np.ndarray) -> str:
    """The text with its marked words cut out."""
    raw, last, parts = text.encode("utf-8", "surrogatepass"), 0, []
    for m, bad in zip(WORD.finditer(raw.lower()), hit, strict=True):
        if bad:
            parts.append(raw[last : m.start()])
            last = m.end()
    return b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, bench: DataFrame, mode: str = "documents", n: int = 13, share: int = 20, most_words: int = MOST_WORDS) -> DataFrame:
    """docs without contaminated documents, or (mode="spans") with the hit words of contaminated documents cut out.

    The columns of docs stay as they are. Each row is decided by its own text, whatever its doc_id, null ones and repeated
    rows included; null and wordless texts stay. An empty benchmark takes nothing away.
    """
    bench = bench.select("item_id", "text")
    fits = _fits(bench, most_words)
    windows = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in bench.collect()], n)) if fits else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b.text, b["__spans"] if windows is None else [None] * len(b), strict=True):
                words = words_of(text)
                hit = _marks(len(words), spans) if windows is None else windows.value.match(words)[0]
                out.append(_without(text, hit) if hit.any() and share * int(hit.sum()) >= len(hit) else text)
            yield b.drop(columns=["__spans", "__items"], errors="ignore").assign(text=out)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = []
            for text, spans in zip(b.column("text").to_pylist(), [None] * b.num_rows if fits else b.column("__spans").to_pylist(), strict=True):
                words = words_of(text)
                hit = _marks(len(words), spans) if windows is None else windows.value.match(words)[0]
                stays.append(not (hit.any() and share * int(hit.sum()) >= len(hit)))
            yield b.filter(pa.array(stays, pa.bool_())).select(names)

    names, found = docs.columns, docs if fits else _found_by_join(docs, bench, n)
    if mode == "documents":
        return found.mapInArrow(clean, docs.schema)
    return found.mapInPandas(cut, docs.schema)
