"""Sequence packing by best-fit decreasing over a segment tree indexed by remaining capacity.

A document's tokens and one end token are cut into full windows of ``window`` tokens and a rest. Full windows are
sequences of their own. Rests are packed longest first, each into the open window with the least room that still holds
it; the tree over capacities 0..window finds that window in log2(window) steps.

Tokenisation and packing run in one task per slice of the documents: a slice's sequences are numbered within it, so no
rest has to be shuffled, and a slice of some thousands of documents loses under one percent to padding.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SLICE_ROWS = 65_536  # documents packed together at most, so that a task's memory is bounded
# How the vocabulary's byte-level pre-tokenizer splits texts of characters below U+0180, letters and numbers spelled out (fixed values).
_LETTER = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_NUMBER = r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = r"\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
BEYOND = re.compile(r"[^\x00-\x1b\x20-\u017f]")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest follows from 256 on in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in kept else next(rest)) for b in range(256)}


class Known(dict):
    """Ids of pre-tokens as little-endian 32-bit bytes; BPE never merges over a pre-token, so each is worked out once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)  # the model refers to it
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(letters)]
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Token ids of whole texts, as the tokenizer gives them without adding special tokens.

    Texts of characters below U+0180 are split here, and each distinct pre-token goes through the BPE model once. Texts
    with other characters, or with the string of a token added to the vocabulary, are the tokenizer's own whole.
    """

    MOST = 600_000

    def __init__(self, path: str):
        self.known = Known(path)
        added = [re.escape(t.content) for t in self.known.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([BEYOND.pattern, *added]))

    def encode(self, text: str) -> bytes:
        if self.other.search(text):
            return np.array(self.known.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.known) > self.MOST:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, LATIN.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class CapacityTree:
    """Open windows by remaining capacity: a segment tree of counts over 0..window, with a stack of windows at each leaf."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window_id: int) -> None:
        self.open[room].append(window_id)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (room, window) with the least room >= need, removed; None if there is none."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # climb to the first right sibling that has windows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window number, offset) of each length, and how many windows were opened. Ties go in the order given."""
    tree, used = CapacityTree(window), 0
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room, w = tree.take(need) or (window, used)
        used += w == used
        where[i], offset[i] = w, window - room
        if room > need:
            tree.add(room - need, w)
    return where, offset, used


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, slice_rows: int = SLICE_ROWS, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every id of every document is in exactly one piece; a sequence's pieces fill it from offset 0 without gaps. A null or
    empty text is its end token alone. Repeated rows are packed each for itself. Other columns are ignored. sequence_id
    is the partition's number times 2^40 plus a running number: unique, not dense, the same when a task is run again.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        enc = encoder(tokenizer_path)
        rests: list[tuple] = []

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            return out.assign(doc_id=out.doc_id.astype("Int64"))

        def flush(at: int) -> tuple[pd.DataFrame, int]:
            where, offset, n = best_fit_decreasing(np.array([r[2] for r in rests], dtype=np.int64), window)
            rows = [(*r[:5], base + at + w, o, *r[5:]) for r, w, o in zip(rests, where.tolist(), offset.tolist(), strict=True)]
            rests.clear()
            return frame(rows), at + n

        at = 0
        for b in batches:
            rows = []
            for doc, text in zip(b.doc_id, b.text, strict=True):
                ids = enc.encode(text or "") + tail
                n = len(ids) // 4
                for s in range(0, n, window):
                    piece = ids[4 * s : 4 * (s + window)]
                    row = (doc, s, len(piece) // 4, zlib.crc32(piece), n)
                    more = (np.frombuffer(piece, dtype="<i4"),) if with_ids else ()
                    if row[2] == window:
                        rows.append((*row, base + at, 0, *more))
                        at += 1
                    else:
                        rests.append((*row, *more))
            if rows:
                yield frame(rows)
            if len(rests) >= slice_rows:
                out, at = flush(at)
                yield out
        if rests:
            yield flush(at)[0]

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def padding(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """tokens, sequences, padded tokens and the share of padding; a sequence whose length is a power of two is not padded."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(window - F.col("n"))
    total = used.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum(pad).alias("padded"))
    return total.withColumn("share", F.col("padded") / (F.col("tokens") + F.col("padded")))
