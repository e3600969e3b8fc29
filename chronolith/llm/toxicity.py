"""Toxicity scores by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text, their first 4, 5 and 6 letters, and words read through digits and
signs written for letters. The score is a logistic function of w0, the terms' weights, and the inner products of the
terms' factor vectors for every pair of terms, which catch combinations (an insult with a group) that a sum misses.

The model is fitted to about ``PER_CLASS`` labelled texts of each class, chosen by hash of doc_id. Their terms are worked
out and counted on the executors; the driver gets the ``TERMS`` terms that the chi-square statistic tells apart best and,
for each text, which of these it has. Every text is then scored in full.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .langid import fold

PER_CLASS = 6000  # labelled texts fitted, a class
TERMS = 20_000  # terms of the model
CHI2 = 12.0  # least chi-square of a term
FACTORS = 8
EPOCHS = 30
WORDS = re.compile(r"[^\W_](?:[^\W_]|[@$!*'](?=[^\W_]))*")
PLAIN = str.maketrans("013457@$!*'", "oieastasi  ")


def terms_of(word: str) -> set[int]:
    """32-bit hashes of the terms of a lower-case word."""
    plain = word.translate(PLAIN).replace(" ", "") if not word.isalpha() else word
    names = {f"w{word}", f"w{plain}"} | {f"p{plain[:k]}" for k in (4, 5, 6) if len(plain) >= k}
    return {zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names}


class Machine:
    """w0, and by term hash: weight and factors. One row of zeros stands for unknown terms."""

    MOST = 500_000

    def __init__(self, number: dict[int, int], w0: float, w: np.ndarray, v: np.ndarray):
        self.number, self.w0, self.w, self.v = number, w0, w, v
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def rows(self, text: str | None) -> list[int]:
        """Row numbers of the model's terms in a text, each once."""
        out: set[int] = set()
        known = self.known
        for word in set(WORDS.findall(text.lower())) if text else ():
            found = known.get(word)
            if found is None:
                if len(known) > self.MOST:
                    known.clear()
                found = known[word] = tuple(self.number[h] for h in terms_of(word) if h in self.number)
            if found:
                out.update(found)
        return sorted(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = [self.rows(t) for t in texts]
        n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(n.sum()))
        return 1 / (1 + np.exp(-np.clip(margins(flat, n, self.w0, self.w, self.v)[0], -30, 30)))


def margins(flat: np.ndarray, n: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """w0 + sum w + 1/2 sum over factors of ((sum v)^2 - sum v^2), and the sums of v, by text."""
    owner = np.repeat(np.arange(len(n)), n)
    s = np.stack([np.bincount(owner, v[flat, f], len(n)) for f in range(v.shape[1])], axis=1)
    sq = np.bincount(owner, (v[flat] ** 2).sum(axis=1), len(n))
    return w0 + np.bincount(owner, w[flat], len(n)) + 0.5 * ((s**2).sum(axis=1) - sq), s


def all_terms(text: str | None) -> list[int]:
    """The terms of a whole text, each once, in order."""
    return sorted({h for word in set(WORDS.findall(text.lower())) for h in terms_of(word)}) if text else []


def chi_square(both: Column, one: Column, n1: int, n0: int) -> Column:
    """Chi-square with Yates' correction of a term that ``both`` texts hold, ``one`` of them of class 1."""
    zero, n = both - one, n1 + n0
    gap = F.greatest(F.lit(0.0), F.abs(one * (n0 - zero) - zero * (n1 - one)) - n / 2)
    return n * gap * gap / (both * (n - both) * max(1, n1) * max(1, n0))


def fit(rows: list[tuple[list[int], int]], terms: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 5) -> Machine:
    """A machine over terms from (numbers of the terms held, label) rows by mini-batch steps with per-weight step sizes; weights: of labels 0 and 1."""
    rows = sorted(rows)
    labels = np.array([y for _, y in rows], dtype=np.int64)
    weight = np.where(labels == 1, weights[1], weights[0])
    weight = weight / weight.mean() if len(rows) else weight
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS))
    base = float((weight * labels).sum() / weight.sum()) if len(rows) else 0.0
    w0 = float(np.log(max(base, 1e-4) / max(1 - base, 1e-4)))
    machine = Machine({h: i for i, h in enumerate(terms)}, w0, w, v)
    each = [np.array(x, dtype=np.int32) for x, _ in rows]
    gw, gv, g0 = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    for _ in range(EPOCHS if terms else 0):
        for ids in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512)):
            n = np.array([len(each[i]) for i in ids])
            flat, owner = np.concatenate([each[i] for i in ids]), np.repeat(np.arange(len(ids)), n)
            m, s = margins(flat, n, machine.w0, w, v)
            err = weight[ids] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[ids]) / len(ids)
            dw = np.bincount(flat, err[owner], len(w)) + 1e-5 * w
            dv = np.stack([np.bincount(flat, err[owner] * (s[owner, f] - v[flat, f]), len(w)) for f in range(FACTORS)], axis=1) + 1e-4 * v
            gw += dw * dw
            gv += dv * dv
            g0 += err.sum() ** 2
            w -= 0.1 * dw / np.sqrt(gw)
            v -= 0.02 * dv / np.sqrt(gv)
            machine.w0 -= 0.05 * err.sum() / np.sqrt(g0)
    return machine


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_terms: int = TERMS) -> Machine:
    """A machine fitted to about per_class labelled distinct texts of each class from folds other than 2.

    The labelled ids are sampled before the join, so that what is broadcast is bounded by per_class; where a doc_id has
    many texts, these are sampled again. A doc_id labelled twice counts as toxic if any label is 1.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id") != 2)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not n:
        return fit([], [])

    def share(counts: dict, *names: str) -> Column:
        place = F.pmod(F.xxhash64(*names), F.lit(1 << 20)) / float(1 << 20)
        return place < F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, counts.get(1, 1)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 1))))

    some = rows.where(share(n, "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * per_class)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").dropDuplicates()

    def terms_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(terms=[all_terms(t) for t in b.text])[["doc_id", "at", "toxic", "terms"]]

    held = texts.withColumn("at", F.xxhash64("text")).mapInPandas(terms_in, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, toxic int, terms array<long>")
    held = materialise(held, "toxicity-terms")
    k = {r[0]: r[1] for r in held.groupBy("toxic").count().collect()}
    if max(k.values(), default=0) > 2 * per_class:  # few doc_ids with many texts
        held = materialise(held.where(share(k, "at", "doc_id")), "toxicity-terms")
        k = {r[0]: r[1] for r in held.groupBy("toxic").count().collect()}
    n1, n0 = k.get(1, 0), k.get(0, 0)
    seen = held.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("both"), F.sum("toxic").cast("double").alias("one"))
    seen = seen.where((F.col("both") >= 5) & (F.col("both") <= n1 + n0 - 5)).withColumn("chi", chi_square(F.col("both"), F.col("one"), n1, n0))
    terms = [r[0] for r in seen.where(F.col("chi") >= CHI2).orderBy(F.desc("chi"), "term").limit(most_terms).select("term").collect()]
    shared = docs.sparkSession.sparkContext.broadcast({h: i for i, h in enumerate(terms)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            number = shared.value
            yield pd.DataFrame({"toxic": b.toxic, "terms": [sorted(number[h] for h in t if h in number) for t in b.terms]})

    got = [(r.terms, r.toxic) for r in held.mapInPandas(numbered, "toxic int, terms array<int>").collect()]
    return fit(got, terms, (n.get(0, 0) / max(1, n0), n.get(1, 0) / max(1, n1)))


def predict(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Null and empty texts have the score of no terms."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.scores(b.text.tolist())
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "held_out": b.held_out, "score": s, "predicted": (s >= threshold).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 2).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """predict() with a machine fitted to the labels; without any label every score is near zero.

    Repeated rows each get a row, and a null doc_id gets one; other columns are ignored.
    """
    return predict(docs, train(docs, labels))
