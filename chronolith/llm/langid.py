"""Language identification by a linear-chain conditional random field over words.

A text's words form chains: a chain ends at a line break, at . ! or ?, or after ``CHAIN`` words. A word's label is its
language. Features of a word are its affixes, its character n-grams and its place in each language's lexicon; between
words there are learned transitions. Forward-backward gives each word's label probabilities given its chain, so that
words of code-switched text follow their surroundings; a text's language is the one with the most of its words'
probability.

The model is fitted on the driver to a sample that does not grow with the corpus: about ``PER_LANGUAGE`` distinct texts
a language, chosen by hash, are cut into chains on the executors, and about ``CHAINS`` of all their chains, again chosen
by hash wherever in a text they lie, are fitted. Every text is then labelled in full.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

PER_LANGUAGE = 500  # texts sampled for the fit, a language
CHAINS = 20_000  # chains fitted, all languages together
LANGUAGES = 500  # languages learned: those with the most labelled texts
LEXICON = 2000  # words of a language's lexicon
BITS = 16  # hashed features
CHAIN = 200
ROUNDS = 60
LETTERS = 24  # a longer run of letters is several words of a chain
WORDS = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}|[.!?\n]")
ENDS = {".", "!", "?", "\n"}


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Feature numbers of a lower-case word: hashed affixes and n-grams, then the lexicon's own."""
    w = f"^{word}$"
    names = [f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3))]
    names += [w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)]
    crc, mask = zlib.crc32, (1 << BITS) - 1
    out = [crc(x.encode("utf-8", "surrogatepass")) & mask for x in names]
    known = lexicon.get(word, 0)
    return out + [(1 << BITS) + i for i in range(known.bit_length()) if known >> i & 1]


def chains_of(tokens: list[str]) -> tuple[list[str], list[int]]:
    """Words, and the lengths of the chains that they form in order; digits that are no decimals, such as a superscript two, are no words."""
    words, lengths, n = [], [], 0
    for t in tokens:
        if t in ENDS:
            if n:
                lengths.append(n)
                n = 0
        elif t.isalpha() or any(map(str.isalpha, t)):
            words.append(t)
            n += 1
            if n == CHAIN:
                lengths.append(n)
                n = 0
    if n:
        lengths.append(n)
    return words, lengths


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, want_pairs: bool = False):
    """Label probabilities of every word (words, labels), the log partition sum, and expected transitions if asked.

    emit, move: log scores. Chains are worked off side by side, longest first, one step for all that are long enough.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    top = emit.max(axis=1, keepdims=True)
    e, m = np.exp(emit - top), np.exp(move)
    alpha, scale = np.empty_like(e), np.empty(len(e))
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    for t in range(steps):
        at = starts[: active[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ m) * e[at]
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
    gamma, beta = np.empty_like(e), np.ones_like(e)
    pairs = np.zeros_like(m)
    for t in range(steps - 1, -1, -1):
        k = active[t + 1] if t + 1 < steps else 0
        at = starts[:k] + t
        if k:
            nxt = (e[at + 1] * beta[at + 1]) / scale[at + 1][:, None]
            beta[at] = nxt @ m.T
            if want_pairs:
                pairs += m * (alpha[at].T @ nxt)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma, float(np.log(scale).sum() + top.sum()), pairs


class Model:
    """languages, lexicon (word -> bit mask of languages), weights (features, languages), move (languages, languages)."""

    MOST = 300_000

    def __init__(self, languages: list[str], lexicon: dict[str, int], weights: np.ndarray, move: np.ndarray):
        self.languages, self.lexicon, self.weights, self.move = languages, lexicon, weights, move
        self._reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.empty((0, len(self.languages)), dtype=np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, languages); each distinct word is worked out once."""
        if len(self.number) > self.MOST:
            self._reset()
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            feats = [features(w, self.lexicon) for w in new]
            n = np.fromiter(map(len, feats), dtype=np.int64, count=len(feats))
            flat = np.fromiter((x for f in feats for x in f), dtype=np.int64, count=int(n.sum()))
            rows = np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0)
            for w in new:
                number[w] = len(number)
            self.scores = np.concatenate((self.scores, rows.astype(np.float32)))
        return self.scores[np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the words' probability) of each text; ("und", 0.0) without a letter."""
        words, lengths, counts = [], [], []
        for text in texts:
            w, n = chains_of(WORDS.findall(text.lower())) if text else ([], [])
            words += w
            lengths += n
            counts.append(len(w))
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if words and self.languages:
            gamma, _, _ = forward_backward(self.emissions(words), np.array(lengths), self.move)
            counts = np.array(counts)
            some = np.flatnonzero(counts)
            total = np.add.reduceat(gamma.astype(np.float64), (np.cumsum(counts) - counts)[some], axis=0) / counts[some][:, None]
            best = total.argmax(axis=1)
            for i, k, s in zip(some.tolist(), best.tolist(), total.max(axis=1).tolist(), strict=True):
                out[i] = (self.languages[k], min(1.0, max(0.0, s)))
        return out


def fit(rows: list[tuple[str, str]], seed: int = 3) -> Model:
    """A model from (language, text) rows: full-batch gradient steps on the chains' log-likelihood, with per-weight step sizes.

    Every second chain is joined of two languages' halves, so that transitions between languages are learned too.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    number = {x: i for i, x in enumerate(languages)}
    chains: list[list[list[str]]] = [[] for _ in languages]
    counts = [Counter() for _ in languages]
    for lang, text in sorted(rows):
        k = number[lang]
        words, lengths = chains_of(WORDS.findall(text.lower()))
        counts[k].update(words)
        at = 0
        for n in lengths:
            chains[k].append(words[at : at + n])
            at += n
    lexicon: dict[str, int] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    words, labels, lengths = [], [], []
    some = [[c[i] for i in rng.permutation(len(c))] for c in chains]
    for k, own in enumerate(some):
        for i, chain in enumerate(own):
            parts = [(k, chain)]
            other = int(rng.integers(len(languages)))
            if i % 2 and other != k and some[other]:
                mate = some[other][int(rng.integers(len(some[other])))]
                parts = [(k, chain[: len(chain) // 2 + 1]), (other, mate[len(mate) // 2 :])]
            for lab, part in parts:
                words += part
                labels += [lab] * len(part)
            lengths.append(sum(len(p) for _, p in parts))
    n_features = (1 << BITS) + len(languages)
    weights, move = np.zeros((n_features, len(languages))), np.zeros((len(languages), len(languages)))
    if not words or len(languages) < 2:
        return Model(languages, lexicon, weights.astype(np.float32), move.astype(np.float32))
    labels, lengths = np.array(labels), np.array(lengths)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    which = np.fromiter((distinct[w] for w in words), dtype=np.int64, count=len(words))
    feats = [features(w, lexicon) for w in distinct]
    n = np.fromiter(map(len, feats), dtype=np.int64, count=len(feats))
    flat, owner = np.fromiter((x for f in feats for x in f), dtype=np.int64, count=int(n.sum())), np.repeat(np.arange(len(feats)), n)
    first = np.cumsum(n) - n
    truth = np.eye(len(languages))[labels]
    inside = np.ones(len(words), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    seen = np.zeros_like(move)
    np.add.at(seen, (labels[:-1][inside[:-1]], labels[1:][inside[:-1]]), 1)
    sq_w, sq_m = np.full_like(weights, 1e-8), np.full_like(move, 1e-8)
    for _ in range(ROUNDS):
        emit = np.add.reduceat(weights[flat], first, axis=0)[which]
        gamma, _, pairs = forward_backward(emit, lengths, move, want_pairs=True)
        diff = (truth - gamma) / len(words)
        by_word = np.stack([np.bincount(which, diff[:, k], len(feats)) for k in range(len(languages))], axis=1)
        g = np.stack([np.bincount(flat, by_word[owner, k], n_features) for k in range(len(languages))], axis=1) - 1e-7 * weights
        gm = (seen - pairs) / len(words)
        sq_w += g * g
        sq_m += gm * gm
        weights += 0.3 * g / np.sqrt(sq_w)
        move += 0.3 * gm / np.sqrt(sq_m)
    return Model(languages, lexicon, weights.astype(np.float32), move.astype(np.float32))


def fold(doc_id: str) -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's chains, as words joined by spaces, with a place in 0..1 by hash of text and position."""
    for b in batches:
        for lang, text in zip(b.lang, b.text, strict=True):
            words, lengths = chains_of(WORDS.findall(text.lower()))
            seed, at = zlib.crc32(text.encode("utf-8", "surrogatepass")), 0
            for s in range(0, len(lengths), 10_000):
                rows = []
                for i, n in enumerate(lengths[s : s + 10_000], s):
                    rows.append((lang, zlib.crc32(f"{seed} {i}".encode()) / 2**32, " ".join(words[at : at + n])))
                    at += n
                yield pd.DataFrame(rows, columns=["lang", "place", "chain"])


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = CHAINS) -> list[tuple[str, str]]:
    """About most (lang, chain) rows, no language over its share, from documents with a lang and a fold other than 2.

    Repeated texts of a language count once. What reaches the driver is bounded by the parameters: 2 * most chains of
    CHAIN words of LETTERS letters, and one count a language.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 2))
    n = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    n = {r[0]: r[1] for r in n.collect()}
    if not n:
        return []

    def at_most(wanted: float, counts: dict) -> Column:
        return F.element_at(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, wanted / max(1, v))))]), F.col("lang"))

    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    texts = rows.where(place < at_most(per_language, n)).select("lang", "text").dropDuplicates()
    chains = materialise(texts.mapInPandas(_chains, "lang string, place double, chain string"), "langid-chains")
    k = {r[0]: r[1] for r in chains.groupBy("lang").count().collect()}
    some = chains.where(F.col("place") < at_most(most / max(1, len(k)), k)) if k else chains
    return [(r[0], r[1]) for r in some.orderBy("place", "lang", "chain").limit(2 * most).select("lang", "chain").collect()]


def _by_size(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts in parts of about size characters, which bound the words held at once."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. Null and letterless texts are und with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for part in _by_size(b.text.tolist()) for x in shared.value.label(part)]
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "held_out": b.held_out, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 2).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """predict() with a model fitted to docs' own labels; without any label all are und.

    Rows that repeat a doc_id each get a row, and a null doc_id gets one; other columns are ignored.
    """
    return predict(docs, fit(training_rows(docs)))


def accept(docs: DataFrame, least: float = 1 / 3) -> DataFrame:
    """docs without those that are und or in which no language stands out; columns and rows are otherwise as they are.

    With n languages learned a language stands out if its share p of the words' probability is at least ``least`` of the
    way from chance, 1/n, to 1: half of the words among four languages, two thirds of them among two. Texts that mix
    languages without a main one and texts whose words are of none go. With one language every text with a letter stays,
    with none every text goes. Null doc_ids and repeated rows are judged like any other, each by its own text.
    """
    model = fit(training_rows(docs))
    chance = 1 / max(2, len(model.languages))
    limit = chance + least * (1 - chance) if len(model.languages) > 1 else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays: list[bool] = []
            for part in _by_size(b.column("text").to_pylist()):
                stays += [x != "und" and score >= limit for x, score in shared.value.label(part)]
            yield b.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
