"""Secret scans: pattern matches, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of characters that keys and tokens are written in. For each character class a window slides over
the candidate; its entropy follows from counts that are changed by one character in and one out. Windows over the
class's threshold are merged into spans. Candidates on the allow list, and spans that a pattern match covers, are left
out. Pattern matches always stay.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

# The patterns of the contract (fixed values), with the length that a match, or its second group, must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ROW = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern`` inside a candidate are scanned; ``needs`` are classes that a window must mix."""

    kind: str
    pattern: re.Pattern
    window: int
    bits: float
    needs: tuple[str, ...] = ()


CLASSES = (
    CharacterClass("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0, ("0123456789", "abcdefABCDEF")),
    CharacterClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.8, ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
)
# Candidates that are known not to be secrets: UUIDs, documentation examples, digests of files and images.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r".*EXAMPLE.*"),
    re.compile(r"sha(1|256|384|512)[-_=].*"),
)


@functools.cache
def _c_log_c(window: int) -> list[float]:
    return [0.0] + [c * math.log2(c) for c in range(1, window + 1)]


def entropy_spans(run: str, cls: CharacterClass) -> list[tuple[int, int]]:
    """Merged windows of the run whose entropy is at least cls.bits and that mix all classes needed."""
    w, table = cls.window, _c_log_c(cls.window)
    counts: dict[str, int] = {}
    mixed = [0] * len(cls.needs)
    total, spans = 0.0, []
    limit = (math.log2(w) - cls.bits) * w + 1e-9  # entropy = log2(w) - total / w
    for i, ch in enumerate(run):
        if i >= w:
            old = run[i - w]
            c = counts[old]
            total += table[c - 1] - table[c]
            counts[old] = c - 1
            for k, chars in enumerate(cls.needs):
                mixed[k] -= old in chars
        c = counts.get(ch, 0)
        total += table[c + 1] - table[c]
        counts[ch] = c + 1
        for k, chars in enumerate(cls.needs):
            mixed[k] += ch in chars
        if i >= w - 1 and total <= limit and all(mixed):
            s, e = i - w + 1, i + 1
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], e)
            else:
                spans.append((s, e))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches as (start, end, kind) in code points."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return out


def method_spans(text: str, base: list[tuple[int, int, str]], classes=CLASSES, allowed=ALLOWED) -> list[tuple[int, int, str]]:
    """High-entropy spans that no pattern match covers, and that no span of an earlier class covers."""
    out, by_start = [], sorted(base)
    starts = [s for s, _, _ in by_start]
    reach = list(itertools.accumulate((e for _, e, _ in by_start), max))  # the furthest end of the matches so far
    for m in CANDIDATE.finditer(text):
        if any(a.fullmatch(m[0]) for a in allowed):
            continue
        own: list[tuple[int, int, str]] = []
        for cls in classes:
            for r in cls.pattern.finditer(m[0]):
                for s, e in entropy_spans(r[0], cls):
                    s, e = s + m.start() + r.start(), e + m.start() + r.start()
                    before = bisect.bisect_right(starts, s)
                    if not (before and reach[before - 1] >= e) and not any(x <= s and e <= y for x, y, _ in own):
                        own.append((s, e, cls.kind))
        out += own
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """One row a document: doc_id, counts by pattern, base_sha256, spans (kind:start:end, comma-joined), n_entropy.

    A null text is scanned as an empty one; repeated rows each get their row; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b.doc_id, b.text, strict=True):
                text = text or ""
                base = base_spans(text)
                more = method_spans(text, base, classes, allowed)
                kinds = [k for _, _, k in base]
                rows.append((doc, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in ROW.split(", ")])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return docs.select("doc_id", "text").mapInPandas(run, ROW)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span found replaced by mark; null texts stay null; columns stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b.text:
                if text:
                    base = base_spans(text)
                    last, parts = 0, []
                    for s, e, _ in sorted(base + method_spans(text, base)):
                        if e > last:
                            parts += [text[last:s], mark] if s >= last else []
                            last = e
                    text = "".join([*parts, text[last:]])
                out.append(text)
            yield b.assign(text=out)

    return docs.mapInPandas(run, docs.schema)
