"""Secret scans: three fixed patterns, and sliding-window Shannon entropy per character class.

A candidate is a run of token characters. For each class (hex digits, letters of one case with digits, or the wider key
alphabet) a window slides over the candidate's runs of that class's characters; its entropy follows from incremental
counts, one character in and one out per step. A run shorter than the window is one window, and the threshold shrinks as
the largest entropy of so many characters does. Windows at or above the threshold are joined to spans, over all classes.
The allow list suppresses runs that look random but are no secrets: identifiers in UUID form, plain words (letters whose
case changes only where words begin), numbers, and placeholder text. In the patterns case is that of ASCII letters.

Texts are scanned whole, and a null text counts as empty: it has no finding. Positions are code points, ends exclusive.
Repeated rows are scanned each for itself; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed patterns and least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: An assignment holds one of these, in some case; a text without any is not searched for one.
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")

#: Least length of a candidate, and of a class's run in it.
LEAST_RUN = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")


@dataclass(frozen=True)
class CharClass:
    name: str
    alphabet: frozenset[str]
    window: int
    bits: float

    @property
    def runs(self) -> re.Pattern:
        return re.compile(f"[{re.escape(''.join(sorted(self.alphabet)))}]{{{LEAST_RUN},}}")


#: Entropy thresholds in bits per character over a window.
CLASSES = (
    CharClass("hex", frozenset("0123456789abcdefABCDEF"), 24, 3.2),
    CharClass("lower36", frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 24, 3.7),
    CharClass("upper36", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 24, 3.7),
    CharClass("key", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 4.05),
)
RUNS = tuple((c, c.runs) for c in CLASSES)
#: What the allow list suppresses.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[_=/-])++|[0-9_=/+-]+"),  # possessive: no run is read twice
    re.compile(r".*(?i:example|sample|placeholder|xxxx|changeme).*"),
)


def window_entropies(s: str, size: int) -> Iterator[float]:
    """Entropy of every window of ``size`` characters, from counts that change by one character in and one out.

    With counts c the entropy is log2(size) - sum(c log2 c) / size, so each step adjusts two terms of the sum.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i + 1 < size:
            continue
        yield math.log2(size) - total / size
        out = s[i + 1 - size]
        n = counts[out]
        counts[out] = n - 1
        total += term[n - 1] - term[n]


def high_entropy(s: str, size: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of the windows at or above ``bits``."""
    spans: list[tuple[int, int]] = []
    for i, h in enumerate(window_entropies(s, size)):
        if h >= bits:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + size)
            else:
                spans.append((i, i + size))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order; matches that fail their least length are dropped."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, "entropy") of the windows of every class over its own runs in the candidates, joined where they overlap."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        for kind, runs in RUNS:
            for run in runs.finditer(text, m.start(), m.end()):
                if any(a.fullmatch(run[0]) for a in ALLOW):
                    continue
                size = min(kind.window, len(run[0]))
                bits = kind.bits * math.log2(size) / math.log2(kind.window)
                found += [(run.start() + a, run.start() + b) for a, b in high_entropy(run[0], size, bits)]
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return [(a, b, "entropy") for a, b in spans]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start_at, end_at) by start, then kind."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64())]))
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py() or ""
                spans = sorted([*base_spans(t), *entropy_spans(t)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                rows.append([{"kind": k, "start_at": a, "end_at": b} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        find, "doc_id long, spans array<struct<kind:string,start_at:long,end_at:long>>"
    )


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[{}]") -> str:
    """``text`` with each span replaced by its kind; overlapping spans are replaced together."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], mark.format(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])

