"""Phrase collocations against brute force, with hashes so short that most phrases collide."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelspark.llm import phrases

DOCS = "doc_id long, text string, lang string"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, longest=5, share=100, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(len(q) > len(p) and b >= least and 100 * b >= share * a and g == lang and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in f.items()):
            continue
        score, k = min((int(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    want = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        want += [(lang, r, *x[1:]) for r, x in enumerate(own[:top], 1)]
    return want


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["Of", "the", "é", "über", "a1", "x-y", "漢字", "’s", "\x85", "b\u00a0c", *[f"w{i}" for i in range(12)]]
    fixed = ["of the long way home", "the w1 w2", "no such thing as this at all"]

    def text(n):
        return "".join(r.choice(vocabulary if r.random() < 0.8 else fixed) + r.choice([" ", " ", " ", "\t ", ", ", "\n", ".\x0b", "  "]) for _ in range(n))

    own = [(i, text(r.randrange(0, 60)), r.choice(["en", "de", None, "und"])) for i in range(150)]
    own += [(200, None, "en"), (201, "", None), (202, " \t.,", "fr"), (203, text(4000), "en")] + [own[0]] * 30 + [(None, text(9), "de")]
    return own


def spread(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "fp": F.lit(2), "phrase": F.lit(3)}).repartition(4)


@pytest.mark.parametrize("bits", [64, 9])
def test_equal_to_brute_force(spark, rows, bits, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 3000)
    monkeypatch.setattr(phrases, "GATHERED", 2000)
    got = phrases.collocations(spread(spark, rows), least=8, bits=bits).orderBy("lang", "rank").collect()
    want = brute(rows, 8)
    assert [tuple(g) for g in got] == want and len(want) > 100


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 50)
    text = b"One two, three\n" * 40 + b"x" * 300 + b" end"
    parts = list(phrases._parts(text, "en"))
    assert b"".join(p.text for p in parts) == text and len(parts) > 8 and len({p.key for p in parts}) == 1
    assert all(text[p.offset :].startswith(p.text) and (p.text[-1:] in (b",", b"\n") or p is parts[-1]) for p in parts)
    assert [p.text for p in phrases._parts(b"a, b" * 20, "en")] == [b"a, b" * 20]


def test_other_limits(spark, rows):
    got = phrases.collocations(spread(spark, rows), least=20, longest=3, share=60, top=7).orderBy("lang", "rank").collect()
    assert [tuple(g) for g in got] == brute(rows, 20, 3, 60, 7)


def test_copies_and_ties(spark):
    """One text a thousand times, and phrases that tie in score and count."""
    rows = [(i, "b a. d c. a b", "en") for i in range(1000)] + [(i, f"only{i} here", None) for i in range(50)]
    got = phrases.collocations(spread(spark, rows), least=100).orderBy("lang", "rank").collect()
    assert [tuple(g) for g in got] == brute(rows, 100) and [g.phrase for g in got] == ["d c", "a b", "b a"]


def test_nothing_frequent(spark, rows):
    assert phrases.collocations(spread(spark, rows), least=10**6).count() == 0
    assert phrases.collocations(spread(spark, rows).limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    """Counts whose products need more than 64 bits, through the arithmetic alone."""
    a, n, part = 3 * 10**9, 7 * 10**12, 5 * 10**9
    exact = "decimal(20,0)"
    got = spark.sql(f"select (cast(1000 as decimal(4,0)) * cast({a} as {exact}) * cast({n} as {exact})) div (cast({part} as {exact}) * cast({part} as {exact})) as s").first().s
    assert got == 1000 * a * n // (part * part) and 1000 * a * n > 1 << 64
