"""Cross-tokenizer alignment against both libraries over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.llm import alignment
from panelspark.llm.queries_alignment import tokenizer_paths

DOCS = "doc_id long, text string"


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte_path, piece_path = tokenizer_paths()
    left, right = Tokenizer.from_file(byte_path), SentencePieceProcessor(model_file=piece_path)
    left.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    found, held = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = (left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in left.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append((doc_id, [], [], [], []))
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            at = 0
            spans.append([(at, at := at + len(t)) for t in tokens])
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for end in common:
            groups.append(([i for i, (_, e) in zip(a, spans[0], strict=True) if begin < e <= end], [i for i, (_, e) in zip(b, spans[1], strict=True) if begin < e <= end]))
            begin = end
        links = [(i, j) for i, (p, q) in zip(a, spans[0], strict=True) for j, (x, y) in zip(b, spans[1], strict=True) if p < y and x < q]
        held.update(set(links))
        found.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, found


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = ["The", "über", "thing", "don't", "x=1;", "漢字", "naïve,", "12,345.67", "http://a.org/b?c", "🙂", "👩\u200d👧", "\u00a0", "a\tb", "\n", "\n\n", "", "", "<s>", "<|endoftext|>", "<0x41>", "e\u0301", "\x00", "\u3000", "…", "’s"]
    own = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(120)]
    own += [(200, None), (201, ""), (202, " "), (203, "   "), (204, "trail "), (205, "  lead"), (206, "mark \u2581 inside"), (207, "x" * 3000), (208, "no blank at all" * 300), (209, "\r\n \r\n"), (None, "no id")]
    return own + [own[3]] * 40 + [(5, "again")]


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("block_links", [300, 2_000_000])
def test_summary_equals_brute_force(spark, rows, block_links):
    df = spark.createDataFrame(rows, DOCS).withColumns({"block": F.lit(1), "pair": F.lit(2), "kind": F.lit(3)}).repartition(5)
    got = alignment.aligned(df, *tokenizer_paths(), block_links=block_links)[0].collect()
    want, found = brute(rows)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    zero = {w[0] for w in want if w[1] == 0}
    assert {200, 201, 206} <= zero and not {202, 203, 204, 205, 207, 208, 209, None} & zero  # only 206 has tokens that do not give back its bytes


def test_pair_counts_and_groups(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    _, found = brute(rows)
    held = Counter(p for f in found for p in set(f[4]))
    pairs = alignment.aligned(df, *tokenizer_paths(), block_links=500)[1].collect()
    assert {(p.pair >> 32, p.pair & 0xFFFFFFFF): p.n for p in pairs} == held
    got = defaultdict(list)
    for g in alignment.groups(df, *tokenizer_paths()).collect():
        got[g.doc_id].append(g)
    once = Counter(f[0] for f in found)
    texts = dict(rows)
    for doc_id, a, _, groups, _ in found:
        if once[doc_id] == 1 and a:
            own = sorted(got[doc_id], key=lambda g: g.group)
            assert [(list(g.a), list(g.b)) for g in own] == groups and own[0].begin == 0 and own[-1].end == len((" " + texts[doc_id]).encode())
            assert all(x.end == y.begin for x, y in zip(own, own[1:], strict=False))


def test_groups_and_links_of_ends():
    assert alignment.groups_of([2, 5, 6], [1, 2, 6]) == [(0, 1, 0, 2, 2), (1, 3, 2, 3, 6)]
    assert alignment.links_of([2, 5, 6], [1, 2, 6], 1, 3, 2, 3) == [(1, 2), (2, 2)]
    assert alignment.links_of([3, 4], [1, 4], 0, 2, 0, 2) == [(0, 0), (0, 1), (1, 1)]


def test_cache_of_runs_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_RUNS", 50)
    own = alignment.Aligner(*tokenizer_paths())
    fresh = alignment.Aligner(*tokenizer_paths())
    for k in range(30):
        text = " ".join(f"run{(7 * k + i) % 200}" for i in range(20)) + " " + "y" * 200
        assert list(own.align([text])) == list(fresh.align([text]))
        fresh.runs, fresh.older = {}, {}
    assert len(own.runs) <= 50 + 21 and all(len(r) <= alignment.CACHED_LENGTH for r in own.runs)


def test_empty_table(spark):
    summary, pairs = alignment.aligned(spark.createDataFrame([], DOCS), *tokenizer_paths())
    assert summary.count() == 0 and pairs.count() == 0
