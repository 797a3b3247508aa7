"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers part a text before each blank that follows a character other than white space: no byte-level word
begins elsewhere with a blank, and no piece has its blank mark inside. So a text's tokens are those of its runs (a blank
and what follows), one after another, and runs are aligned by themselves; short ones are kept by each worker in a cache
of bounded size. Within a run, the cumulative ends of either side's tokens become dictionaries from end to index; their
key sets are intersected, and the sorted common ends slice both id lists into groups; links are expanded per slice.

How many documents hold an id pair linked is counted over the corpus: a task gathers a block of documents, sends each
distinct pair of the block once with its number of documents, and writes what it keeps of the documents. The counts come
back to the block through one join; a block holds about ``BLOCK_LINKS`` links, so nothing of the corpus is ever in one task.

A null or empty text, and one whose tokens do not give back its bytes on either side, has no tokens and no links. Rows
that repeat a doc_id are documents of their own. Columns other than id and text are never read.
"""

from __future__ import annotations

import functools
import hashlib
import gc
import os
import re
import uuid
from array import array
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written
from .tokens import BYTE_NAMES, slices

BLOCK_LINKS = 2_000_000
CACHE_RUNS, CACHED_LENGTH = 250_000, 40
#: Runs that are aligned in one go.
TOGETHER = 20_000
BLANK_MARK = "▁"
#: A blank that does not end a run: after white space, or at either end of a text.
OPEN = re.compile(r"\s |^ | \Z")
ASKED, KEPT = 1, 2

SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, group long, begin long, end long, a array<int>, b array<int>"


def groups_of(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """(first a, end a, first b, end b, byte end) of each group of tokens between two neighbouring common ends."""
    at_a, at_b = dict(zip(ends_a, count(1), strict=False)), dict(zip(ends_b, count(1), strict=False))
    out, a, b = [], 0, 0
    for end in sorted(at_a.keys() & at_b.keys()):
        out.append((a, at_a[end], b, at_b[end], end))
        a, b = at_a[end], at_b[end]
    return out


def links_of(ends_a: Sequence[int], ends_b: Sequence[int], a: int, to_a: int, b: int, to_b: int) -> list[tuple[int, int]]:
    """Index pairs of the tokens in a group whose bytes overlap: along both sides, the one that ends first moves on."""
    out = []
    while a < to_a and b < to_b:
        out.append((a, b))
        end_a, end_b = ends_a[a], ends_b[b]
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
    return out


class Run(NamedTuple):
    n_a: int
    n_b: int
    #: Groups as decimal text, and their number.
    text: str
    groups: int
    #: Linked ids, a << 32 | b, as 64-bit integers, one for each link.
    pairs: bytes


class Aligner:
    """Runs aligned for one byte-level tokenizer file (tokenizers) and one piece model (sentencepiece)."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.bytewise = Tokenizer.from_file(byte_path)
        self.bytewise.no_padding()
        self.bytewise.no_truncation()
        self.bytewise.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=piece_path)
        of_name = {chr(code): byte for byte, code in BYTE_NAMES.items()}
        names = (self.bytewise.id_to_token(i) or "" for i in range(self.bytewise.get_vocab_size(with_added_tokens=True)))
        self.bytes_a = [bytes(of_name.get(c, ord(c) & 0xFF) for c in n) for n in names]
        pieces = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(BLANK_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.pieces.encode("x ")[len(self.pieces.encode("x")) :]
        self.length_a, self.length_b = [len(t) for t in self.bytes_a], [len(t) for t in self.bytes_b]
        self.decimal = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        #: Where a piece has its mark inside, runs are not independent and texts are taken as one run.
        self.parted = not any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in pieces)
        self.runs: dict[str, Run | None] = {}
        self.older: dict[str, Run | None] = {}

    def tokens(self, runs: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids on both sides of runs, which come without their first blank."""
        of_b = self.pieces.encode(list(runs), num_threads=1)
        if "" in runs:  # a blank at the end of a text; the library encodes no text to no pieces
            of_b = [b if r else self.blank for r, b in zip(runs, of_b, strict=True)]
        return [e.ids for e in self.bytewise.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)], of_b

    def _ends(self, runs: Sequence[str], each: Sequence[Sequence[int]], table: Sequence[bytes], length: Sequence[int]) -> tuple[list[int], list[int]] | None:
        """All ids of one side and their cumulative ends along the runs' bytes; None where some run's tokens are not its bytes."""
        ids = list(chain.from_iterable(each))
        if b"".join([table[i] for i in ids]) != "".join([" " + r for r in runs]).encode():
            return None
        ends = list(accumulate([length[i] for i in ids]))
        last = [ends[i - 1] for i in accumulate(map(len, each))]
        return (ids, ends) if last == list(accumulate([len(r.encode()) + 1 for r in runs])) else None

    def aligned(self, runs: Sequence[str]) -> list[Run | None]:
        """Runs aligned together, one after another along their bytes; None where tokens do not give back a run's bytes."""
        each_a, each_b = self.tokens(runs)
        side_a, side_b = self._ends(runs, each_a, self.bytes_a, self.length_a), self._ends(runs, each_b, self.bytes_b, self.length_b)
        if side_a is None or side_b is None:
            if len(runs) == 1:
                return [None]
            half = len(runs) // 2  # the others are aligned without the runs that do not hold
            return self.aligned(runs[:half]) + self.aligned(runs[half:])
        (ids_a, ends_a), (ids_b, ends_b) = side_a, side_b
        sizes = zip(accumulate(map(len, each_a)), map(len, each_a), map(len, each_b), strict=True)
        done, texts, pairs, decimal = [], [], [], self.decimal
        now = next(sizes, None)
        for a, to_a, b, to_b, _ in groups_of(ends_a, ends_b):
            if to_a - a == 1 and to_b - b == 1:
                texts.append(decimal[ids_a[a]] + "|" + decimal[ids_b[b]])
                pairs.append(ids_a[a] << 32 | ids_b[b])
            else:
                texts.append(",".join([decimal[i] for i in ids_a[a:to_a]]) + "|" + ",".join([decimal[i] for i in ids_b[b:to_b]]))
                pairs += [ids_a[i] << 32 | ids_b[j] for i, j in links_of(ends_a, ends_b, a, to_a, b, to_b)]
            if to_a == now[0]:  # the run ends on both sides
                done.append(Run(now[1], now[2], ";".join(texts), len(texts), array("q", pairs).tobytes()))
                texts, pairs, now = [], [], next(sizes, None)
        return done

    def parts(self, text: str) -> list[str]:
        """The runs of a text, each without its first blank."""
        if not self.parted:
            return [text]
        if not OPEN.search(text):
            return text.split(" ")
        out, open_part = [], None
        for part in text.split(" "):
            if open_part is not None:
                part = open_part + " " + part
            open_part = part if not part or part[-1].isspace() else None
            if open_part is None:
                out.append(part)
        return out if open_part is None else [*out, open_part]

    def align(self, texts: Sequence[str | None]) -> Iterator[list[Run] | None]:
        """The runs of each text; None for a text without tokens."""
        parts = [self.parts(t) if t else [] for t in texts]
        self._learn(parts, long := {})
        own = self.runs
        for p in parts:
            runs = [own[r] if r in own else long[r] for r in p]
            yield runs if runs and None not in runs else None

    def _learn(self, parts: Sequence[Sequence[str]], long: dict[str, Run | None]) -> None:
        """All runs of the texts into the cache, or into ``long`` where they are too long for it."""
        if len(self.runs) >= CACHE_RUNS:
            self.runs, self.older = {}, self.runs
        own, older, new = self.runs, self.older, []
        for r in set().union(*parts):
            if r not in own:
                if r in older:
                    own[r] = older[r]
                else:
                    new.append(r)
        collecting = gc.isenabled()
        gc.disable()  # many small tuples, and no cycles among them
        for i in range(0, len(new), TOGETHER):
            some = new[i : i + TOGETHER]
            for r, run in zip(some, self.aligned(some), strict=True):
                (own if len(r) <= CACHED_LENGTH else long)[r] = run
        if collecting:
            gc.enable()


@functools.lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(byte_path, piece_path)


def _own(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def groups(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """GROUPS: one row per group, with its bytes in blank + text and the ids of both sides."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path)
        for whole in batches:
            for batch in slices(whole):
                for key, runs in zip(batch.column("doc_id").to_pylist(), own.align(batch.column("text").to_pylist()), strict=True):
                    rows, begin = [], 0
                    for r in runs or []:
                        for g in r.text.split(";"):
                            a, b = ([int(x) for x in side.split(",")] for side in g.split("|"))
                            end = begin + sum(len(own.bytes_a[i]) for i in a)
                            rows.append((begin, end, a, b))
                            begin = end
                    if rows:
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([key] * len(rows), pa.int64()), "group": pa.array(range(len(rows)), pa.int64()), "begin": pa.array([r[0] for r in rows], pa.int64()),
                            "end": pa.array([r[1] for r in rows], pa.int64()), "a": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "b": pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                        })

    return _own(docs, text, doc_id).mapInArrow(work, GROUPS)


BLOCKS = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, docs long, links binary"


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, block_links: int) -> DataFrame:
    """Rows KEPT: a document with, for each of its distinct pairs, the pair's number within the block and its links.
    Rows ASKED: a distinct pair of the block, with how many documents of it hold the pair."""
    nothing = pa.nulls

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path)
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        held, size = [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            block = uuid.uuid4().int >> 65
            pairs = np.concatenate([h[5] for h in held])
            distinct, number = np.unique(pairs, return_inverse=True)
            n_docs = np.bincount(number, minlength=len(distinct))
            rows = len(distinct)
            for i in range(0, rows, 100_000):
                part = distinct[i : i + 100_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, ASKED, np.int32)), pa.array(np.full(k, block)), *[nothing(k, pa.int64())] * 4, nothing(k, pa.string()), pa.array(part), pa.array(n_docs[i : i + 100_000]), nothing(k, pa.binary())], names=names
                )
            at = np.cumsum([0, *[len(h[5]) for h in held]])
            for i in range(0, len(held), 500):
                some = held[i : i + 500]
                k = len(some)
                data = [number[at[i + j] : at[i + j + 1]].astype("<u4").tobytes() + h[6].astype("<u4").tobytes() for j, h in enumerate(some)]
                longs = [pa.array([h[c] for h in some], pa.int64()) for c in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, KEPT, np.int32)), pa.array(np.full(k, block)), *longs, pa.array([h[4] for h in some], pa.string()), *[nothing(k, pa.int64())] * 2, pa.array(data, pa.binary())], names=names
                )

        for whole in batches:
            for batch in slices(whole):
                for key, runs in zip(batch.column("doc_id").to_pylist(), own.align(batch.column("text").to_pylist()), strict=True):
                    if runs is None:
                        held.append((key, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    else:
                        pairs, links = np.unique(np.frombuffer(b"".join([r.pairs for r in runs]), np.int64), return_counts=True)
                        sha = hashlib.sha256(";".join([r.text for r in runs]).encode()).hexdigest()
                        held.append((key, sum([r.n_a for r in runs]), sum([r.n_b for r in runs]), sum([r.groups for r in runs]), sha, pairs, links))
                        size += len(pairs)
                    if size >= block_links or len(held) >= block_links // 100 + 1:
                        yield from closed()
                        held, size = [], 0
        if held:
            yield from closed()

    return docs.mapInArrow(work, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its A id has more)."""
    counts = blocks.filter(F.col("kind") == ASKED).groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # as many rows as there are B ids, at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", doc_id: str = "doc_id", block_links: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """SUMMARY of every document, and the counts of all pairs."""
    blocks = written(_blocks(_own(docs, text, doc_id), byte_path, piece_path, block_links), "blocks")
    counts = written(pair_counts(blocks), "pairs")
    asked = blocks.filter(F.col("kind") == ASKED).select("block", "pair")
    answers = asked.join(counts, "pair").select(F.lit(ASKED).alias("kind"), "block", "pair", "n", "best")
    kept = blocks.filter(F.col("kind") == KEPT).select("kind", "block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    both = answers.unionByName(kept, allowMissingColumns=True).select("block", "kind", "pair", "n", "best", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    dealt = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "pair")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's answers, in the order of its pairs' numbers, come before its documents."""
        now, n, best, whole = None, [], [], None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cut = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(block)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if block[i] != now:
                    now, n, best, whole = block[i], [], [], None
                if kind[i] == ASKED:
                    n.append(part.column("n").to_numpy())
                    best.append(pc.cast(part.column("best"), pa.int64()).to_numpy(zero_copy_only=False))
                    continue
                if whole is None:
                    whole = (np.concatenate(n), np.concatenate(best)) if n else (np.zeros(0, np.int64),) * 2
                sums = []
                for data in part.column("links").to_pylist():
                    x = np.frombuffer(data, "<u4").astype(np.int64)
                    number, links = x[: len(x) // 2], x[len(x) // 2 :]
                    sums.append((int(links.sum()), int((links * whole[1][number]).sum()), int((links * whole[0][number]).sum())))
                own = {c: part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
                yield pa.RecordBatch.from_pydict(own | {c: pa.array([s[k] for s in sums], pa.int64()) for k, c in enumerate(("n_links", "n_best", "count_sum"))} | {"groups_sha256": part.column("groups_sha256")})

    return dealt.mapInArrow(work, SUMMARY), counts
