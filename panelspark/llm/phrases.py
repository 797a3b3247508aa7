"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split at marks and line ends into pieces and those at blanks into words. A task joins the
texts of a slice to one byte array; numpy prefix polynomials over its bytes give every word a hash, and prefix
polynomials over those give every n-gram of a piece one, so no n-gram is ever cut out of the text. Only fingerprints
with counts and one occurrence pointer each (hash of the text, byte position) shuffle.

A first scan finds which words and pairs may be frequent, from the first bits of their hashes; a second one does so
for longer phrases all of whose pairs may be: what a phrase is made of occurs at least as often as the phrase, so no
frequent phrase is lost. A third scan sends fingerprints, counts and pointers of these alone. They are asked of a Bloom
filter of bounded size; a wrong "maybe" costs a row and nothing else. Texts are read only where the pointer of a
frequent phrase leads; the phrase found there has to have the fingerprint. A second, independent hash travels along:
where it differs among the occurrences of one fingerprint, phrases collide, and those fingerprints are counted anew by
the words themselves.

A null text is empty, a null language is ``und``. Repeated rows count as often as they occur. An empty table or one
without frequent phrases gives an empty result. Columns other than text and language are never read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from .shared import partitions, written
from .tokens import slices

#: Fixed classes of bytes: blanks part words, marks and line ends part pieces.
BLANK, MARK = b" \t", b".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
SLICE_BYTES = 1 << 19
#: Hashes that a task gathers from its slices before it sends them.
GATHERED = 1_500_000
#: Odd multipliers of the byte and word polynomials, one pair for each of the two hashes.
BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

MARKS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
WORD_AT = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+")
RAW = "n int, fp long, check long, f long, text_key long, at int, lang string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _windows(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of values[begin:end] for each pair of places, from prefix sums."""
    size = 1 << max(10, int(len(values)).bit_length())
    up, down = _powers(base, size)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[end] - prefix[begin]) * down[begin]


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[list(BLANK)], kind[list(MARK)] = 1, 2
    return kind


class Slice:
    """The words of some texts, each by its place, piece and text, and hashes of their n-grams."""

    def __init__(self, parts: Sequence[Part]):
        texts, langs = [p.text for p in parts], [p.lang for p in parts]
        joined = b"\n".join(texts).lower()  # of bytes: A-Z only
        self.raw, self.langs = joined, langs
        self.bytes = np.frombuffer(joined, np.uint8)
        self.starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        kind = _classes()[self.bytes]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[self.begin] if len(self.begin) else self.begin
        self.text = np.searchsorted(self.starts, self.begin, "right") - 1
        salt = {g: xxhash.xxh3_64_intdigest(g.encode()) for g in set(langs)}
        self.salt = np.array([salt[g] for g in langs], np.uint64)[self.text] if len(langs) else np.zeros(0, np.uint64)

    @functools.lru_cache(maxsize=2)  # noqa: B019
    def _words(self, which: int) -> np.ndarray:
        by_byte = _windows(self.bytes.astype(np.uint64) + np.uint64(1), self.begin, self.end, BASES[which][0])
        return _mixed(by_byte + (self.end - self.begin).astype(np.uint64))

    def places(self, n: int) -> np.ndarray:
        """First words of the n-grams that stand within a piece."""
        if len(self.begin) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def hashes(self, n: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        return _mixed(_windows(self._words(which), at, at + n, BASES[which][1]) + self.salt[at] + np.uint64(n))

    def phrase(self, first: int, n: int) -> str:
        return b" ".join(self.raw[self.begin[i] : self.end[i]] for i in range(first, first + n)).decode()


class Part(NamedTuple):
    """A text, or a run of whole pieces of a long one, with its place there and the long text's key."""

    text: bytes
    lang: str
    offset: int
    key: int | None


def _parts(text: bytes, lang: str) -> Iterator[Part]:
    """A long text is cut behind marks, as no n-gram spans one: a task holds no more of it than a slice and a piece."""
    if len(text) <= 2 * SLICE_BYTES:
        yield Part(text, lang, 0, None)
        return
    key, begin = _key(lang, text), 0
    while begin < len(text):
        cut = MARKS.search(text, begin + SLICE_BYTES)
        end = cut.end() if cut else len(text)
        yield Part(text[begin:end], lang, begin, key)
        begin = end


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Part]]:
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            langs = pc.fill_null(batch.column("lang"), UNKNOWN).to_pylist()
            for text, lang in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), langs, strict=True):
                for part in _parts(text or b"", lang):
                    held.append(part)
                    size += len(part.text)
                    if size >= SLICE_BYTES:
                        yield held
                        held, size = [], 0
    if held:
        yield held


def _key(lang: str, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh32_intdigest(lang.encode())) - (1 << 63)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _bloom_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    fp = batch.column(0).to_numpy().view(np.uint64)
    return _mixed(fp ^ np.uint64(BASES[0][0])), _mixed(fp ^ np.uint64(BASES[1][0]))


def _bloom(fps: DataFrame, n_keys: int) -> tuple[object, int]:
    return repeats.build(fps, _bloom_keys, n_keys, least=1)


def _among(bloom: tuple[object, int], fp: np.ndarray) -> np.ndarray:
    keys = _mixed(fp ^ np.uint64(BASES[0][0])), _mixed(fp ^ np.uint64(BASES[1][0]))
    return repeats.maybe_repeated(bloom[0].value, bloom[1], *keys)


def _shortened(fp: np.ndarray, bits: int) -> np.ndarray:
    return fp >> np.uint64(64 - bits)


def _cut_off(t: np.ndarray, level: int) -> np.ndarray:
    """The first 32 + ``level`` bits of a hash: its segment, then what is sent of it."""
    return t >> np.uint64(32 - level)


def _may_be_frequent(docs: DataFrame, lengths: Sequence[int], pairs, least: int, level: int) -> DataFrame:
    """t: the first bits of the hashes of all n-grams that may occur ``least`` times or more.

    A task sends each of the 2^level segments of the hash range the next 32 bits of its n-grams' hashes with their
    counts, five bytes for each distinct n-gram; the segment's task adds these up. Hashes with equal bits are counted
    together, so no count is too low. With ``pairs`` only n-grams all of whose pairs of words are in that filter are sent.
    """
    enough = min(least, 255)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for parts in _sliced(batches):
            s = Slice(parts)
            for n in lengths:
                held.append(_cut_off(s.hashes(n, _held(s, n, pairs, level)), level))
                size += len(held[-1])
            if size >= GATHERED:
                yield np.concatenate(held)
                held, size = [], 0
        if size:
            yield np.concatenate(held)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            t.sort()
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            counts = np.minimum(np.diff(np.append(first, len(t))), 255).astype(np.uint8)
            t = t[first]
            seg, rest = (t >> np.uint64(32)).astype(np.int32), t.astype("<u4")
            cut = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg[cut]), pa.array([rest[i:j].tobytes() + counts[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(t)], strict=True)], pa.binary())], names=["seg", "data"]
            )

    def added(seg: int, held: list[bytes]) -> pa.RecordBatch:
        sizes = [len(d) // 5 for d in held]
        rest = np.concatenate([np.frombuffer(d, "<u4", n) for d, n in zip(held, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(d, np.uint8, n, 4 * n) for d, n in zip(held, sizes, strict=True)])
        order = np.argsort(rest)
        rest = rest[order]
        first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        often = np.add.reduceat(counts[order].astype(np.int64), first) >= enough
        return pa.RecordBatch.from_arrays([pa.array(rest[first[often]].astype(np.int64) + (seg << 32))], names=["t"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for seg, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seg != now and held:
                    yield added(now, held)
                    held = []
                now = seg
                held.append(data)
        if held:
            yield added(now, held)

    sent = docs.mapInArrow(send, "seg int, data binary")
    return written(sent.repartition(partitions(docs.sparkSession), "seg").sortWithinPartitions("seg").mapInArrow(segment, "t long"), "may")


def _held(s: Slice, n: int, pairs, level: int) -> np.ndarray:
    """Places of the n-grams all of whose pairs of words are in the filter; all places without one."""
    at = s.places(n)
    if pairs is None or not len(at):
        return at
    two = s.places(2)
    good = np.zeros(len(s.begin), bool)
    good[two] = _among(pairs, _cut_off(s.hashes(2, two), level))
    held = good[at]
    for i in range(1, n - 1):
        held &= good[at + i]
    return at[held]


def _count(docs: DataFrame, longest: int, may, level: int, bits: int) -> DataFrame:
    """Fingerprints of the n-grams that are in the filter, counted; rows of n = 0 hold a language and its number of words."""
    names = ["n", "fp", "check", "f", "text_key", "at", "lang"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _sliced(batches):
            s, langs = Slice(parts), [p.lang for p in parts]
            keys = np.array([_key(p.lang, p.text) if p.key is None else p.key for p in parts], np.int64)
            base = s.starts - np.array([p.offset for p in parts], np.int64)
            for n in range(1, longest + 1):
                at = s.places(n)
                fp = s.hashes(n, at)
                held = _among(may, _cut_off(fp, level)) if len(at) else np.zeros(0, bool)
                at, fp = at[held], _shortened(fp[held], bits)
                if not len(at):
                    continue
                check = s.hashes(n, at, 1)
                order = np.argsort(fp, kind="stable")
                fp, check = fp[order], check[order]
                first = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])))
                where = at[order[first]]
                doc, rows = s.text[where], len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, n, np.int32)), _signed(fp[first]), _signed(check[first]), pa.array(np.diff(np.append(first, len(fp)))), pa.array(keys[doc]),
                     pa.array((s.begin[where] - base[doc]).astype(np.int32)), pa.nulls(rows, pa.string())], names=names,
                )
            words = np.bincount(s.text, minlength=len(langs))
            kinds = sorted(set(langs))
            totals = [int(words[np.array([g == k for g in langs])].sum()) for k in kinds]
            zero = pa.array([0] * len(kinds), pa.int64())
            yield pa.RecordBatch.from_arrays([zero.cast(pa.int32()), zero, zero, pa.array(totals, pa.int64()), zero, zero.cast(pa.int32()), pa.array(kinds, pa.string())], names=names)

    spot = F.min(F.struct("text_key", "at")).alias("spot")
    counted = docs.mapInArrow(scan, RAW).groupBy("n", "fp", "lang").agg(F.min("check").alias("check_lo"), F.max("check").alias("check_hi"), F.sum("f").alias("f"), spot)
    return written(counted.select("n", "fp", "lang", "check_lo", "check_hi", "f", "spot.*"), "counted")


def _recounted(docs: DataFrame, collided: DataFrame, n_keys: int, bits: int) -> DataFrame:
    """lang, n, phrase, f of all phrases that have one of the fingerprints, counted by their words."""
    bloom = _bloom(collided.select("fp"), n_keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _sliced(batches):
            s, langs = Slice(parts), [p.lang for p in parts]
            for n in range(1, LONGEST + 1):
                at = s.places(n)
                at = at[_among(bloom, _shortened(s.hashes(n, at), bits))] if len(at) else at
                counts: dict[tuple[str, str], int] = {}
                for i in at.tolist():
                    key = langs[s.text[i]], s.phrase(i, n)
                    counts[key] = counts.get(key, 0) + 1
                if counts:
                    fp = _fingerprints([p for _, p in counts], [g for g, _ in counts], n)[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g for g, _ in counts]), pa.array([n] * len(counts), pa.int32()), _signed(_shortened(fp, bits)), pa.array([p for _, p in counts]), pa.array(list(counts.values()), pa.int64())],
                        names=["lang", "n", "fp", "phrase", "f"],
                    )

    found = docs.mapInArrow(scan, "lang string, n int, fp long, phrase string, f long").join(collided.select("n", "fp"), ["n", "fp"], "left_semi")
    return found.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))


def _fingerprints(phrases: Sequence[str], langs: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of phrases of n words."""
    s = Slice([Part(p.encode(), g, 0, None) for p, g in zip(phrases, langs, strict=True)])
    at = s.places(n)
    return s.hashes(n, at), s.hashes(n, at, 1)


def _materialised(docs: DataFrame, frequent: DataFrame, n_keys: int, bits: int) -> DataFrame:
    """lang, n, phrase, f: the words at the pointers of frequent fingerprints."""
    spots = frequent.groupBy("text_key").agg(F.collect_list(F.struct("n", "fp", "check_lo", "f", "at")).alias("spots"))  # one text's n-grams at most
    bloom = _bloom(frequent.select("text_key"), n_keys)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole, SLICE_BYTES)):
            langs = pc.fill_null(batch.column("lang"), UNKNOWN).to_pylist()
            keys = np.array([_key(g, t or b"") for g, t in zip(langs, batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True)], np.int64)
            held = np.flatnonzero(_among(bloom, keys.view(np.uint64)))
            _, once = np.unique(keys[held], return_index=True)
            take = pa.array(held[once])
            yield pa.RecordBatch.from_arrays([pa.array(keys).take(take), pa.array(langs, pa.string()).take(take), batch.column("text").take(take)], names=["text_key", "lang", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, own in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spots").to_pylist(), strict=True):
                low = (text or b"").lower()
                for n in sorted({x["n"] for x in own}):
                    part = [x for x in own if x["n"] == n]
                    found = []
                    for x in part:
                        words, at = [], x["at"]
                        while len(words) < n and (m := WORD_AT.match(low, at)):
                            words.append(m[0])
                            at = m.end()
                            while at < len(low) and low[at] in BLANK:
                                at += 1
                        found.append(b" ".join(words).decode("utf-8", "replace") if len(words) == n else None)
                    part = [(x, p) for x, p in zip(part, found, strict=True) if p is not None]
                    if not part:
                        continue
                    fp, check = _fingerprints([p for _, p in part], [lang] * len(part), n)
                    same = (_shortened(fp, bits).view(np.int64) == np.array([x["fp"] for x, _ in part])) & (check.view(np.int64) == np.array([x["check_lo"] for x, _ in part]))
                    part = [y for y, ok in zip(part, same.tolist(), strict=True) if ok]  # else a text that only shares the key
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(part), pa.string()), "n": pa.array([n] * len(part), pa.int32()),
                        "phrase": pa.array([p for _, p in part], pa.string()), "f": pa.array([x["f"] for x, _ in part], pa.int64()),
                    })

    texts = docs.mapInArrow(hit, "text_key long, lang string, text string").dropDuplicates(["text_key", "lang", "text"])
    return texts.join(spots, "text_key").mapInArrow(cut, "lang string, n int, phrase string, f long").distinct()


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = 64, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, n, phrase, f of all phrases of 1 to ``longest`` words that occur ``least`` times or more; lang, words of the languages."""
    own = docs.select(docs[text].cast("string").alias("text"), F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("lang"))
    often = F.col("f") >= least
    level = min(30, (2 * partitions(docs.sparkSession) - 1).bit_length())
    may = _may_be_frequent(own, range(1, min(longest, 2) + 1), None, least, level)
    if longest > 2:
        pairs = _bloom(may, may.count())
        may = may.unionByName(_may_be_frequent(own, range(3, longest + 1), pairs, least, level))
    counted = _count(own, longest, _bloom(may, may.count()), level, bits)
    totals = counted.filter("n = 0").select("lang", F.col("f").alias("words"))
    found = counted.filter(often & (F.col("n") > 0)).drop("lang")
    found = written(found, "frequent")
    clean, collided = found.filter("check_lo = check_hi"), found.filter("check_lo <> check_hi")
    n_clean, n_collided = clean.count(), collided.count()
    out = _materialised(own, clean, n_clean, bits)
    if n_collided:
        out = out.unionByName(_recounted(own, collided, n_collided, bits).filter(often))
    return written(out, "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = 100, top: int = TOP, bits: int = 64, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two words or more.

    A phrase is scored at its weakest cut, floor(1000 a n / (l r)) in whole numbers of up to 38 digits. It is left out
    where a frequent phrase one word longer holds it and occurs ``share`` percent as often or more; a longer one that
    does so implies one of one word more.
    """
    phrases, totals = frequent_phrases(docs, least, longest, bits, text, lang)
    split = F.split("phrase", " ")
    longer = phrases.filter("n > 1").withColumn("w", split)
    k = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    cuts = longer.select("lang", "phrase", F.col("n").alias("len"), F.col("f").alias("a"), "w", k)
    cuts = cuts.select("lang", "phrase", "len", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("tail"))
    cuts = written(cuts, "cuts")
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"))
    heads = part.withColumnsRenamed({"part": "head", "f": "l"})
    tails = part.withColumnsRenamed({"part": "tail", "f": "r"})
    exact = "decimal(20,0)"
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals.withColumnRenamed("words", "n"), "lang")
    scored = scored.withColumn("score", F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {exact}) * cast(n as {exact})) div (cast(l as {exact}) * cast(r as {exact}))"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = cuts.filter("len > 2 and k = len - 1").select("lang", F.col("head").alias("phrase"), F.col("a").alias("f"))
    inner = inner.unionByName(cuts.filter("len > 2 and k = 1").select("lang", F.col("tail").alias("phrase"), F.col("a").alias("f")))
    held = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = weakest.join(held, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < share * F.col("a")))
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
