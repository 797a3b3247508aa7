"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct 5-word shingles (``shingles``). Documents with equal sets form a class, and classes
link when 100 * intersection >= 75 * union.

1. Shared elements. A linked class shares three quarters of its elements with another one. The exchange of ``tally``
   counts the classes that hold each element of half the hash domain, and a class with more than a quarter of its
   elements alone there links with nothing. This leaves copies and documents that consist of shared passages.
2. Signatures. The classes left count their elements once more, among themselves, which tells own, rare and
   frequent ones, and sign by PartEnum (``partenum``): subsets of partitions of the domain, per size band.
3. Stars. Classes with a common signature form a bucket, read as a sorted stream. Each is paired with the bucket's first
   one, that with the fewest own and rare elements: of near copies it is the one closest to all. Pairs that the counts
   allow are tested, by parity vectors first (differing bits are a lower bound of differing elements), then by the sets.
4. Across components. The signatures are dealt again with the components that the stars gave. In buckets that hold
   several, each class outside the largest one is paired with those of other components that the counts allow.

So no link between different components is lost, and pairs follow the links that are missing: what is in one component by step 3
is not paired. Buckets of more than ``HELD`` classes are dealt in pairs of blocks, so no task holds one whole.

Null, empty and blank texts have empty sets and link with nothing. Rows that repeat a doc_id belong to the same text or
not as their texts say; a null doc_id takes part with its class but never gives it its name. An empty table gives an
empty result. Set hashes are 64-bit keys of classes. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partenum, repeats, tally
from .components import components
from .shared import partitions, whole_row, written
from .shingles import class_keys, mixed, shingle_sets
from .tokens import slices

LINK, OF = 75, 100
PARITY_BITS = 512
#: Members of a bucket that a task holds at a time.
HELD = 4096
#: Buckets of at most so many members are paired by shifts of the sorted rows.
SMALL = 32
#: Pairs that a task holds before it sends the distinct ones.
PAIRS = 500_000

ALIVE = "cls long, text_key long"
SETS = "cls long, shingles binary"
CLASSES = "cls long, facts long, sketch binary, parity binary, shingles binary, kinds binary"


def parity(own: np.ndarray) -> bytes:
    """Whether each bit was met oddly often by the elements' hashes; at least two bits an element, a power of two of them."""
    bits = max(PARITY_BITS, 1 << (2 * len(own) - 1).bit_length()) if len(own) else PARITY_BITS
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Differing bits of two parities, a lower bound of how many elements differ; the longer one is folded first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LINK * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(slice of a batch, its sets, where each begins, class keys, first rows of the non-empty classes)."""
    for whole in batches:
        for batch in slices(whole):
            hashes, at = shingle_sets(batch.column("text"))
            keys = class_keys(hashes, at)
            first = np.unique(keys, return_index=True)[1] if len(keys) else np.zeros(0, np.int64)
            yield batch, hashes, at, keys, [i for i in first.tolist() if at[i + 1] > at[i]]


def _seen(source: DataFrame, parts: int) -> DataFrame:
    """doc_id, n, cls of every document, and the answers of the count of elements in half the domain, from one reading."""
    segments = 2 * tally.segments(source)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, keys, texts, size, known = [], [], [], 0, set()

        def ask() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(sets)
            n = np.array([len(s) for s in sets], np.uint32)
            of = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            half = flat < np.uint64(1 << 63)
            order = np.argsort(flat[half], kind="stable")
            own, of = flat[half][order], of[half][order]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            cls = np.array(keys, np.int64).tobytes()
            roster = np.array([len(sets), len(begin)], np.int64).tobytes() + cls + np.array(texts, np.int64).tobytes() + n.tobytes() + of[begin].tobytes()
            yield from tally.asked(own[begin], np.diff(np.append(begin, len(own))), segments, cls, roster)

        for batch, hashes, at, own, first in _sets(batches):
            if len(own):
                yield tally.passed(batch.column("doc_id"), np.diff(at), own)
            text_key = batch.column("text_key").to_pylist()
            for i in first:
                if own[i] not in known:  # copies of a text count once
                    known.add(own[i])
                    sets.append(hashes[at[i] : at[i + 1]])
                    keys.append(own[i])
                    texts.append(text_key[i])
                    size += len(sets[-1])
                if size >= tally.GATHERED or len(sets) >= tally.SETS:
                    yield from ask()
                    sets, keys, texts, size, known = [], [], [], 0, set()
        if sets:
            yield from ask()

    return written(tally.answered(source.mapInArrow(count, tally.SCHEMA), parts), "seen")


def _alive(roster: bytes, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Classes that have no more than a quarter of their elements alone."""
    m, entries = np.frombuffer(roster, np.int64, 2).tolist()
    cls, text_key = (np.frombuffer(roster, np.int64, m, 16 + 8 * m * i) for i in range(2))
    n = np.frombuffer(roster, np.uint32, m, 16 + 16 * m)
    of = np.frombuffer(roster, np.uint16, entries, 16 + 20 * m)
    alone = np.bincount(of[counts < 2], minlength=m)
    stay = (OF - LINK) * n.astype(np.int64) >= OF * alone
    yield pa.RecordBatch.from_arrays([pa.array(cls[stay]), pa.array(text_key[stay])], names=["cls", "text_key"])


def _members(keys: DataFrame) -> tuple[object, int]:
    def two(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _two(batch.column(0).to_numpy())

    return repeats.build(keys, two, keys.count(), least=1)


def _two(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.view(np.uint64)
    return mixed(keys), mixed(keys ^ np.uint64(0xD6E8FEB86659FD93))


def _live_sets(source: DataFrame, alive: DataFrame) -> DataFrame:
    """cls, shingles of the classes left: only their texts are read into shingles again."""
    wanted, bits = _members(alive.select("text_key"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    key = batch.column("text_key").to_numpy()
                    yield batch.take(pa.array(np.flatnonzero(repeats.maybe_repeated(wanted.value, bits, *_two(key)))))

        for _, hashes, at, keys, first in _sets(some()):
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in first], pa.binary())], names=["cls", "shingles"])

    return source.mapInArrow(build, SETS).groupBy("cls").agg(F.any_value("shingles").alias("shingles"))


def _classes(sets: DataFrame, parts: int) -> DataFrame:
    """cls, facts, parity, shingles, kinds of the classes that still have no more than a quarter of own elements."""
    segments = tally.segments(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], [], 0

        def ask() -> Iterator[pa.RecordBatch]:
            flat = np.frombuffer(b"".join(held), np.uint64)
            own, n = np.unique(flat, return_counts=True)
            cls = np.array(keys, np.int64).tobytes()
            sizes = np.array([len(h) // 8 for h in held], np.uint32).tobytes()
            yield from tally.asked(own, n, segments, cls, np.array([len(held)], np.int64).tobytes() + cls + flat.tobytes() + sizes)

        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                held.append(own)
                size += len(own) // 8
                if size >= tally.GATHERED:
                    yield from ask()
                    keys, held, size = [], [], 0
        if held:
            yield from ask()

    def mark(roster: bytes, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = int(np.frombuffer(roster, np.int64, 1)[0])
        cls = np.frombuffer(roster, np.int64, m, 8)
        n = np.frombuffer(roster[len(roster) - 4 * m :], np.uint32).astype(np.int64)
        flat = np.frombuffer(roster, np.uint64, int(n.sum()), 8 + 8 * m)
        kind = partenum.kinds(counts)[np.unique(flat, return_inverse=True)[1]]
        told = partenum.facts(n, kind)
        at = np.append(0, np.cumsum(n))
        own = np.add.reduceat(kind == partenum.OWN, at[:-1], dtype=np.int64)  # no set is empty here
        for i in np.flatnonzero((OF - LINK) * n >= OF * own).tolist():
            x, own_kind = flat[at[i] : at[i + 1]], kind[at[i] : at[i + 1]]
            parts = (partenum.sketch(x[own_kind == partenum.COMMON]), parity(x), x.tobytes(), own_kind.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls[i : i + 1]), pa.array(told[i : i + 1]), *(pa.array([v], pa.binary()) for v in parts)], names=["cls", "facts", "sketch", "parity", "shingles", "kinds"])

    asked = sets.mapInArrow(count, tally.SCHEMA)
    return written(tally.returned(tally.answered(asked, parts), mark, CLASSES, parts), "classes")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, facts, sketch, shingles, kinds, ...) -> (sig, cls, facts, sketch of weak signatures, ...); what follows kinds goes along."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.array([len(k) for k in batch.column(4).to_pylist()], np.int64))
        cuts = sorted({0, *(np.searchsorted(size, np.arange(tally.GATHERED, size[-1], tally.GATHERED)) + 1).tolist(), batch.num_rows})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            kind = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
            flat = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint64)
            of, sig = partenum.signatures(flat, np.array([len(k) for k in part.column(4).to_pylist()], np.int64), kind)
            pick, weak = pa.array(of), (sig & partenum.WEAK) == 1
            sketch = part.column(2).take(pa.array(of, mask=~weak))
            rest = [part.column(i).take(pick) for i in range(5, part.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), part.column(0).take(pick), part.column(1).take(pick), sketch, *rest], names=["sig", "cls", "facts", "sketch", *part.schema.names[5:]])


def _sketches(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words, zero where there is none."""
    out = np.zeros((len(column), partenum.SKETCH // 64), np.uint64)
    known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(known):
        out[known] = np.frombuffer(b"".join(column.take(pa.array(known)).to_pylist()), np.uint64).reshape(len(known), -1)
    return out


def _distinct(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(u), np.concatenate(v)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)]
    return pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new]), pa.nulls(int(new.sum()), pa.int64())], names=["u", "v", "size"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, facts, cls, sketch) -> pairs (u, v) of a bucket's first class and each other that may link; and (sig, null, size) of large buckets."""
    sig, lead, told, size, u, v = None, 0, 0, 0, [], []
    drawn = np.zeros((1, partenum.SKETCH // 64), np.uint64)
    for batch in batches:
        s, f, c = (batch.column(i).to_numpy() for i in range(3))
        if not len(s):
            continue
        k = _sketches(batch.column(3))
        begin = np.append(sig is None or s[0] != sig, s[1:] != s[:-1])
        heads = np.flatnonzero(begin)
        which = np.cumsum(begin) - 1
        sizes = np.diff(np.concatenate([[0], heads, [len(s)]]))  # the open bucket's rows first
        sizes[0] += size
        names = np.concatenate([[sig or 0], s[heads]])
        big = np.flatnonzero(sizes[:-1] > HELD)
        if len(big):
            yield pa.RecordBatch.from_arrays([pa.array(names[big]), pa.nulls(len(big), pa.int64()), pa.array(sizes[:-1][big].astype(np.int64))], names=["u", "v", "size"])
        first_c = np.concatenate([[lead], c[heads]])[which + 1]
        first_f = np.concatenate([[told], f[heads]])[which + 1]
        firsts = np.concatenate([drawn, k[heads]])
        pick = np.flatnonzero(~begin & (c != first_c))
        pick = pick[partenum.may_link((s[pick] & 1) == 1, first_f[pick], f[pick], firsts[which[pick] + 1], k[pick])]
        u.append(first_c[pick])
        v.append(c[pick])
        sig, lead, told, size, drawn = s[-1], first_c[-1], first_f[-1], int(sizes[-1]), firsts[-1:]
        if sum(map(len, u)) >= PAIRS:
            yield _distinct(u, v)
            u, v = [], []
    if size > HELD:
        yield pa.RecordBatch.from_arrays([pa.array([sig]), pa.nulls(1, pa.int64()), pa.array([size])], names=["u", "v", "size"])
    if u:
        yield _distinct(u, v)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, side, comp, cls, facts, sketch) -> pairs (u, v) of a bucket's classes in different components that may link.

    Members of side 0 pair with each other, those of sides 1 and 2 only across.
    """
    u, v, rest = [], [], None

    def small(s, e, g, c, f, k) -> None:
        for d in range(1, SMALL):
            a, b = slice(None, -d), slice(d, None)
            same = s[b] == s[a]
            if not same.any():
                break
            i = np.flatnonzero(same & (g[b] != g[a]) & ((e[b] == 0) | (e[b] != e[a])))
            i = i[partenum.may_link((s[i] & 1) == 1, f[i], f[i + d], k[i], k[i + d])]
            u.append(c[i])
            v.append(c[i + d])

    def large(s, e, g, c, f, k) -> None:
        names, many = np.unique(g, return_counts=True)
        if len(names) < 2:
            return
        outside = np.flatnonzero(g != names[many.argmax()])
        for i in outside.tolist():
            ok = np.flatnonzero((g != g[i]) & ((e == 0) | (e != e[i])))
            ok = ok[partenum.may_link(np.full(len(ok), (s[i] & 1) == 1), np.full(len(ok), f[i]), f[ok], k[i : i + 1], k[ok])]
            u.append(np.full(len(ok), c[i]))
            v.append(c[ok])

    def bucketed(cols: list[np.ndarray]) -> None:
        s = cols[0]
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        many = np.diff(np.append(begin, len(s)))
        few = np.repeat(many <= SMALL, many)
        if few.any():
            small(*(x[few] for x in cols))
        for i in np.flatnonzero(many > SMALL).tolist():
            large(*(x[begin[i] : begin[i] + many[i]] for x in cols))

    for batch in batches:
        cols = [*(batch.column(i).to_numpy() for i in range(5)), _sketches(batch.column(5))]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
        rest = [x[cut:] for x in cols]
        if cut:
            bucketed([x[:cut] for x in cols])
        if sum(map(len, u)) >= PAIRS:
            yield _distinct(u, v)
            u, v = [], []
    if rest is not None:
        bucketed(rest)
    if u:
        yield _distinct(u, v)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = np.array([differing(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.int64)
        n = (batch.column(4).to_numpy() & partenum.FULL) + (batch.column(5).to_numpy() & partenum.FULL)
        ok = pa.array(((OF + LINK) * least <= (OF - LINK) * n) | (n >= partenum.FULL))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ok = pa.array([_linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])


def _tested(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The links among the pairs (u, v)."""

    def of(end: str, *names: str) -> DataFrame:
        return classes.select(F.col("cls").alias(end), *(F.col(n).alias(f"{n}_{end}") for n in names))

    likely = pairs.join(of("v", "parity", "facts"), "v").join(of("u", "parity", "facts"), "u").select("u", "v", "parity_u", "parity_v", "facts_u", "facts_v").mapInArrow(_near, "u long, v long")
    return written(likely.join(of("v", "shingles"), "v").join(of("u", "shingles"), "u").select("u", "v", "shingles_u", "shingles_v").mapInArrow(_verify, "u long, v long"), "links")


def linked_classes(source: DataFrame, seen: DataFrame) -> DataFrame:
    """u, v: links between classes (keys) that, with all the others, give the components of the link graph."""
    parts = max(partitions(source.sparkSession), 1)
    alive = written(tally.returned(seen, _alive, ALIVE, parts), "alive")
    classes = _classes(_live_sets(source, alive), parts)

    signed = classes.select("cls", "facts", "sketch", "shingles", "kinds").mapInArrow(_sign, "sig long, cls long, facts long, sketch binary").select("sig", "facts", "cls", "sketch")
    found = written(signed.repartition(parts, "sig").sortWithinPartitions("sig", "facts", "cls").mapInArrow(_stars, "u long, v long, size long"), "stars")
    links = _tested(found.filter("size is null").select("u", "v").distinct(), classes)
    large = found.filter("size is not null").select(F.col("u").alias("sig"), F.ceil(F.col("size") / HELD).cast("int").alias("blocks"))

    labels = components(links).select(F.col("vertex").alias("cls"), F.col("component").alias("comp"))
    named = classes.join(labels, "cls", "left").select("cls", "facts", "sketch", "shingles", "kinds", F.coalesce("comp", "cls").alias("comp"))
    again = named.mapInArrow(_sign, "sig long, cls long, facts long, sketch binary, comp long").withColumn("side", F.lit(0))
    if not large.isEmpty():
        # block p meets block q under a key of its own, whose last bit is the signature's
        own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        several = again.drop("side").join(large, "sig").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        p, q = F.least("own", "other"), F.greatest("own", "other")
        key = F.xxhash64("sig", p, q).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("sig").bitwiseAND(F.lit(1)))
        side = F.when(p == q, 0).when(F.col("own") == p, 1).otherwise(2)
        blocks = several.select(key.alias("sig"), "cls", "facts", "sketch", "comp", side.alias("side"))
        again = again.join(large, "sig", "left_anti").unionByName(blocks)
    dealt = again.select("sig", "side", "comp", "cls", "facts", "sketch").repartition(parts, "sig").sortWithinPartitions("sig", "comp", "cls")
    rest = dealt.mapInArrow(_across, "u long, v long, size long").select("u", "v").distinct()
    return written(links.unionByName(_tested(rest, classes)), "links")


def _keyed(docs: DataFrame, text: str, doc_id) -> DataFrame:
    return docs.select(doc_id.alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_key"))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    source = _keyed(docs, text, docs[doc_id].cast("long"))
    seen = _seen(source, max(partitions(docs.sparkSession), 1))
    rows = seen.filter(F.col("kind") == tally.PASS).select("doc_id", F.col("n").alias("n_shingles"), "cls")
    labels = components(linked_classes(source, seen))
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = classes.join(labels.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(names, "component").select("cls", "component_id")
    out = full.join(of, "cls").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Exactly one row of ``docs`` of each component, with the smallest doc_id (null last); documents with empty sets stay.

    A row is known by its doc_id and text, so rows that repeat a doc_id, or have none, stay or go as their texts say. Rows
    that are alone in their component pass where they are; only those that a Bloom filter holds of the others' keys are
    written and looked up.
    """
    number = docs[doc_id].cast("long")
    marked = docs.select(F.xxhash64(number, docs[text]).alias("key"), number.alias("id"), docs[text].cast("string").alias("text"), whole_row(docs).alias("whole"))
    source = _keyed(marked, "text", F.col("key"))
    seen = _seen(source, max(partitions(docs.sparkSession), 1))
    labels = components(linked_classes(source, seen))
    ids = marked.select("key", "id").distinct()
    rows = seen.filter((F.col("kind") == tally.PASS) & (F.col("n") > 0)).groupBy(F.col("doc_id").alias("key"), "cls").agg(F.count(F.lit(1)).alias("times"))
    rows = written(rows.join(ids, "key"), "rows")
    firsts = rows.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    named = firsts.join(labels.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    tops = named.groupBy("component").agg(F.min("first").alias("top"))
    top = named.join(tops, "component").select("cls", F.col("top.key").alias("top"), F.col("top.id").alias("top_id"))
    decided = rows.join(top, "cls").withColumn("stays", (F.col("key") == F.col("top")) & F.col("id").eqNullSafe(F.col("top_id")))
    # rows that go, and those equal in doc_id and text of which one is to stay
    touched = written(decided.filter("not stays or times > 1").select("key", "id", "stays"), "near")
    hit = repeats.probe(_members(touched.select("key")), lambda k: _two(k.to_numpy(zero_copy_only=False)))
    probed = marked.select("key", "id", "whole").withColumn("maybe", hit("key"))
    held = written(probed.filter("maybe").drop("maybe").withColumn("rid", F.monotonically_increasing_id()), "held")
    other = touched.select(F.col("key").alias("other_key"), F.col("id").alias("other_id"), "stays")
    met = held.select("key", "id", "rid").join(other, (F.col("key") == F.col("other_key")) & F.col("id").eqNullSafe(F.col("other_id")), "left")
    once = met.filter("stays").groupBy("key", "id").agg(F.min("rid").alias("rid")).select("rid")
    stay = met.filter("stays is null").select("rid").unionByName(once)
    return probed.filter(~F.col("maybe")).select("whole.*").unionByName(held.join(stay, "rid", "left_semi").select("whole.*"))
