"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes ends a chunk where its low bits are zero, so the same passage gives the
same chunks in every document. A counting Bloom filter tells which chunk keys may occur twice. Documents without such a
chunk are encoded where they are read; of the others, each repeated chunk is encoded once, its ids are joined to the
documents that hold it, and the rest of the document is encoded in place.

Ids of neighbouring parts are then repaired at the join: the words around it are encoded again, first those next to the
join and then one more on either side, until the ids beyond the window agree with those that the parts have there
(and the window's ids with those of the next larger window). If they do not agree within either part, the two parts are
encoded again as one.

Texts that stand several times in a run of rows, as a mix with repeats puts them, are encoded once there and count once
for the filter.

A null text counts as empty and has no ids. Documents keep their rows: repeated rows give repeated results, whatever
their doc_id. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .shared import written
from .tokens import Encoder, encoder, slices

#: Bytes that the rolling hash sees, mean and least length of a chunk.
WINDOW, MEAN, LEAST = 32, 512, 96
SEED = 20_000
MASK = np.uint32((MEAN - 1) << 20)

RESULT = "doc_id long, ids array<int>, decoded string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
Finish = Callable[[pa.Array, np.ndarray, np.ndarray, Encoder], pa.RecordBatch]


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Ends of chunks in a run of bytes: where the hash of the last 32 bytes has MASK's bits zero.

    The hash of the last w bytes, each scrambled and shifted by its distance, is built by doubling w.
    """
    table = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
    h = table[raw]
    w = 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    return np.flatnonzero((h & MASK) == 0) + 1


def chunk_ends(texts: pa.Array) -> list[list[int]]:
    """Byte ends of the chunks of each text, the last one at the text's end; never inside a character."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    points = cut_points(raw) if len(raw) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        ends, last = [], a
        # a window that reaches back over the text's start would see another text
        for p in points[np.searchsorted(points, a + WINDOW) : np.searchsorted(points, b)].tolist():
            while p < b and raw[p] & 0xC0 == 0x80:
                p += 1
            if p - last >= LEAST and p < b:
                ends.append(p - a)
                last = p
        if b > a:
            ends.append(b - a)
        out.append(ends)
    return out


def _keyed(texts: pa.Array) -> tuple[list[bytes], list[list[int]], np.ndarray, np.ndarray]:
    """Texts as bytes, their chunk ends, and the two halves of all chunk keys in order."""
    ends = chunk_ends(texts)
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    keys = [xxhash.xxh3_128_digest(t[a:b]) for t, es in zip(raw, ends, strict=True) for a, b in zip([0, *es], es)]
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return raw, ends, both[:, 0].copy(), both[:, 1].copy()


SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def _last_words(text: bytes, n: int) -> int:
    """Where the last n words of a text begin, after white space (the last one may be empty); -1 if it has fewer."""
    for start in (max(0, len(text) - 64 * n), 0):
        starts = [m.end() for m in SPACES.finditer(text, start)]
        if len(starts) >= n:
            return starts[-n]
    return -1


def _first_words(text: bytes, n: int) -> int:
    """Where the first n words of a text end, at white space (the first one may be empty); -1 if it has fewer."""
    for i, m in enumerate(SPACES.finditer(text), 1):
        if i == n:
            return m.start()
    return -1


Encode = Callable[[bytes], np.ndarray]


def repair(left: bytes, left_ids: np.ndarray, right: bytes, right_ids: np.ndarray, encode: Encode, most: int = 8) -> tuple[int, np.ndarray, int, int] | None:
    """How to join two parts: ids of ``left`` to keep, ids of the window, ids of ``right`` to skip, bytes of it that these cover.

    The window grows by a word on either side until the parts' ids agree with it and two windows in a row agree. None:
    there was no agreement.
    """
    last = None
    for words in range(1, most + 1):
        a, b = _last_words(left, words), _first_words(right, words)
        if a < 0 or b < 0:
            return None
        tail, head = encode(left[a:]), encode(right[:b])
        keep, skip = len(left_ids) - len(tail), len(head)
        if keep < 0 or not np.array_equal(left_ids[keep:], tail) or not np.array_equal(right_ids[:skip], head):
            continue
        window = encode(left[a:] + right[:b])
        if last and np.array_equal(window, np.concatenate([left_ids[keep : last[0]], last[1], right_ids[last[2] : skip]])):
            return last
        last = (keep, window, skip, b)
    return None


def assemble(text: bytes, ends: list[int], known: dict[int, np.ndarray], encode: Encode) -> np.ndarray:
    """Ids of a text of which some chunks' ids are known, by chunk number: the rest is encoded in runs, joins are repaired."""
    parts: list[tuple[int, int, np.ndarray | None]] = []
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        if i not in known and parts and parts[-1][2] is None:
            parts[-1] = (parts[-1][0], b, None)
        else:
            parts.append((a, b, known.get(i)))
    settled: list[np.ndarray] = []
    begin, open_ids = 0, np.zeros(0, "<u4")  # the text from ``begin`` on has the ids ``open_ids``
    for k, (a, b, ids) in enumerate(parts):
        ids = encode(text[a:b]) if ids is None else ids
        if k == 0:
            open_ids = ids
        elif found := repair(text[begin:a], open_ids, text[a:b], ids, encode):
            keep, window, skip, covered = found
            settled += [open_ids[:keep], window]
            begin, open_ids = a + covered, ids[skip:]
        else:
            open_ids = encode(text[begin:b])
    return np.concatenate([*settled, open_ids])


def raw_result(doc_id: pa.Array, ids: np.ndarray, at: np.ndarray, enc: Encoder) -> pa.RecordBatch:
    """doc_id, ids and decoded text."""
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([doc_id, lists, enc.decode_arrow(ids, at)], schema=RESULT_ARROW)


def _once(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct texts of a run of rows, and which of them each row has."""
    coded = pc.fill_null(texts, "").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _for_ids(made: pa.RecordBatch, doc_id: pa.Array) -> pa.RecordBatch:
    """Result rows under these doc_ids, the first column."""
    return pa.RecordBatch.from_arrays([doc_id, *made.columns[1:]], schema=made.schema)


def round_trip(docs: DataFrame, tokenizer: str, finish: Finish = raw_result, schema: str = RESULT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes and decodes every document. ``finish`` turns (doc_ids, flat ids, offsets, encoder) into result rows, doc_id first."""
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _keyed(batch.column("text").unique())[2:]

    bitmap, bits = repeats.build(source.select("text"), keys, max(1, 2 * size // MEAN))

    def flagged(texts: pa.Array):
        raw, ends, hi, lo = _keyed(texts)
        maybe = repeats.maybe_repeated(bitmap.value, bits, hi, lo) if len(hi) else np.zeros(0, bool)
        n = np.array([len(e) for e in ends], np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        counts = np.concatenate([[0], np.cumsum(maybe)])
        return ends, maybe, at, counts[at[1:]] > counts[at[:-1]], hi, lo

    def unshared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole):
                texts, of = _once(batch.column("text"))
                shared = flagged(texts)[3]
                own = np.flatnonzero(~shared)
                if len(own):
                    made = finish(pa.array(own), *enc.encode_arrow(texts.take(pa.array(own))), enc)
                    at = np.full(len(texts), -1)
                    at[own] = np.arange(len(own))
                    rows = np.flatnonzero(~shared[of])
                    yield _for_ids(made.take(pa.array(at[of[rows]])), batch.column("doc_id").take(pa.array(rows)))

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts, of = _once(batch.column("text"))
                ends, maybe, at, shared, hi, lo = flagged(texts)
                rows = np.flatnonzero(shared).tolist()
                if not rows:
                    continue
                signed = np.stack([hi, lo]).view(np.int64)
                chunks = [
                    [{"no": k - at[r], "from_byte": ends[r][k - at[r] - 1] if k > at[r] else 0, "to_byte": ends[r][k - at[r]], "hi": signed[0, k], "lo": signed[1, k]} for k in range(at[r], at[r + 1]) if maybe[k]]
                    for r in rows
                ]
                kind = pa.list_(pa.struct([("no", pa.int32()), ("from_byte", pa.int32()), ("to_byte", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())]))
                order = np.argsort(of, kind="stable")
                begin = np.searchsorted(of[order], np.arange(len(texts) + 1))
                doc_ids = batch.column("doc_id").take(pa.array(order)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_ids[begin[r] : begin[r + 1]] for r in rows], pa.list_(pa.int64())), texts.take(pa.array(rows)), pa.array([ends[r] for r in rows], pa.list_(pa.int32())), pa.array(chunks, kind)],
                    names=["doc_ids", "text", "ends", "chunks"],
                )

    pending = written(
        source.mapInArrow(shared_only, "doc_ids array<long>, text string, ends array<int>, chunks array<struct<no:int,from_byte:int,to_byte:int,hi:long,lo:long>>")
        .withColumn("row", F.monotonically_increasing_id()),
        "pending",
    )
    places = pending.select("row", "text", F.explode("chunks").alias("c")).select("row", "c.*", F.expr("substring(cast(text as binary), c.from_byte + 1, c.to_byte - c.from_byte)").alias("piece"))
    pieces = places.groupBy("hi", "lo").agg(F.any_value("piece").alias("piece"), F.count(F.lit(1)).alias("n"))

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids, at = enc.encode_arrow(batch.column("piece"))
            own = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("hi"), batch.column("lo"), pa.array(own, pa.binary())], names=["hi", "lo", "ids"])

    # a chunk that only the filter took for repeated is encoded with its document
    once = written(pieces.filter("n > 1").drop("n").mapInArrow(encode_pieces, "hi long, lo long, ids binary"), "chunks")
    placed = places.drop("piece").join(once, ["hi", "lo"]).groupBy("row").agg(F.collect_list(F.struct("no", "ids")).alias("known"))
    joined = pending.drop("chunks").join(placed, "row", "left").select("doc_ids", "text", "ends", "known")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)

        def one(piece: bytes) -> np.ndarray:
            return enc.encode_arrow(pa.array([piece], pa.large_binary()))[0]

        for whole in batches:
            for batch in slices(whole):
                out = []
                for text, ends, known in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("ends").to_pylist(), batch.column("known").to_pylist(), strict=True):
                    out.append(assemble(text, ends, {k["no"]: np.frombuffer(k["ids"], "<u4") for k in known or ()}, one))
                at = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int64)
                made = finish(pa.array(np.arange(len(out))), np.concatenate(out) if out else np.zeros(0, "<u4"), at, enc)
                doc_ids = batch.column("doc_ids")
                yield _for_ids(made.take(doc_ids.value_parent_indices()), doc_ids.flatten())

    return source.mapInArrow(unshared, schema).unionByName(joined.mapInArrow(rebuild, schema))


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of arrays of ids; a null array has an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), enc.decode_arrow(flat, at)], names=["doc_id", "text"])

    return tokens.select(tokens[doc_id].cast("long").alias("doc_id"), tokens[ids].alias("ids")).mapInArrow(run, "doc_id long, text string")
