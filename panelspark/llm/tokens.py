"""Token ids of a public word-level BPE tokenizer, by distinct words.

The tokenizer drops white space and never joins characters across it, so a text's ids are those of its runs between
ASCII white space, one after another. Each distinct run is encoded once per worker by the tokenizers library, within a
cache of bounded size (two generations of ``CACHE_RUNS``), and the ids of a text are joined from there.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_RUNS = 450_000
END_MARK = "</w>"

#: Letters whose lower case and normal form are the same for Python and the tokenizer: a run of them is one piece.
LETTERS = re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u0148\u014A-\u017E]+")
#: ASCII marks that follow letters as a piece of their own (an apostrophe may begin a contraction).
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Byte-level models name a byte by its Latin-1 character if that is visible, and else by the next one from 256 on.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = dict(zip([b for b in range(256) if b not in VISIBLE], range(256, 512), strict=False))


class Runs(dict):
    """Ids by run. When it is full, its entries become those of the older generation of a new one."""

    def __init__(self, of_run: Callable[[bytes], bytes], older: Runs | None = None):
        super().__init__()
        self.of_run = of_run
        self.older = dict(older) if older else {}

    def full(self) -> bool:
        return len(self) > CACHE_RUNS

    def __missing__(self, run: bytes) -> bytes:
        ids = self[run] = self.older.get(run) or self.of_run(run)
        return ids


class Encoder:
    """Ids of texts, and texts of ids, for one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        names = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.ends = np.array([n.endswith(END_MARK) for n in names])
        self.names = pa.array(names, pa.string())
        self.numbers = pa.array([str(i) for i in range(len(names))], pa.string())
        self.tokenize = self.whole.model.tokenize
        self.runs = Runs(self._of_run)

    def _of_run(self, run: bytes) -> bytes:
        """Ids of one run, as little-endian 32-bit integers: words of letters by the bare model, all else by the whole tokenizer."""
        if run.isalpha():
            ids = [t.id for t in self.tokenize(run.lower().decode())]
        else:
            text = run.decode()
            head = text.rstrip(MARKS)
            if head and head != text and LETTERS.fullmatch(head):
                return self.runs[head.encode()] + self.runs[text[len(head) :].encode()]
            if LETTERS.fullmatch(text):
                ids = [t.id for t in self.tokenize(text.lower().encode().decode("latin-1").translate(BYTE_NAMES))]
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, flat, and where each text's ids begin (one more offset than texts). Null is empty."""
        each = []
        for t in texts.cast(pa.large_binary()).to_pylist():
            if t and b"<|" not in t:  # where no special token can stand, ASCII case does not matter
                t = t.lower()
            if self.runs.full():
                self.runs = Runs(self._of_run, self.runs)
            each.append(b"".join(map(self.runs.__getitem__, t.split())) if t else b"")  # bytes split at ASCII white space only
        at = np.zeros(len(each) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) // 4, out=at[1:])
        return np.frombuffer(b"".join(each), "<u4"), at

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_arrow(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _joined(self, table: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), table.take(pa.array(ids, pa.uint32())))
        return pc.binary_join(lists, " ")

    def decode_arrow(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The text of each slice of ids: this tokenizer has no decoder, so tokens are joined by one blank."""
        return self._joined(self.names, ids, at)

    def decimal_arrow(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Each slice of ids in decimal, joined by one blank."""
        return self._joined(self.numbers, ids, at)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, most: int = 2_000_000) -> list[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text (its column "text") each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    if not len(size) or size[-1] <= most:
        return [batch]
    cut = np.unique(np.searchsorted(size, np.arange(most, size[-1], most)) + 1).tolist()
    ends = sorted({0, *[c for c in cut if c < len(size)], len(size)})
    return [batch.slice(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]
