"""PartEnum signatures of sets that link at a Jaccard similarity of 0.75.

Size bands. Band j holds the sizes from l to 4 l / 3. A set signs in its own band and in the next one, so two sets that
can link sign in one band together. There they differ in at most k = 2/7 of the band's largest size.

First level: the hash domain falls into n1 partitions, and n1 is ``SLACK`` (k + 1) / 2. If two sets differ in at most k
elements, no more than k // 2 partitions hold two differences; n1 - k // 2 or more, the good ones, hold one or none.
Second level: each partition falls into three cells, and every two of these are enumerated as a subset. One difference
spoils one cell, so in a good partition the sets agree on a subset. A signature is a subset's content with its place.

Content. Elements come in three kinds: own ones (no other set has them), rare ones (fewer than ``FREQUENT`` sets) and
frequent ones. A subset with an own element can agree with nothing and is left out. One with a rare element is strong:
fewer than ``FREQUENT`` sets share it. The others, empty ones included, are weak. A set is safe if its
partitions with a weak subset are fewer than the good ones: then it agrees with each linked set on a strong subset, and
needs no weak one. What is left are pairs of unsafe sets:

- If such a pair shares a rare element, that element tells: unsafe sets sign each of their rare elements.
- If not, all rare and own elements of both count as differences. There are at most (|r| + |s|) / 7, hence at most a
  third of each set. Only such unsafe sets sign their weak subsets that are not empty.
- Empty subsets are never signed. A set whose partitions with an empty subset are as many as the good ones signs
  frequent elements instead, one by one: in the order of their hashes the first n / 3 + 1 of both sets have one in common.

So no link is lost, strong buckets are bounded, and weak ones hold sets that consist of frequent elements for two
thirds at least and share some of them.

``may_link`` rules pairs out: own elements (in weak buckets: own and rare ones) are differences, and so is the
difference of the counts of the others; in weak buckets also each bit in which the parities of the frequent elements
(``sketch``) differ.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

FREQUENT = 24
SLACK = 1.3
CELLS = 3
SUBSETS = ((0, 1), (0, 2), (1, 2))
OWN, RARE, COMMON = 0, 1, 2
#: A signature's last bit tells a weak one.
WEAK = np.uint64(1)
#: Bits of a set's size and of its counts of own and rare elements in one integer; larger counts are not compared.
WIDTH = 21
FULL = (1 << WIDTH) - 1
#: Bits of the parities of frequent elements.
SKETCH = 256


def kinds(counts: np.ndarray) -> np.ndarray:
    """The kind of elements that so many sets hold."""
    return np.where(counts < 2, OWN, np.where(counts < FREQUENT, RARE, COMMON)).astype(np.uint8)


def band_starts(most: int) -> np.ndarray:
    """The least size of each band, up to the second one beyond ``most``."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 4 // 3 + 1)
    for _ in range(2):
        starts.append(starts[-1] * 4 // 3 + 1)
    return np.array(starts, np.int64)


def facts(n: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Of each set its own and rare elements, then own ones, then all, in one integer; the sets' elements lie flat in ``kind``."""
    of = np.repeat(np.arange(len(n)), n)
    own = np.bincount(of, kind == OWN, minlength=len(n)).astype(np.int64)
    rare = np.bincount(of, kind == RARE, minlength=len(n)).astype(np.int64)
    return (np.minimum(own + rare, FULL) << 2 * WIDTH) | (np.minimum(own, FULL) << WIDTH) | np.minimum(n, FULL)


def sketch(elements: np.ndarray) -> bytes:
    """Whether each of ``SKETCH`` bits was met oddly often by the elements."""
    odd = np.bincount((elements & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(weak: np.ndarray, a: np.ndarray, b: np.ndarray, sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Whether sets with the facts a and b can link, if a weak bucket has them (and they share no rare element) or a strong one.

    Sketches are rows of 64-bit words; those of strong rows are zero.
    """
    na, nb = a & FULL, b & FULL
    shift = np.where(weak, 2 * WIDTH, WIDTH)
    apart_a, apart_b = (a >> shift) & FULL, (b >> shift) & FULL
    least = apart_a + apart_b + np.maximum(np.abs((na - apart_a) - (nb - apart_b)), np.bitwise_count(sketch_a ^ sketch_b).sum(axis=1, dtype=np.int64))
    return ((7 * least <= na + nb) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb))) | (na == FULL) | (nb == FULL)


def signatures(elements: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, signature) of all sets; their elements lie flat, ascending within each set."""
    if not len(elements):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(n)), n)
    apart = np.bincount(of, kind != COMMON, minlength=len(n)).astype(np.int64)
    starts = band_starts(int(n.max()))
    own_band = np.searchsorted(starts, n, side="right") - 1
    unsafe, blank = np.zeros(len(n), bool), np.zeros(len(n), bool)
    thin = 3 * apart <= n
    sets, sigs = [], []
    spread = mixed(elements + np.uint64(1))
    for band in (own_band, own_band + 1):
        k = 2 * (starts[band + 1] - 1) // 7
        n1 = np.where(n > 0, np.ceil(SLACK * (k + 1) / 2).astype(np.int64), 0)
        base = np.cumsum(n1) - n1
        cell = (((elements >> np.uint64(32)) * (CELLS * n1[of]).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + CELLS * base[of]
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        content = np.zeros(CELLS * int(n1.sum()), np.uint64)
        content[cell[new]] = np.add.reduceat(spread, new)
        has_any, has_own, has_rare = (np.zeros(len(content), bool) for _ in range(3))
        has_any[cell] = True
        has_own[cell[kind == OWN]] = True
        has_rare[cell[kind == RARE]] = True
        content = mixed(content).reshape(-1, CELLS)
        has_any, has_own, has_rare = (v.reshape(-1, CELLS) for v in (has_any, has_own, has_rare))
        whose = np.repeat(np.arange(len(n)), n1)
        place = (band[whose].astype(np.uint64) << np.uint64(40)) | ((np.arange(len(whose)) - base[whose]).astype(np.uint64) << np.uint64(2))
        weak_part, empty_part = np.zeros(len(whose), bool), np.zeros(len(whose), bool)
        weak_rows = []
        for s, (x, y) in enumerate(SUBSETS):
            ok = ~has_own[:, x] & ~has_own[:, y]
            strong = ok & (has_rare[:, x] | has_rare[:, y])
            weak = ok & ~strong
            filled = has_any[:, x] | has_any[:, y]
            weak_part |= weak
            empty_part |= ~filled
            weak &= filled
            value = mixed(content[:, x] * np.uint64(3) + content[:, y] ^ mixed(place | np.uint64(s)))
            sets.append(whose[strong])
            sigs.append(value[strong] & ~WEAK)
            weak_rows.append((whose[weak], value[weak] | WEAK))
        risky, empty = (np.bincount(whose, part, minlength=len(n)) >= n1 - k // 2 for part in (weak_part, empty_part))
        unsafe |= risky
        blank |= empty
        for w, v in weak_rows:
            pick = (risky & thin)[w]
            sets.append(w[pick])
            sigs.append(v[pick])
    single = unsafe[of] & (kind == RARE)
    sets.append(of[single])
    sigs.append(mixed(elements[single] ^ np.uint64(0x5851F42D4C957F2D)) & ~WEAK)
    common = (blank & unsafe & thin)[of] & (kind == COMMON)
    whose = of[common]
    rank = np.arange(len(whose)) - np.searchsorted(whose, whose)  # elements ascend, so this is their place among the set's frequent ones
    first = rank <= n[whose] // 3
    sets.append(whose[first])
    sigs.append(mixed(elements[common][first] ^ np.uint64(0x14057B7EF767814F)) | WEAK)
    return np.concatenate(sets), np.concatenate(sigs)
