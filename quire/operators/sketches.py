"""Parity sketches of bags of words, and the comparison of bags themselves; numpy kernels behind ``similarity``.

An element is a word with its number so far (the second "the" is another element than the first). A sketch has a bit for
each bucket of a hash of elements: whether an odd number of them fell there. An element that two bags share changes the
same bit of both, so their sketches never differ in more bits than the bags differ in elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Similarities are compared as whole ten-thousandths.
UNIT = 10_000
#: Bits of a sketch for each element, at least; a power of two of 64-bit words is taken.
BITS = 2
#: Characters of bags that are sketched at a time, pairs whose bits are counted at a time, words of sketches in a gather.
CHARS, CELLS, GATHER = 4 << 20, 1 << 15, 1 << 18


def _elements(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of bags (sorted words joined by blanks): where each begins, per element its word's code and its number, the words by code."""
    lists = pc.split_pattern(bags, " ")
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    coded = pc.dictionary_encode(lists.flatten())
    codes = np.asarray(coded.indices).astype(np.int64)
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[starts[:-1]] = True
    place = np.arange(len(codes))
    return starts, codes, place - np.maximum.accumulate(np.where(new, place, 0)), coded.dictionary


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sketched(bags: pa.Array) -> pa.Array:
    """A sketch per bag: for n elements the least power of two of 64-bit words with BITS x n bits."""
    starts, codes, numbers, words = _elements(bags)
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)
    hashes = _mixed(hashes[codes] + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sizes = np.diff(starts)
    width = 1 << np.ceil(np.log2(-(-sizes * BITS // 64))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    bit = hashes & np.repeat((width * 64 - 1).astype(np.uint64), sizes)
    out = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(out, np.repeat(base[:-1], sizes) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    offsets = pa.py_buffer((base * 8).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bags), [None, offsets, pa.py_buffer(out)])


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about CHARS bytes of ``column``, at least one row."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch[column])).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHARS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _strata(sketches: pa.Array) -> list[tuple[int, int, np.ndarray]]:
    """First, last + 1 and a matrix of words for each run of sketches of one width."""
    sketches = sketches.cast(pa.large_binary())
    offsets = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset : sketches.offset + len(sketches) + 1]
    data = np.frombuffer(sketches.buffers()[2], np.uint8)
    width = np.diff(offsets) // 8
    cuts = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(width)]
    return [(a, b, data[offsets[a] : offsets[b]].copy().view(np.uint64).reshape(b - a, -1)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """The sketches that the same bags have at a smaller width."""
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, width), axis=1)


def near(n_l: np.ndarray, left: pa.Array, n_r: np.ndarray, right: pa.Array, least: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of all pairs whose sketches do not rule out a similarity of ``least`` ten-thousandths.

    Both sides are sorted by their numbers of elements. With ``same`` they are one, and each pair of different places
    is made once.
    """
    l_strata = _strata(left)
    r_strata = l_strata if same else _strata(right)
    for a0, a1, a in l_strata:
        for b0, b1, b in r_strata:
            if same and b0 < a0:
                continue
            width = min(a.shape[1], b.shape[1])
            for i, j in _near(_folded(a, width), _folded(b, width), n_l[a0:a1], n_r[b0:b1], least, same and a0 == b0):
                yield i + a0, j + b0


def _near(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    # Bags of n and m elements differ in at most (n + m) (1 - least) of them, which is at most one more than n's and m's parts.
    part_a, part_b = n_a * (UNIT - least) // UNIT, n_b * (UNIT - least) // UNIT
    half = max(1, a.shape[1] // 2)
    # Half the width rules out most pairs.
    rough_a, rough_b = np.ascontiguousarray(_folded(a, half).T), np.ascontiguousarray(_folded(b, half).T)
    kind = np.int16 if half * 64 + max(part_a.max(), part_b.max()) + 1 < 1 << 15 else np.int32
    part_b = part_b.astype(kind)
    cols = min(4096, len(b))
    rows = max(1, CELLS // cols)
    words, bits, some, total = (np.empty(rows * cols, t) for t in (np.uint64, np.uint8, np.uint8, kind))
    low, high = n_b * (2 * UNIT - least), n_b * least
    for r0 in range(0, len(a), rows):
        r1 = min(len(a), r0 + rows)
        first = int(np.searchsorted(low, n_a[r0] * least))
        last = int(np.searchsorted(high, n_a[r1 - 1] * (2 * UNIT - least), side="right"))
        if same:
            first = max(first, r0 + 1)
        most = (part_a[r0:r1] + 1).astype(kind)[:, None]
        for c0 in range(first, last, cols):
            c1 = min(last, c0 + cols)
            shape, size = (r1 - r0, c1 - c0), (r1 - r0) * (c1 - c0)
            x, p, s, t = (z[:size].reshape(shape) for z in (words, bits, some, total))
            t[:] = -part_b[c0:c1]
            for w in range(half):
                np.bitwise_xor(rough_a[w, r0:r1, None], rough_b[w, None, c0:c1], out=x)
                if w % 3:  # three words have at most 192 bits
                    np.bitwise_count(x, out=p)
                    np.add(s, p, out=s)
                else:
                    np.bitwise_count(x, out=s)
                if w % 3 == 2 or w == half - 1:
                    np.add(t, s, out=t)
            i, j = np.nonzero(t <= most)
            i, j = i + r0, j + c0
            if same:
                i, j = i[i < j], j[i < j]
            step = max(1, GATHER // a.shape[1])
            for k in range(0, len(i), step):
                x_i, x_j = i[k : k + step], j[k : k + step]
                apart = np.bitwise_count(a[x_i] ^ b[x_j]).sum(axis=1, dtype=np.int64)
                apart = np.maximum(apart, np.abs(n_a[x_i] - n_b[x_j]))
                ok = apart * UNIT <= (n_a[x_i] + n_b[x_j]) * (UNIT - least)
                if ok.any():
                    yield x_i[ok], x_j[ok]


class Bags:
    """The elements of bags under numbers of their own, to count what pairs share."""

    def __init__(self, bags: pa.Array):
        self.starts, codes, numbers, words = _elements(bags)
        most = np.zeros(len(words), np.int64)
        np.maximum.at(most, codes, numbers + 1)
        first = np.concatenate([[0], np.cumsum(most)])
        self.elements = (first[codes] + numbers).astype(np.int32 if first[-1] < 1 << 31 else np.int64)
        self.mark = np.zeros(first[-1], bool)

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many elements the bags at two places share; pairs of one left bag stand together."""
        out = np.empty(len(left), np.int64)
        cuts = [0, *(np.flatnonzero(left[1:] != left[:-1]) + 1).tolist(), len(left)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = self.elements[self.starts[left[a]] : self.starts[left[a] + 1]]
            self.mark[own] = True
            sizes = self.starts[right[a:b] + 1] - self.starts[right[a:b]]
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            theirs = self.elements[np.repeat(self.starts[right[a:b]] - at, sizes) + np.arange(sizes.sum())]
            out[a:b] = np.add.reduceat(self.mark[theirs], at, dtype=np.int64)
            self.mark[own] = False
        return out
