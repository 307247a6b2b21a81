"""Words of a whole batch of texts found in its UTF-8 bytes at once, and their hashes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes hashed at a time; a longer word is a block of its own.
BLOCK = 1 << 16


def folding(*separators: tuple[int, int]) -> np.ndarray:
    """A byte's value in a word, with A-Z in lower case, or 0 if it is in one of the ranges that part words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for first, last in separators:
        table[first : last + 1] = 0
    return table


#: Words of letters, and of letters and digits; every byte of a character beyond ASCII belongs to a word.
LETTERS = folding((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
ALPHANUMERICS = folding((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Words of all but blanks, as they are; a zero byte, which parts no words here, stands as a byte that UTF-8 does not have.
NONBLANKS = np.arange(256, dtype=np.uint8)
NONBLANKS[[*range(0x09, 0x0E), 0x20]] = 0
NONBLANKS[0] = 0xFF


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, b)])) for b in (BASE, inverse))


class Words:
    """The words of a column of texts: ``start`` and ``end`` in ``data``, the column's folded bytes, in which every text is
    followed by a separator; ``first`` has the number of words before each text and ``raw`` the bytes as they were. Null counts
    as empty."""

    def __init__(self, column: pa.Array, fold: np.ndarray):
        texts = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), ""), *(pa.scalar(x, pa.large_string()) for x in ("\n", "")))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0]) if len(texts) else 0
        self.raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
        self.data = fold[self.raw]
        inside = np.zeros(size + 1, np.int8)
        inside[1:] = self.data != 0
        change = np.flatnonzero(np.diff(inside))
        self.start, self.end = change[::2], change[1::2]
        self.offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The place of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The number, among all lines of all texts, of the line that each word is in, and of each text's first line."""
        ends = np.flatnonzero(self.raw == 10)
        return np.searchsorted(ends, self.start), np.searchsorted(ends, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from sums of its bytes times powers of a base, in blocks."""
        power, inverse = _powers()
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            low = int(self.start[at])
            upto = max(at + 1, int(np.searchsorted(self.end, low + BLOCK, "right")))
            high = int(self.end[upto - 1])
            if high - low <= BLOCK:
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(self.data[low:high] * power[: high - low], out=sums[1:])
                start, end = self.start[at:upto] - low, self.end[at:upto] - low
                out[at:upto] = (sums[end] - sums[start]) * inverse[start]
            else:  # one long word, a block of it at a time
                total, scale = 0, 1
                for place in range(low, high, BLOCK):
                    part = self.data[place : min(place + BLOCK, high)]
                    total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * scale
                    scale = scale * int(power[BLOCK]) % (1 << 64)
                out[at] = np.uint64(total % (1 << 64))
            at = upto
        return (out ^ (out >> np.uint64(29))) * MIX

    def joined(self, low: np.ndarray, high: np.ndarray) -> pa.Array:
        """The words from number ``low`` to before ``high``, joined by single spaces, for each such range."""
        length = self.end - self.start
        at = np.concatenate([[0], np.cumsum(length + 1)])
        ended = np.zeros(len(self.data), bool)
        ended[self.end] = True
        plain = np.where(ended, np.uint8(32), self.data)[ended | (self.data != 0)]
        sizes = np.where(high > low, at[high] - at[low] - 1, 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - at[low], sizes)
        data = pa.py_buffer(plain[index].tobytes())
        array = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64).tobytes()), data)
        return array.cast(pa.string())
