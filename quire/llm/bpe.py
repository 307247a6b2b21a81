"""Byte-level BPE over whole texts: vectorised merges for new pieces, table look-ups for seen ones."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, texts_in

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces remembered in a worker; beyond it the table starts anew, so memory stays bounded.
REMEMBERED = 1 << 18
#: Text or ids that a worker handles at a time.
CELL_BYTES = 2 << 20
#: Bytes of a piece beyond which it is a matrix of its own, whose rounds merge all places of the leftmost minimum-rank pair.
LONG = 1024

# White space and the letters and numbers below U+02B0, as the public pattern's classes have them.
SPACE = "\t-\r \x85\xa0"
MORE_SPACE = SPACE + "  -     　"
LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"


def _pattern(engine, space: str, letter: str, number: str):
    return engine.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


LATIN = _pattern(re, SPACE, LETTER, NUMBER)
ANY = _pattern(regex, MORE_SPACE, r"\p{L}", r"\p{N}")
BEYOND_LATIN = re.compile("[^\x00-ʯ]")


def pieces(text: str) -> list[str]:
    """The matches of the public pattern; texts of Latin letters take the faster engine with the same classes."""
    return (ANY if BEYOND_LATIN.search(text) else LATIN).findall(text)


def rank_tokens(path: str) -> list[bytes]:
    """Token bytes by id, from a rank file."""
    with open(path, "rb") as file:
        found = dict((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
    return [found[i] for i in range(len(found))]


class Merger:
    """Merges of many pieces at once.

    Pieces of like length are rows of a padded matrix. Each round every row merges its leftmost pair of minimum rank, found
    through a hashed pair table, and the row closes its gap; rows without a mergeable pair leave. A piece of over ``LONG``
    bytes is alone in its matrix, and a round also merges the pair's later places that do not overlap: they would be the
    next rounds' choices, because a token's parts have smaller ranks than the token in every trained vocabulary.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ids[t[:k]], ids[t[k:]]): i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, self.NONE)
        place, left, self.probes = self._hash(keys), np.arange(len(keys)), 0
        while len(left):  # each round, one of the keys that want a free slot gets it; the rest move on
            self.probes += 1
            free = self.keys[place] == np.uint64(2**64 - 1)
            self.keys[place[free]] = keys[left[free]]
            won = self.keys[place] == keys[left]
            self.ranks[place[won]] = ranks[left[won]]
            left, place = left[~won], (place[~won] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = self._hash(keys)
        found = np.where(self.keys[place] == keys, self.ranks[place], self.NONE)
        open_ = np.flatnonzero((self.keys[place] != keys) & (self.keys[place] != np.uint64(2**64 - 1)))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (place[open_] + step) & ((1 << self.bits) - 1)
            here = self.keys[at]
            found[open_] = np.where(here == keys[open_], self.ranks[at], self.NONE)
            open_ = open_[(here != keys[open_]) & (here != np.uint64(2**64 - 1))]
        return found

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        valid = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        out = np.full(valid.shape, self.NONE)
        out[valid] = self.rank(ids[:, :-1][valid], ids[:, 1:][valid])
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and their counts."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        counts = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # rows and their padded ids
        for row in np.flatnonzero(lengths > LONG):
            ids = self._long(flat[starts[row] : starts[row] + lengths[row]])
            counts[row] = len(ids)
            done.append((np.array([row]), ids[None]))
        for width in sorted({1 << int(n - 1).bit_length() for n in lengths.tolist() if 0 < n <= LONG}):
            bucket = np.flatnonzero((lengths <= min(width, LONG)) & (lengths > width // 2))
            for part in np.array_split(bucket, max(1, len(bucket) * width >> 20)):
                if len(part):
                    self._bucket(part, flat, starts, lengths, width, counts, done)
        out = np.empty(int(counts.sum()), np.int32)
        begin = np.cumsum(counts) - counts
        for rows, ids in done:
            valid = ids >= 0
            out[(begin[rows][:, None] + np.arange(ids.shape[1]))[valid]] = ids[valid]
        return out, counts

    def _long(self, ids: np.ndarray) -> np.ndarray:
        ids = ids.copy()
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks):
            lowest = ranks.min()
            if lowest == self.NONE:
                break
            at = np.flatnonzero(ranks == lowest)
            begins = np.diff(at, prepend=-2) > 1  # in a run of overlapping places, every second one from its left end
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))) % 2 == 0]
            ids[at] = lowest
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            at = at - np.arange(len(at))
            for k in (at - 1, at):
                k = k[(k >= 0) & (k < len(ranks))]
                ranks[k] = self.rank(ids[k], ids[k + 1])
        return ids

    def _bucket(self, rows, flat, starts, lengths, width, counts, done) -> None:
        at = np.arange(width)
        inside = at < lengths[rows][:, None]
        ids = np.where(inside, flat[np.minimum(starts[rows][:, None] + at, len(flat) - 1)], -1)
        ranks = self._ranks(ids)
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            lowest = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), self.NONE)
            over = lowest == self.NONE
            if over.any():
                counts[rows[over]] = (ids[over] >= 0).sum(axis=1)
                done.append((rows[over], ids[over]))
                rows, ids, ranks, best, lowest = rows[~over], ids[~over], ranks[~over], best[~over], lowest[~over]
            if not len(rows):
                return
            each = np.arange(len(rows))
            ids[each, best] = lowest
            keep = np.ones(ids.shape, bool)
            keep[each, best + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            ranks = ranks[keep[:, 1:]].reshape(len(rows), -1)  # a row drops the rank of the pair it merged
            if not ranks.shape[1]:
                continue
            for k in (best - 1, best):
                ok = (k >= 0) & (k < ranks.shape[1])
                r, c = each[ok], k[ok]
                a, b = ids[r, c], ids[r, c + 1]
                real = (a >= 0) & (b >= 0)
                new = np.full(len(r), self.NONE)
                new[real] = self.rank(a[real], b[real])
                ranks[r, c] = new


class Places(dict):
    """Place of every piece met so far; a new piece gets the next one."""

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        return place


class Memo:
    """Ids of every piece met so far in this worker, as one flat table; ``encode`` gives those of new pieces."""

    def __init__(self, encode, limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index = Places()
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, new: Iterable[str]) -> None:
        flat, counts = self.encode([p.encode() for p in new])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat])

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's count."""
        if len(self.index) > self.limit:
            self.clear()
        found = [pieces(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        known = len(self.index)
        places = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        if len(self.index) > known:
            self.add(islice(self.index, known, None))
        counts = self.count[places]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.start[places] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(edges)


@cache
def memo(path: str | None = None) -> Memo:
    return Memo(Merger(rank_tokens(path or public_tokenizers.path(RANKS))).encode)


@cache
def token_bytes(path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes in one array, and where each token begins."""
    tokens = rank_tokens(path or public_tokenizers.path(RANKS))
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def binary_column(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Cells of one binary column from their concatenation; counts are in items of ``data``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids of the whole text as little-endian unsigned 32-bit numbers in one binary cell.

    Every match of the public pattern is merged separately and there are no special tokens. Null counts as empty and gives
    an empty cell. One row per input row; other columns are ignored. ``path`` is a rank file on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = memo(path)
        for batch in slices(batches, limit=CELL_BYTES):
            ids, counts = table.documents(texts_in(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(ids.astype("<u4"), counts)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids of each row stand for; null ids give an empty cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin = token_bytes(path)
        lengths = np.diff(begin)
        for batch in slices(batches, "ids", CELL_BYTES):
            cells = [x or b"" for x in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(cells), "<u4").astype(np.int64)
            sizes = lengths[ids]
            ends = np.cumsum(sizes)
            out = data[np.repeat(begin[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            per = np.fromiter((len(x) // 4 for x in cells), np.int64, len(cells))
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_column(out, np.diff(edges))], ["doc_id", "ids", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    both = decoded(encoded(docs, path), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
