"""Best-fit packing of token pieces into sequences, with proven lower bounds."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import Memo
from quire.llm.common import saved, slices, texts_in

VOCABULARY, END, CAPACITY = "byte_bpe_50k.json", 2, 1024
#: Pieces packed together in one task; bytes of text encoded at a time.
SHARE, BYTES = 32_768, 2 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def json_tokens(path: str) -> list[bytes]:
    """Token bytes by id, from a tokenizer file of the byte-level kind (bytes written as printable characters)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    return [bytes(shown[c] for c in t) for t, _ in sorted(vocabulary.items(), key=lambda x: x[1])]


@cache
def memo(path: str | None = None) -> Memo:
    tokens = json_tokens(path or public_tokenizers.path(VOCABULARY))
    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})._core_bpe

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [core.encode_single_piece(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts

    return Memo(encode)


@cache
def added_tokens(path: str | None = None) -> tuple[re.Pattern, dict[str, int]]:
    """A pattern of the tokenizer's added tokens, longest first, and their ids."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        ids = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")"), ids


def token_ids(texts: list[str], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and each text's count. An added token in a text is its id, and the text before
    and behind it is encoded apart."""
    table, (marker, ids_of) = memo(path), added_tokens(path)
    if not ids_of or not any(t in x for t in ids_of for x in texts):
        return table.documents(texts)
    cut = [marker.split(t) for t in texts]
    parts = [p for c in cut for p in c[::2]]
    ids, counts = table.documents(parts)
    ends, own = np.cumsum(counts), np.array([len(c) // 2 + 1 for c in cut])
    last = np.cumsum(own)
    inner = np.ones(len(parts), bool)
    inner[last - 1] = False
    ids = np.insert(ids, ends[inner], [ids_of[m] for c in cut for m in c[1::2]])
    return ids, np.add.reduceat(counts, last - own) + own - 1


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only where longer than capacity.

    The first piece takes what does not fill a whole one. Null counts as empty and is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BYTES):
            ids, counts = token_ids(texts_in(batch), path)
            closed = np.insert(ids.astype("<u4"), np.cumsum(counts), end)
            counts = counts + 1
            whole = memoryview(np.ascontiguousarray(closed)).cast("B")
            rows, base = [], 0
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(whole[4 * (base + a) : 4 * (base + b)])))
                base += n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs, from the number of pieces of each length: the best of two families of dual
    feasible functions.

    A dual feasible function keeps the sum over every feasible sequence at most 1, so its sum over all pieces is a bound.
    """
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):  # pieces over capacity - k count whole, those under k count nothing
        value = np.where(sizes > capacity - k, capacity, np.where(sizes >= k, sizes, 0))
        best = max(best, -(-int((counts * value).sum()) // capacity))
    for k in range(1, 101):  # rounding down to k-ths, exact multiples of 1 / (k + 1) kept
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of every piece, and how many sequences: longest first, each into the fullest one that has room."""
    order = np.argsort(-lengths, kind="stable")
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0  # bit r: some sequence has r tokens of room
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            r = (fits & -fits).bit_length() - 1 + n
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, used
            used += 1
        at[i], offset[i] = b, capacity - r
        if r > n:
            if not room[r - n]:
                mask |= 1 << (r - n)
            room[r - n].append(b)
    return at, offset, used


def _packed(items: DataFrame, by: list[str], groups: int, salt: int, capacity: int) -> DataFrame:
    """One round: deal pieces into groups by the hash of ``by``, which tells them apart, and pack each; ``gap`` is a group's count above its own lower bound."""

    def pack(table: pa.Table) -> pa.Table:
        lengths = np.asarray(table["length"])
        at, offset, used = best_fit_decreasing(lengths, capacity)
        gap = used - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        base = (salt << 50) + (int(table["_group"][0].as_py()) << 28)
        fill = np.bincount(at, weights=lengths, minlength=used).astype(np.int64)[at]
        new = [pa.array(at + base), pa.array(offset), pa.array(fill), pa.array(np.full(len(lengths), gap))]
        return pa.table([*(table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *new], names=[*("doc_id", "piece", "start", "length", "ids_crc32"), "sequence_id", "offset", "fill", "gap"])

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(groups)).cast("int"))
    return dealt.select("_group", "doc_id", "piece", "start", "length", "ids_crc32").groupBy("_group").applyInArrow(pack, f"{PIECE}, sequence_id long, offset long, fill long, gap long")


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, share: int = SHARE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt into groups of about ``share`` and packed by best fit decreasing. Lower bounds certify each group's
    count. While the total is above the bound of the whole table (from the at most ``capacity`` counts per length), groups
    with a gap exchange the pieces of their unfilled sequences and are packed again, in turn with the unfilled sequences of
    all groups; a round that saves nothing is not used, and packing ends when each of the two has saved nothing in turn. Every input row is packed, repeated doc_ids too; an empty table
    gives no rows.
    """
    items = saved(token_pieces(docs, capacity, end, path).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = items.groupBy("length").count().toPandas()  # at most `capacity` rows
    total = int(histogram["count"].sum())
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["length"].to_numpy()] = histogram["count"].to_numpy()
    bound = lower_bound(counts, capacity)
    state = saved(_packed(items, ["_row"], max(1, math.ceil(total / share)), 0, capacity), "packed-0")
    used, k, idle = state.where("offset = 0").count(), 0, 0
    while used > bound and idle < 2:
        k += 1
        pool = state.where(f"fill < {capacity}" + (" and gap > 0" if k % 2 else ""))
        size = pool.agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("s")).first()
        idle += 1
        if size["s"] < 2:
            continue
        again = saved(_packed(pool, ["sequence_id", "offset"], max(1, math.ceil(size["n"] / share)), k, capacity), f"packed-{k}")
        saving = size["s"] - again.where("offset = 0").count()
        if saving > 0:
            moved = pool.select("sequence_id").distinct()
            rest = state.join(moved, "sequence_id", "left_anti").select(*state.columns)
            state = saved(rest.unionByName(again), f"state-{k}")
            used, idle = used - saving, 0
    return state.drop("fill", "gap")

