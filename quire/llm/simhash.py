"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forest, run_chunks, saved, slices, texts_in
from quire.llm.graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Two fingerprints within the radius agree on at least BLOCKS - RADIUS of the blocks.
RADIUS, BLOCKS, TILE = 2, 4, 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; none: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), and _n if ``docs`` has it: the fingerprint as a signed 64-bit number. Null and blank texts have zero."""
    number = ["_n"] if "_n" in docs.columns else []

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(shingle_hashes(t)) for t in texts_in(batch)], np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *number])

    schema = "doc_id long, fp long" + "".join(f", {n} long" for n in number)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *number).mapInArrow(make, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p of all fingerprints, 64 to a word."""
    lanes = -len(fps) % 64
    bits = np.unpackbits(np.pad(fps, (0, lanes)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_pairs(fps: np.ndarray, radius: int = RADIUS, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of fingerprints that differ in at most ``radius`` bits.

    A block of queries meets all lanes at once: each plane's differences go into carry-save counters held as bit vectors,
    and a query leaves the block once all its lanes exceed the radius.
    """
    store = planes(fps)
    left, right = [], []
    levels = max(1, radius.bit_length())
    for start in range(0, len(fps), block):
        first = start // 64  # pairs with earlier lanes were found from the other side
        lanes = store[:, first:]
        query = fps[start : start + block]
        places = np.arange(start, start + len(query))
        counters = np.zeros((levels, len(query), lanes.shape[1]), np.uint64)
        over = np.zeros(counters.shape[1:], np.uint64)
        for p in range(64):
            carry = lanes[p] ^ np.where(query >> np.uint64(p) & np.uint64(1), ALL, np.uint64(0))[:, None]
            for counter in counters:
                spill = counter & carry
                counter ^= carry
                carry = spill
            over |= carry
            if p % 8 == 7:
                over |= above(counters, radius)
                alive = (over != ALL).any(axis=1)
                if not alive.all():
                    query, places, over, counters = query[alive], places[alive], over[alive], counters[:, alive]
                    if not len(query):
                        break
        if len(query):
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            i, j = places[i], j + first * 64
            keep = (i < j) & (j < len(fps))
            left.append(i[keep])
            right.append(j[keep])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is greater than the radius, compared bit by bit from the top."""
    greater = np.zeros(counters.shape[1:], np.uint64)
    equal = np.full(counters.shape[1:], ALL)
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            greater |= equal & counters[level]
            equal = equal & ~counters[level]
    return greater


def near_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within the radius; ``distinct`` has (id, fp), each fp once.

    Rows meet under the six pairs of equal 16-bit blocks. A key with more members than a tile is split into tiles of its
    parts, so no task holds a hot key whole; a tile returns at most one link per member, enough to keep it connected.
    """
    shift = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", shift * b).bitwiseAND((1 << shift) - 1) for b in range(BLOCKS)]
    keys = [F.shiftleft(block[a], shift).bitwiseOR(block[b]).bitwiseOR(F.lit(k << 32)) for k, (a, b) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]
    rows = distinct.select("id", "fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / tile)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    rows = rows.select("id", "fp", "key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = rows.select("id", "fp", "key", F.concat_ws(":", F.least("own", "other"), F.greatest("own", "other")).alias("part"))
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in run_chunks(batches, ["key", "part"], 512):
            ids, fps = np.asarray(table["id"]), np.asarray(table["fp"]).view(np.uint64)
            key, part = np.asarray(table["key"]), np.asarray(table["part"])
            a, b = close_pairs(fps)
            same = (key[a] == key[b]) & (part[a] == part[b])
            a, b = a[same], b[same]
            head = forest(len(ids), a, b)
            moved = np.flatnonzero(head != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[head[moved]])], ["a", "b"])

    return dealt.mapInArrow(link, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Words are runs of non-blanks after lower-casing A-Z; shingles have three words; fingerprints link at two or fewer
    differing bits. Equal fingerprints are compared once. Texts without words all have fingerprint zero and link like any
    other. Rows without doc_id link too; component_id is null only if no row of the group has a doc_id. Repeated doc_ids
    stay separate rows; other columns are ignored; an empty table gives no rows.
    """
    marked = saved(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    heads = head_fingerprints(marked).select("_fp", "component_id")
    return marked.join(heads, marked["fp"] == heads["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def head_fingerprints(marked: DataFrame) -> DataFrame:
    """_fp, _head, component_id: each fingerprint of (doc_id, fp) with its group and the group's smallest doc_id."""
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    # a fingerprint is its own id, as those of rows without doc_id need one too
    groups = components(near_links(distinct.select(F.col("fp").alias("id"), "fp"))).withColumnRenamed("id", "_id")
    heads = saved(distinct.join(groups, distinct["fp"] == groups["_id"], "left").select(F.col("fp").alias("_fp"), "low", F.coalesce("component", "fp").alias("_head")), "heads")
    lowest = heads.groupBy("_head").agg(F.min("low").alias("component_id"))
    return heads.join(lowest, "_head").select("_fp", "_head", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: one with the smallest doc_id, or any if no row of the group has one.

    Rows get a number and are written before fingerprints are made, so repeated and missing doc_ids need no key.
    """
    rows = saved(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_n")), "numbered-documents")
    marked = saved(fingerprints(rows.select("row.doc_id", "row.text", "_n")), "fingerprints")
    groups = head_fingerprints(marked).select("_fp", "_head")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_n")
    kept = marked.join(groups, marked["fp"] == groups["_fp"]).groupBy("_head").agg(F.min(order).alias("least"))
    return rows.join(kept.select(F.col("least._n").alias("_kept")), F.col("_n") == F.col("_kept"), "left_semi").select("row.*")
