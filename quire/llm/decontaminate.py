"""Passages of benchmark items inside documents, by a prefix-filtered join of shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import saved, slices
from quire.llm.wordscan import ALPHANUMERICS, BASE, MIX, Words

#: Consecutive words of an item that count as found; words of a shingle.
WINDOW, SHINGLE = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the table that tells which shingles can matter: 2 MB for any number of items. It only saves work.
FILTER_BITS = 24
#: Bytes of text scanned at a time.
BYTES = 4 << 20


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words; shingles of another size have other hashes."""
    total = np.full(max(0, len(words) - size + 1), np.uint64(size))
    for k in range(size):
        total = (total * BASE) + words[k : len(words) - size + 1 + k]
    return (total ^ (total >> np.uint64(31))) * MIX


def known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes fall on a place whose bit is set."""
    place = (hashes >> np.uint64(64 - (table.size * 8).bit_length() + 1)).astype(np.int64)
    return np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & np.uint8(1))


def windows(items: DataFrame, width: int) -> DataFrame:
    """words, n_words, item_set, items: every distinct window of the items, with the sorted identifiers of those that have it."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("all")).where(F.size("all") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - (width - 1), F.lit(1))))
    rows = rows.select("item_id", "all", start.alias("start")).select("item_id", F.array_join(F.slice("all", F.col("start"), width), " ").alias("words"))
    found = rows.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return found.withColumn("item_set", F.sha2(F.to_json("items"), 256))


def window_shingles(found: DataFrame, size: int) -> DataFrame:
    """words, item_set, n_words, shingle, offset, length: every shingle of each window; a shorter window is one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", BYTES):
            scan = Words(batch.column(0), ALPHANUMERICS)
            hashes, counts = scan.hashes(), np.diff(scan.first)
            row, shingle, offset, length = [], [], [], []
            for k in range(1, size + 1):
                which = np.flatnonzero(counts >= size) if k == size else np.flatnonzero(counts == k)
                n = counts[which] - k + 1
                of = np.repeat(which, n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                row.append(of)
                offset.append(at)
                shingle.append(shingle_hashes(hashes, k)[scan.first[of] + at])
                length.append(np.full(len(of), k))
            row = np.concatenate(row)
            index = pa.array(row)
            columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(counts[row].astype(np.int32))]
            columns += [pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.concatenate(offset).astype(np.int32)), pa.array(np.concatenate(length).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["words", "item_set", "n_words", "shingle", "offset", "length"])

    schema = "words string, item_set string, n_words int, shingle long, offset int, length int"
    return found.select("words", "item_set").mapInArrow(run, schema)


def table_of(shingles: DataFrame) -> np.ndarray:
    """One bit per place that a shingle's hash falls on; Spark gathers it as at most 2 ** (FILTER_BITS - 6) words."""
    place = F.shiftrightunsigned("shingle", 64 - FILTER_BITS)
    words = shingles.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    rows = words.toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def scanned(docs: DataFrame, table: np.ndarray, sizes: list[int], width: int) -> DataFrame:
    """doc_id, n_words, shared (the document's words near such shingles), hits (shingle, pos, at) of every document.

    A hit is a shingle whose hash the table has, at word ``pos`` of the document and word ``at`` of ``shared``, which keeps
    whatever a window over the hit can hold.
    """
    bits = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BYTES):
            scan = Words(batch.column(1), ALPHANUMERICS)
            hashes, of = scan.hashes(), scan.text_of()
            shingle, at = [], []
            for k in sizes:
                found = shingle_hashes(hashes, k)
                place = known(bits.value, found)
                place = place[of[place] == of[place + k - 1]]
                shingle.append(found[place])
                at.append(place)
            shingle, at = np.concatenate(shingle), np.concatenate(at)
            turn = np.argsort(at, kind="stable")
            shingle, at = shingle[turn], at[turn]
            near = np.zeros(len(scan) + 1, np.int64)
            first, last = scan.first[of[at]], scan.first[of[at] + 1]
            np.add.at(near, np.maximum(at - width, first), 1)
            np.add.at(near, np.minimum(at + width, last), -1)
            near = np.cumsum(near)[:-1] > 0
            before = np.concatenate([[0], np.cumsum(near)])
            # Kept words of a document, in order, as one text: runs of kept words are joined from their ranges.
            kept = np.flatnonzero(near)
            single = scan.joined(kept, kept + 1)
            bounds = before[scan.first]
            shared = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), single), " ")
            own = np.searchsorted(at, scan.first).astype(np.int32)
            hits = pa.StructArray.from_arrays(
                [pa.array(shingle.view(np.int64)), pa.array((at - first).astype(np.int32)), pa.array((before[at] - before[first]).astype(np.int32))], ["shingle", "pos", "at"]
            )
            columns = [batch.column(0), pa.array(np.diff(scan.first)), shared, pa.ListArray.from_arrays(pa.array(own), hits)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "shared", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, shared string, hits array<struct<shingle: long, pos: int, at: int>>")


def around(rows: DataFrame, table: np.ndarray, width: int) -> DataFrame:
    """row, n_words, shingle, pos, before, after: the hits that the table has, each with the words around it."""
    bits = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shared", BYTES):
            scan = Words(batch.column(2), ALPHANUMERICS)
            hits = batch.column(3)
            flat = hits.flatten()
            shingle, pos, at = (np.asarray(flat.field(i)) for i in range(3))
            of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(hits)))
            keep = known(bits.value, shingle.view(np.uint64))
            shingle, pos, at, of = shingle[keep], pos[keep].astype(np.int64), at[keep], of[keep]
            n = np.asarray(batch.column(1))[of]
            word = scan.first[of] + at
            before = scan.joined(word - np.minimum(pos, width), word)
            after = scan.joined(word, word + np.minimum(n - pos, width))
            index = pa.array(of)
            columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(shingle), pa.array(pos), before, after]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "shingle", "pos", "before", "after"])

    return rows.select("row", "n_words", "shared", "hits").mapInArrow(run, "row long, n_words long, shingle long, pos long, before string, after string")


def anchors(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """words, item_set, n_words, shingle, offset, head, tail: each window with its rarest shingle, and its words before and
    from there. A window with a shingle that no document has is nowhere."""
    known = shingles.join(counts.withColumnRenamed("shingle", "_s"), F.col("shingle") == F.col("_s"), "left").drop("_s")
    rarest = known.groupBy("words", "item_set", "n_words").agg(
        F.min(F.struct("n", "shingle", "offset")).alias("least"), F.bool_and(F.col("n").isNotNull()).alias("all")
    )
    words, offset = F.split("words", " "), F.col("least.offset")
    return rarest.where("all").select(
        "item_set", "n_words", "least.shingle", "least.offset",
        F.array_join(F.slice(words, F.lit(1), offset), " ").alias("head"), F.array_join(F.slice(words, offset + 1, F.col("n_words")), " ").alias("tail"),
    )


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words), occurrences (row, start, n, item_set) of windows in them, and the items of each
    item_set.

    Shingles are ordered by how often documents have them. A window lies in a document only if its necessary prefix, at full
    containment its rarest shingle, does; only these shingles are joined. A pair must leave room for the window before and
    behind the shingle (position and length), then its words are compared one by one with the document's. Documents are read
    once; after that only the words near a shingle of an item are handled.
    """
    found = saved(windows(items, width), "item-windows")
    sets = found.groupBy("item_set").agg(F.any_value("items").alias("items"))
    shingles = saved(window_shingles(found, shingle), "window-shingles")
    sizes = sorted(r[0] for r in shingles.select("length").distinct().toLocalIterator())
    rows = scanned(docs, table_of(shingles), sizes or [shingle], width)
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "scanned-documents")
    shared = rows.where(F.size("hits") > 0)
    counts = shared.select(F.explode("hits.shingle").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    starts = saved(anchors(shingles, counts), "anchors")
    near = around(shared, table_of(starts), width).alias("d")
    w = starts.withColumnRenamed("n_words", "n").alias("w")
    bounds = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("n") <= F.col("n_words"))
    space = lambda c: F.concat(c, F.lit(" "))
    same = F.startswith(space("after"), space("tail")) & (
        (F.col("offset") == 0) | F.endswith(F.concat(F.lit(" "), "before"), F.concat(F.lit(" "), "head"))
    )
    pairs = near.join(w, (F.col("d.shingle") == F.col("w.shingle")) & bounds & same)
    hits = pairs.select("row", (F.col("pos") - F.col("offset")).alias("start"), F.col("n").cast("long").alias("n"), "item_set").distinct()
    return rows.select("row", "doc_id", "n_words"), saved(hits, "window-hits"), sets


def contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    Words are runs of letters and digits (every character beyond ASCII is one), A-Z lower-cased. A window is ``width``
    consecutive words of an item, or all words of a shorter one; words inside an occurrence of a window are hit. Null text
    has no words; rows without doc_id or with a repeated one are rows of their own; items without item_id hit words but are
    not counted; items that repeat count once per item_id. Empty tables give no rows, or no hits. Other columns are ignored.
    """
    rows, hits, sets = occurrences(docs, items, width, shingle)
    end = F.col("start") + F.col("n")
    reach = F.max(end).over(W.partitionBy("row").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1))
    spans = hits.groupBy("row", "start").agg(F.max("n").alias("n")).withColumn("reach", F.coalesce(reach, F.lit(0)))
    words = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reach"))).alias("n_hit"))
    of = hits.select("row", "item_set").distinct().join(sets, "item_set").select("row", F.explode("items").alias("item_id"))
    ids = of.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    out = rows.join(words.join(ids, "row", "left").withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
