"""How far the sources of each language diverge in the words they use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import saved, slices
from quire.llm.wordscan import LETTERS, Words

#: A term is kept if at least so many documents of its language have it; terms reported per source.
LEAST_DOCUMENTS, REPORTED = 10, 10
SCALE = 1_000_000_000
#: Bytes of text whose word pointers are sorted together; (source, term) cells compared together.
SHARD, CELLS = 8 << 20, 1 << 18
SLICE = 8
#: Words equal in so many slices are compared whole.
DEEPEST = 16


def sorted_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Pointers to all words in the order of their bytes, and where runs of equal words begin in it.

    A multikey quicksort that takes eight bytes as one key: all words are parted by their first slice, then every run of
    equal slices that go on by its next, all runs of a depth at once, until each run is of one word. Words have no zero
    byte, so a slice cut at its word's end and padded by zeros stands before all that go on.
    """
    padded = np.concatenate([words.data, np.zeros(SLICE, np.uint8)])
    at_byte = np.ndarray((len(padded) - SLICE + 1,), ">u8", padded, strides=(1,))
    cut = ~np.uint64(0) << (np.uint64(8) * np.arange(SLICE, -1, -1, dtype=np.uint64) % np.uint64(64))
    cut[0] = 0
    length = words.end - words.start

    def keys(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(length[which] - SLICE * depth, 0, SLICE)
        place = np.minimum(words.start[which] + SLICE * depth, len(at_byte) - 1)
        return at_byte[place].astype(np.uint64) & cut[left]

    every = np.arange(len(words))
    key = keys(every, 0)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    open_ = np.flatnonzero((key & np.uint64(255)) != 0)
    depth = 1
    while len(open_):
        run = np.cumsum(new)[open_]
        alone = np.bincount(run - run[0])[run - run[0]] == 1
        open_, run = open_[~alone], run[~alone]
        if not len(open_):
            break
        which = order[open_]
        if depth < DEEPEST:
            key = keys(which, depth)
            turn = np.lexsort((key, run))
            key = key[turn]
            differs = key[1:] != key[:-1]
        else:
            whole = [words.data[a:b].tobytes() for a, b in zip(words.start[which].tolist(), words.end[which].tolist(), strict=True)]
            turn = np.array(sorted(range(len(which)), key=lambda i: (run[i], whole[i])), np.int64)
            text = [whole[i] for i in turn.tolist()]
            differs = np.array([a != b for a, b in zip(text[1:], text[:-1], strict=True)], bool)
        order[open_] = which[turn]
        new[open_[1:]] |= differs & (run[1:] == run[:-1])
        if depth >= DEEPEST:
            break
        open_ = open_[(key & np.uint64(255)) != 0]
        depth += 1
    return order, np.flatnonzero(new)


def shard_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n, docs of one shard; a row without term for every (lang, source) in it."""
    lang, source = (pc.fill_null(batch.column(i), "") for i in (1, 2))
    codes = [x.dictionary_encode() for x in (lang, source)]
    wide = max(1, len(codes[1].dictionary))
    group = np.asarray(codes[0].indices, np.int64) * wide + np.asarray(codes[1].indices, np.int64)
    # Texts are numbered group by group, so a word's runs by text are also runs by group.
    by_group = np.argsort(group, kind="stable")
    number = np.empty(len(group), np.int64)
    number[by_group] = np.arange(len(group))
    words = Words(batch.column(0), LETTERS)
    order, first = sorted_words(words)
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    cell = np.sort(rank * len(group) + number[words.text_of()[order]])
    new = np.flatnonzero(np.diff(cell, prepend=-1))
    times = np.diff(np.append(new, len(cell)))
    rank, group_of = cell[new] // max(1, len(group)), group[by_group][cell[new] % max(1, len(group))]
    both = rank * (wide * max(1, len(codes[0].dictionary))) + group_of
    start = np.flatnonzero(np.diff(both, prepend=-1))
    n = np.add.reduceat(times, start) if len(start) else times
    docs = np.diff(np.append(start, len(both)))
    head = order[first]
    terms = words.joined(head, head + 1).take(pa.array(rank[start]))
    seen = np.unique(group)
    groups = np.concatenate([group_of[start], seen])
    columns = [
        codes[0].dictionary.take(pa.array(groups // wide)), codes[1].dictionary.take(pa.array(groups % wide)),
        pa.concat_arrays([terms, pa.nulls(len(seen), pa.string())]),
        pa.array(np.concatenate([n, np.zeros(len(seen), np.int64)])), pa.array(np.concatenate([docs, np.zeros(len(seen), np.int64)])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); every (lang, source) also has a row without term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SHARD):
            yield shard_counts(batch)

    rows = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10 ** 9 * (n + 2) / (total + 2 * terms)), in whole numbers of up to 38 digits."""
    up = (n.cast("decimal(19,0)") + F.lit(2)) * F.lit(SCALE).cast("decimal(10,0)")
    down = total.cast("decimal(19,0)") + terms.cast("decimal(18,0)") * F.lit(2)
    return F.lit(1).cast("long") + F.call_function("div", up, F.when(down > 0, down))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the summed gaps of every two sources of a language, in both directions.

    A tile has some terms of a language with all its sources; its table of shares is filled with the share of a term that
    a source lacks. Each tile gives one row per pair and rows are summed. ``kept`` has p and tile, ``groups`` p0 and tiles.
    """

    def run(cells: pa.Table, sources: pa.Table) -> pa.Table:
        names = sorted(sources.column("source").to_pylist(), key=str.encode)
        row = {s: i for i, s in enumerate(names)}
        base = np.zeros(len(names), np.int64)
        base[[row[s] for s in sources.column("source").to_pylist()]] = np.asarray(sources.column("p0").fill_null(0))
        coded = cells.column("term").combine_chunks().dictionary_encode()
        term = np.asarray(coded.indices if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks().indices, np.int64)
        p = np.repeat(base[:, None], int(term.max()) + 1 if len(term) else 0, axis=1)
        of = cells.column("source").combine_chunks().dictionary_encode()
        place = np.array([row[s] for s in of.dictionary.to_pylist()], np.int64)
        if len(term):
            p[place[np.asarray(of.indices, np.int64)], term] = np.asarray(cells.column("p"))
        left, right, value = [], [], []
        for i in range(len(names) - 1):
            a, b = p[i], p[i + 1 :]
            left += [names[i]] * len(b)
            right += names[i + 1 :]
            value.append(((a - b) ** 2 // (a + b)).sum(axis=1))
        lang = sources.column("lang")[0].as_py()
        values = np.concatenate(value) if value else np.zeros(0, np.int64)
        return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "value": pa.array(values, pa.int64())})

    spread = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    cells = kept.select("lang", "tile", "source", "term", "p")
    tiles = cells.groupBy("lang", "tile").cogroup(spread.groupBy("lang", "tile")).applyInArrow(run, "lang string, a string, b string, value long")
    sums = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", F.inline(ways), "value")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, reported: int = REPORTED) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources diverge, and the terms that set each apart.

    Terms are runs of letters (every character beyond ASCII is one), A-Z lower-cased. A language keeps the terms that at
    least ``least`` of its documents have. Word-start pointers into each shard's text are sorted, and runs of equal words
    give occurrences and documents per source; shards are summed by Spark. Part ``pair`` has every other source of the
    language, part ``term`` the ``reported`` terms whose share in the source most exceeds the language's. Null text,
    language and source are ''. Repeated rows count as often as they occur; ties are in the order of the item's bytes; a
    language without kept terms has pairs of value 0; an empty table gives no rows. Other columns are ignored.
    """
    counts = saved(term_counts(docs), "term-counts")
    term = W.partitionBy("lang", "term")
    rows = counts.where("term is not null").select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("n_lang"), (F.col("source") == F.min("source").over(term)).alias("head")
    )
    kept = saved(rows.where(F.col("docs") >= least).drop("docs"), "kept-terms")
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("head").alias("terms"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "total_lang", "terms"]).withColumn("sources", F.count("*").over(W.partitionBy("lang")))
    cells = F.col("terms").cast("decimal(19,0)") * F.col("sources")
    groups = groups.withColumns({
        "tiles": F.greatest(F.lit(1).cast("long"), F.ceil(cells / CELLS).cast("long")),
        "p0": share(F.lit(0), F.col("total"), F.col("terms")),
    })
    groups = saved(groups, "source-groups")
    kept = kept.join(groups.drop("sources", "p0"), ["lang", "source"]).withColumns({
        "p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("n_lang"), F.col("total_lang"), F.col("terms")),
        "tile": F.pmod(F.xxhash64("term"), F.col("tiles")),
    })
    pairs = source_pairs(kept, groups).withColumn("part", F.lit("pair"))
    terms = kept.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= reported))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
