"""Removal of lines that repeat, exactly or within one word, anywhere in the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import saved, slices
from quire.llm.wordscan import NONBLANKS, Words

#: Edit bound: one word put in, left out or changed, in lines of at least this many words (a similarity of 0.8 or more).
MIN_WORDS = 5
#: Line flags go to every task as a broadcast only up to this many bytes, which are counted; beyond it documents are joined by
#: exchange. The rows are the same.
BROADCAST_BYTES = 64 << 20
#: Bytes of text taken apart at a time.
SLICE = 4 << 20
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FULL = -1
#: Copies of a line that many others are compared with, so that one line does not gather all its partners in one task.
SALTS = 8


@lru_cache(maxsize=4)
def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2 ** 64 and their inverses."""
    inverse = np.uint64(pow(int(BASE[which]), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b)])) for b in (BASE[which], inverse))


class Lines:
    """Polynomial hashes of many lines' words at once, from which those of any part or variant follow: ``words`` has the
    hashes of all words and ``n`` how many each line has."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words, self.n = words, n
        self.start = np.cumsum(self.n) - self.n
        place = np.arange(len(words)) - np.repeat(self.start, self.n)
        size = 1 << max(10, int(self.n.max(initial=0)).bit_length())
        self.powers = [powers(which, size) for which in (0, 1)]
        self.sums = []
        for which in (0, 1):
            terms = (words ^ np.uint64(which * 0x5555555555555555)) * self.powers[which][0][place]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(terms)]))

    def only(self, which: np.ndarray) -> Lines:
        """Some of the lines."""
        n = self.n[which]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Lines(self.words[np.repeat(self.start[which], n) + within], n)

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple((s[self.start + self.n] - s[self.start] + self.n.astype(np.uint64)).view(np.int64) for s in self.sums)

    def anchors(self) -> np.ndarray:
        """Four hashes per line, of the first and the last words, as many as lines within the bound share at one end.

        Of n words one edit leaves the first or the last (n - 1) // 2 alone; a line also serves partners one word shorter.
        """
        s, inverse = self.sums[0], self.powers[0][1]
        end, out = self.start + self.n, []
        for size in ((self.n - 1) // 2, np.maximum(self.n - 2, 0) // 2):
            for side, value in ((1, s[self.start + size] - s[self.start]), (2, (s[end] - s[end - size]) * inverse[self.n - size])):
                out.append((value * np.uint64(31) + (size * 2 + side).astype(np.uint64)) * BASE[0])
        return np.stack(out, axis=1).view(np.int64)

    def variants(self) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each line less one word, for every word of all lines."""
        out = []
        of = np.repeat(np.arange(len(self.n)), self.n)
        for s, (_, inverse) in zip(self.sums, self.powers, strict=True):
            first, last = s[self.start][of], s[self.start + self.n][of]
            out.append(((s[:-1] - first) + (last - s[1:]) * inverse[1] + (self.n[of] - 1).astype(np.uint64)).view(np.int64))
        return tuple(out)


def lines_of(texts: pa.Array) -> tuple[Lines, np.ndarray, np.ndarray]:
    """All lines with words of some texts, and of each the text's place and its number in the text."""
    scan = Words(texts, NONBLANKS)
    line, first = scan.lines()
    new = np.flatnonzero(np.diff(line, prepend=-1))
    lines = Lines(scan.hashes(), np.diff(np.append(new, len(line))))
    text = scan.text_of()[new]
    return lines, text, line[new] - first[text]


def chosen(texts: pa.Array, wanted: pa.ListArray) -> tuple[np.ndarray, np.ndarray, Lines]:
    """Place of the text and number of the wanted lines (line, k1, k2), and their hashes; a line that has changed is left out."""
    some = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(wanted), 0)))
    cells = wanted.take(pa.array(some))
    of = np.repeat(some, np.asarray(pc.list_value_length(cells), np.int64))
    line, k1, k2 = (np.asarray(cells.flatten().field(i), np.int64) for i in range(3))
    lines, text, number = lines_of(texts.take(pa.array(some)))
    text = some[text] if len(some) else text
    # Lines come by text and number, so a wanted one is found by its place in that order.
    width = int(max(number.max(initial=0), line.max(initial=0))) + 1
    at = np.searchsorted(text * width + number, of * width + line)
    ok = at < len(text)
    ok[ok] = (text[at[ok]] == of[ok]) & (number[at[ok]] == line[ok])
    own = lines.full()
    ok[ok] = (own[0][at[ok]] == k1[ok]) & (own[1][at[ok]] == k2[ok])
    at = at[ok]
    return text[at], number[at], lines.only(at)


def occurrences(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, line, anchors): every line with words; anchors only for lines the edit bound applies to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            lines, docs_, numbers = lines_of(batch.column(1))
            docs_ = batch.column(0).take(pa.array(docs_))
            k1, k2 = lines.full()
            long = lines.n >= MIN_WORDS
            offsets = np.concatenate([[0], np.cumsum(long) * 4]).astype(np.int32)
            anchors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines.anchors()[long].ravel()))
            columns = [pa.array(k1), pa.array(k2), docs_, pa.array(numbers), anchors]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc_id", "line", "anchors"])

    return docs.mapInArrow(run, "k1 long, k2 long, doc_id long, line long, anchors array<long>")


def edited(marked: DataFrame) -> DataFrame:
    """(v1, v2, gap, k1, k2, doc_id, line, words): each wanted line whole (gap -1) and less its word number gap.

    ``marked`` has documents with ``_wanted``, the lines (line, k1, k2) to take from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            row, number, lines = chosen(batch.column(1), batch.column(2))
            of = np.concatenate([np.repeat(np.arange(len(row)), lines.n), np.arange(len(row))])
            gap = np.concatenate([np.arange(len(of) - len(row)) - np.repeat(lines.start, lines.n), np.full(len(row), FULL)])
            k1, k2 = lines.full()
            v1, v2 = (np.concatenate(v) for v in zip(lines.variants(), (k1, k2), strict=True))
            doc = np.asarray(batch.column(0), np.int64)[row]
            columns = [v1, v2, gap, k1[of], k2[of], doc[of], number[of], lines.n[of]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["v1", "v2", "gap", "k1", "k2", "doc_id", "line", "words"])

    return marked.mapInArrow(run, "v1 long, v2 long, gap long, k1 long, k2 long, doc_id long, line long, words long")


def with_lines(docs: DataFrame, flags: DataFrame, name: str) -> DataFrame:
    """``docs`` with the flagged lines of each document as an array; texts move only if the flags are not small."""
    per_doc = flags.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("line", "k1", "k2")).alias(name))
    small = flags.count() * 24 <= BROADCAST_BYTES
    return docs.join(F.broadcast(per_doc) if small else per_doc, docs["doc_id"] == per_doc["_doc"], "left").drop("_doc")


def one_edit_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word put in, left out or changed makes ``a`` of ``b``."""
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return b[at + 1 :] == (a[at + 1 :] if len(a) == len(b) else a[at:])


def verified(nearest: DataFrame, distinct: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``nearest`` (k1, k2, near) whose lines, read again from their texts, are one edit apart word by word."""
    near = nearest.select("near.doc_id", "near.line", "near.k1", "near.k2")
    own = distinct.join(nearest, ["k1", "k2"], "left_semi").select("first.doc_id", "first.line", "k1", "k2")
    marked = with_lines(ids, saved(own.unionByName(near).distinct(), "compared-lines"), "_wanted").where("_wanted is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            row, number, lines = chosen(batch.column(1), batch.column(2))
            k1, k2 = lines.full()
            found, last, parts = [], -1, []
            for i, k in zip(row.tolist(), number.tolist(), strict=True):
                if i != last:
                    last, parts = i, batch.column(1)[i].as_py().split("\n")
                found.append(parts[k])
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(found, pa.string())], ["k1", "k2", "words"])

    # A line may be read at several places; its words are the same at each.
    texts = saved(marked.mapInArrow(read, "k1 long, k2 long, words string").groupBy("k1", "k2").agg(F.min("words").alias("words")), "compared-words")
    copies = texts.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("words").alias("near_words"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = nearest.join(texts, ["k1", "k2"]).withColumns({"n1": F.col("near.k1"), "n2": F.col("near.k2"), "salt": F.pmod("k1", F.lit(SALTS)).cast("int")})
    pairs = pairs.join(copies, ["n1", "n2", "salt"]).select("k1", "k2", "near", "words", "near_words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, others = (batch.column(i).cast(pa.binary()).to_pylist() for i in (3, 4))
            same = pa.array([one_edit_apart(a.split(), b.split()) for a, b in zip(words, others, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)], ["k1", "k2", "near"]).filter(same)

    return pairs.mapInArrow(compare, nearest.schema)


def first_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All occurrences, and one row per distinct line: k1, k2, first (its earliest doc_id and line), near (the earliest
    first of the other lines within the edit bound, or null)."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = saved(occurrences(ids), "lines")
    place = F.struct("doc_id", "line")
    distinct = saved(seen.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.first("anchors").alias("anchors")), "distinct-lines")
    # Lines can only be within the bound of one they share an end with.
    ends = distinct.where("anchors is not null").select("k1", "k2", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared = ends.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = ends.join(shared, "anchor", "left_semi").select("k1", "k2").distinct()
    flags = saved(distinct.join(wanted, ["k1", "k2"], "left_semi").select("first.doc_id", "first.line", "k1", "k2"), "wanted-lines")
    marked = with_lines(ids, flags, "_wanted").where("_wanted is not null")
    rows = saved(edited(marked), "edited-lines")
    at = F.struct("doc_id", "line", "k1", "k2")
    # Same gap: one word changed. A whole line against one less a word: one word put in or left out.
    changed = rows.where(f"gap <> {FULL}").groupBy("v1", "v2", "gap", "words").agg(F.min(at).alias("near"), F.count("*").alias("n")).where("n > 1").drop("n")
    whole = rows.where(f"gap = {FULL}").groupBy("v1", "v2").agg(F.min(at).alias("near"))
    less = rows.where(f"gap <> {FULL}").groupBy("v1", "v2").agg(F.min(at).alias("near"))
    pairs = (
        rows.join(changed, ["v1", "v2", "gap", "words"]).select("k1", "k2", "near")
        .unionByName(rows.where(f"gap <> {FULL}").join(whole, ["v1", "v2"]).select("k1", "k2", "near"))
        .unionByName(rows.where(f"gap = {FULL}").join(less, ["v1", "v2"]).select("k1", "k2", "near"))
    )
    nearest = pairs.where("near.k1 <> k1 or near.k2 <> k2").groupBy("k1", "k2").agg(F.min("near").alias("near"))
    nearest = verified(saved(nearest, "nearest-lines"), distinct, ids)
    return seen, distinct.drop("anchors").join(nearest, ["k1", "k2"], "left")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and the columns n_lines, n_dropped.

    Lines end at line feeds; two are equal if their words (runs of non-blanks) are. Lines of five words or more also repeat
    a line that differs by one word put in, left out or changed. An occurrence is dropped if an equal line, or one within
    that bound, occurs earlier (smaller doc_id, then smaller line number), dropped or not; lines without words stay. Every
    line less each of its words is a hashed key, equal keys are joined and only aggregates per key are kept, so a key
    shared by a third of all lines is combined before it moves. Keys of 128 bits are equal at the same gap for lines one
    change apart, and a whole line's is another's less a word for lines one insertion apart; of each line the earliest such
    partner is read again and the edit distance is verified on the words. Documents without text or doc_id come back as they are with their count of lines and
    nothing dropped. Existing columns with the added names are replaced.
    """
    seen, distinct = first_lines(docs)
    place = F.struct("doc_id", "line")
    known = distinct.select("k1", "k2", F.when(F.col("near").isNull(), F.col("first")).otherwise(F.least("first", F.struct("near.doc_id", "near.line"))).alias("start"))
    dropped = saved(seen.drop("anchors").join(known, ["k1", "k2"]).where(place > F.col("start")).select("doc_id", "line", "k1", "k2"), "dropped-lines")
    base = docs.drop("n_lines", "n_dropped")
    names = base.columns
    # The rows of documents move as they are, under names that no column of theirs can clash with.
    own = base.toDF(*[f"_c{i}" for i in range(len(names))]).withColumnRenamed(f"_c{names.index('doc_id')}", "doc_id")
    marked = with_lines(own, dropped, "_dropped_lines")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"_c{at}", SLICE):
            texts = batch.column(at)
            row, number, _ = chosen(texts, batch.column(len(names)))
            cut: dict[int, set[int]] = {}
            for i, k in zip(row.tolist(), number.tolist(), strict=True):
                cut.setdefault(i, set()).add(k)
            counts = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
            mask, gone = np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
            mask[list(cut)] = True
            gone[list(cut)] = [len(x) for x in cut.values()]
            left = []
            for i in sorted(cut):
                left.append("\n".join(x for k, x in enumerate(texts[i].as_py().split("\n")) if k not in cut[i]))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pc.replace_with_mask(texts.cast(pa.string()), pa.array(mask), pa.array(left, pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(gone)], [*names, "n_lines", "n_dropped"])

    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return marked.mapInArrow(run, schema)
