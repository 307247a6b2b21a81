"""Scoring of texts by a hierarchical Pitman-Yor language model, seated by Gibbs sampling."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import dropped, partitions, run_chunks, saved_to, scratch, slices

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FOLDS, HELD = 7, 2
END = b"\n"  # cannot be a word
#: Words whose restaurants' totals every task holds: the most frequent ones, one place being kept free.
CONTEXTS = 1 << 16
#: Discount and strength of the root, and of the restaurants behind rare and behind frequent words.
DISCOUNT, STRENGTH = (0.6, 0.8, 0.8), (10.0, 10.0, 10.0)
BURN, SAMPLES = 2, 3
#: Occurrences in a chunk that make a word a candidate for the frequent ones.
OFTEN = 16
#: Words with a larger share than 1 / HEAVY of all tokens have their tokens scored where they are.
HEAVY = 512
#: Tokens and documents of one batch; words remembered by a worker.
TOKENS, DOCUMENTS, REMEMBERED = 1 << 19, 1 << 15, 1 << 17
EXACT = 24
#: Tokens scored at a time; buckets of words per shuffle partition; partial sums that a task combines before it sends them.
CHUNK, BUCKETS, SUMS = 1 << 17, 4, 1 << 21


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed cell, byte by byte of their numbers, as high bytes are much alike."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)]))


def unpacked(cell: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(cell)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for char, size in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        kind = np.dtype(chr(char))
        planes = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files, which nothing reads once their result is there."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    with freed(df.sparkSession):
        return saved_to(path, df, by)


def fetched(df: DataFrame) -> pd.DataFrame:
    """A bounded number of rows on the driver."""
    with freed(df.sparkSession):
        return df.toPandas()


class Words(dict):
    """Place and code of every word met in this worker."""

    def __init__(self):
        self.codes = array("Q")

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.codes)
        self.codes.append(xxhash.xxh3_64_intdigest(word))
        return place


def words_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().translate(LOWER).split(), END]


def is_held(doc) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % FOLDS == HELD


def word_counts(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(code, n, total): counts of the wanted words in each chunk of whole texts, or of the words over half of 1 / HEAVY of
    a chunk or with OFTEN occurrences there; one row a chunk has its number of tokens and no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            total = counts.total()
            some = [(w, n) for w, n in counts.items() if wanted is not None or n >= OFTEN or 2 * HEAVY * n > total]
            codes = np.array([xxhash.xxh3_64_intdigest(w) for w, _ in some], np.uint64)
            numbers = np.array([n for _, n in some], np.int64)
            if wanted is not None:
                own = np.isin(codes, wanted)
                codes, numbers = codes[own], numbers[own]
            counts.clear()
            columns = [[*codes.view(np.int64).tolist(), None], [*numbers.tolist(), None], [*[None] * len(codes), total]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["code", "n", "total"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > REMEMBERED:
                    yield send()
        yield send()

    return docs.select("text").mapInArrow(run, "code long, n long, total long")


def heavy_words(docs: DataFrame) -> np.ndarray:
    """Codes of the words over 1 / HEAVY of all tokens: only where tokens are scored depends on it.

    In the chunks that do not report it a word has at most half of 1 / HEAVY of their tokens. So the reports of a word over
    1 / HEAVY of all tokens are over half of that, as fewer than 2 x HEAVY words' are; these are then counted in full.
    """
    return frequent_words(docs)[0]


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the heavy words, sorted, and of these and the most reported others, the most frequent first, under CONTEXTS in all."""

    def codes(rows: DataFrame) -> np.ndarray:
        return fetched(rows.select("code"))["code"].to_numpy(np.int64).view(np.uint64)

    def counted(counts: DataFrame) -> DataFrame:
        return counts.where("code is not null").groupBy("code").agg(F.sum("n").alias("n"))

    reports = kept(word_counts(docs), scratch(docs.sparkSession, "lm-words"))
    total = reports.agg(F.sum("total")).first()[0] or 0
    some = codes(counted(reports).where(f"{2 * HEAVY} * n > {total}"))
    heavy = np.sort(codes(counted(word_counts(docs, some)).where(f"{HEAVY} * n > {total}")))
    most = codes(counted(reports).orderBy(F.desc("n"), "code").limit(CONTEXTS - 1))
    return heavy, np.concatenate([heavy, most[~np.isin(most, heavy)]])[: CONTEXTS - 1]


def token_batches(docs: DataFrame, heavy: np.ndarray, frequent: np.ndarray, buckets: int, rare_buckets: int) -> DataFrame:
    """(kind, bucket, batch, cell): the tokens of batches of documents. A token's context is the word before it.

    kind n: behind frequent words, dealt by word: a bucket's words (codes, counts) and per token its context and document;
    h: the same of the heavy words, by their place; r: behind rare words, dealt by context: a bucket's contexts (codes,
    counts) and per token its document and word, the codes of words that are not frequent apart; d: the batch's doc_ids and
    token counts. A document's number in its batch has 15 bits; bit 15 is set if it
    is for training.
    """

    ranks = np.argsort(frequent)
    known = frequent[ranks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence = TaskContext.get().partitionId(), 0
        words = Words()
        held: list[np.ndarray] = []
        ids: list = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            sizes = np.array([len(p) for p in held])
            places = np.concatenate(held)
            codes = np.array(words.codes, np.uint64)
            before = np.roll(places, 1)
            before[np.cumsum(sizes) - sizes] = words[END]
            flags = np.array([i | (0 if is_held(d) else 1 << 15) for i, d in enumerate(ids)], np.uint16)
            document = np.repeat(flags, sizes)
            place, hot = _find(known, codes), _find(heavy, codes)
            place = np.where(place >= 0, ranks[place], -1) if len(ranks) else place
            batch, rows = part << 24 | sequence, []
            sequence += 1

            def dealt(by: np.ndarray, chosen: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
                """Per bucket its codes, their counts and their tokens, in one order."""
                bucket = (codes % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((codes, bucket))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                t = chosen[np.argsort(rank[by[chosen]], kind="stable")]
                token_rank = rank[by[t]]
                starts = np.flatnonzero(np.diff(token_rank, prepend=-1))
                offsets = np.append(starts, len(t))
                unique = order[token_rank[starts]]
                edges = np.searchsorted(bucket[unique], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    i, j = edges[b], edges[b + 1]
                    yield b, codes[unique[i:j]], np.diff(offsets[i : j + 1]).astype(np.uint32), t[offsets[i] : offsets[j]]

            behind = place[before]
            at_hot = hot[places]
            rows.append(("d", -1, batch, packed(np.array([d is not None for d in ids]), np.array([d or 0 for d in ids], np.int64), sizes)))
            own = np.flatnonzero((behind >= 0) & (at_hot >= 0))
            rows.append(("h", -1, batch, packed(at_hot[own].astype(np.uint16), behind[own].astype(np.uint16), document[own])))
            for b, found, counts, t in dealt(places, np.flatnonzero((behind >= 0) & (at_hot < 0)), buckets):
                rows.append(("n", b, batch, packed(found, counts, behind[t].astype(np.uint16), document[t])))
            for b, found, counts, t in dealt(before, np.flatnonzero(behind < 0), rare_buckets):
                word = place[places[t]]
                rows.append(("r", b, batch, packed(found, counts, document[t], np.where(word < 0, CONTEXTS - 1, word).astype(np.uint16), codes[places[t[word < 0]]])))
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("batch", pa.int64()), ("cell", pa.binary())]))

        size = 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text)
                held.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                ids.append(doc)
                size += len(found)
                if size >= TOKENS or len(ids) == DOCUMENTS:
                    yield flush()
                    size = 0
                    if len(words.codes) > REMEMBERED:
                        words = Words()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind string, bucket int, batch long, cell binary")


def merged(table: pa.Table) -> pa.Table:
    """One row per bucket of words: its training pairs (word, context, customers), what the buckets of rare contexts have of
    its words, and its tokens, batch by batch."""
    table = table.sort_by([("kind", "descending"), ("batch", "ascending")])
    own = [k == "n" for k in table["kind"].to_pylist()]
    cells = [unpacked(x.as_py()) for x in table["cell"]]
    asks = [c for c, n in zip(cells, own, strict=True) if not n]
    cells = [c for c, n in zip(cells, own, strict=True) if n]
    none = np.zeros(0, np.uint64)
    codes = np.concatenate([none, *(c[0] for c in cells)])
    asked = np.concatenate([none, *(c[0] for c in asks)])
    known, both = np.unique(np.concatenate([codes, asked]), return_inverse=True)
    word, at = both[: len(codes)], both[len(codes) :]
    counts, context, document = (np.concatenate([np.zeros(0, np.uint16), *(c[i] for c in cells)]) for i in (1, 2, 3))
    training = document >> 15 == 1
    key, customers = np.unique(np.repeat(word, counts)[training] * CONTEXTS + context[training], return_counts=True)
    tokens, dishes = (np.bincount(at, weights=np.concatenate([none, *(c[i] for c in asks)]), minlength=len(known)).astype(np.int64) for i in (1, 2))
    batch = np.asarray(table["batch"])
    n = len(cells)
    cell = packed(batch[:n], np.array([len(c[0]) for c in cells], np.int64), word.astype(np.uint32), counts, context, document & 0x7FFF)
    pairs = packed(np.array([len(known)]), key, customers.astype(np.uint32), tokens, dishes)
    replies = packed(batch[n:], np.array([len(c[0]) for c in asks], np.int64), at.astype(np.uint32))
    return pa.table({"bucket": table["bucket"][:1], "pairs": pa.array([pairs]), "tokens": pa.array([cell]), "asks": pa.array([replies])})


def merged_rare(frequent: np.ndarray):
    """One row per bucket of rare contexts: the codes of its words, its training pairs and its tokens, batch by batch."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        cells = [unpacked(x.as_py()) for x in table["cell"]]
        _, context = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
        counts, document, short, apart = (np.concatenate([c[i] for c in cells]) for i in (1, 2, 3, 4))
        codes = np.empty(len(short), np.uint64)
        there = short < CONTEXTS - 1
        codes[there], codes[~there] = frequent[short[there]] if len(frequent) else 0, apart
        known, word = np.unique(codes, return_inverse=True)
        context = np.repeat(context, counts)
        training = document >> 15 == 1
        key, customers = np.unique(context[training] * len(known) + word[training], return_counts=True)
        pairs = packed(known, np.array([context.max() + 1]), key, customers.astype(np.uint32))
        tokens = packed(np.asarray(table["batch"]), np.array([c[1].sum() for c in cells], np.int64), context.astype(np.uint32), word.astype(np.uint32), document & 0x7FFF)
        return pa.table({"bucket": table["bucket"][:1], "pairs": pa.array([pairs]), "tokens": pa.array([tokens])})

    return merge


def asked_of(codes: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of words that has the root's dish of each code, -1 for heavy words."""
    return np.where(_find(heavy, codes) >= 0, -1, (codes % np.uint64(buckets)).astype(np.int64))


def asks(rare: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(kind, bucket, batch, cell): words that buckets of rare contexts have, their training tokens and dishes, for the
    buckets of these words, -1 for the heavy ones; batch is the bucket that asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known, _, key, customers = unpacked(cell.as_py())
                word, to = key % len(known), asked_of(known, heavy, buckets)
                tokens, dishes = np.bincount(word, weights=customers, minlength=len(known)), np.bincount(word, minlength=len(known))
                out = []
                for b in np.unique(to).tolist():
                    at = to == b
                    out.append(("a", b, bucket, packed(known[at], tokens[at].astype(np.uint32), dishes[at].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("batch", pa.int64()), ("cell", pa.binary())]))

    return rare.select("bucket", "pairs").mapInArrow(run, "kind string, bucket int, batch long, cell binary")


def stirling(discount: float, most: int = EXACT) -> list[np.ndarray]:
    """log S(n, t), t = 1..n: the weight of all seatings of n customers of one dish at t tables."""
    rows = [np.zeros(0), np.zeros(1)]
    for n in range(1, most):
        old, new = rows[-1], np.full(n + 1, -np.inf)
        new[1:] = old
        new[:-1] = np.logaddexp(new[:-1], old + np.log(n - discount * np.arange(1, n + 1)))
        rows.append(new)
    return rows


LOG_STIRLING = [stirling(d) for d in DISCOUNT]


def seated(customers: np.ndarray, opening: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn anew given the weight ``opening`` of a new table.

    Up to EXACT customers the draw is from the full conditional, S(n, t) opening^t; further customers of a dish sit down in
    blocks of an eighth of those seated, each opening a table with the restaurant's odds.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    n = np.minimum(customers[many], EXACT)
    log_open = np.log(np.maximum(opening[many], 1e-300))
    for size in np.unique(n).tolist():
        rows = np.flatnonzero(n == size)
        for part in np.array_split(rows, max(1, len(rows) * size >> 18)):
            logit = LOG_STIRLING[level][size] + log_open[part, None] * np.arange(1, size + 1)
            weight = np.exp(logit - logit.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[many[part]] = 1 + (weight < rng.random(len(part))[:, None] * weight[:, -1:]).sum(axis=1)
    large = np.flatnonzero(customers > EXACT)
    now = np.full(len(large), EXACT)
    while len(large):
        block = np.minimum(np.maximum(now // 8, 1), customers[large] - now)
        odds = opening[large] / (opening[large] + now - DISCOUNT[level] * tables[large])
        tables[large] += rng.binomial(block, np.clip(odds, 0, 1))
        now = now + block
        more = now < customers[large]
        large, now = large[more], now[more]
    return tables


class Totals:
    """Customers and tables of the root and of the restaurants behind frequent words, and the training tokens: what buckets
    share between sweeps."""

    def __init__(self, values: np.ndarray | None = None):
        self.values = np.zeros(3 + 2 * CONTEXTS) if values is None else values
        self.root, self.tokens = self.values[:2], self.values[2:3]
        self.customers, self.tables = self.values[3 : 3 + CONTEXTS], self.values[3 + CONTEXTS :]

    def opening(self) -> np.ndarray:
        return STRENGTH[2] + DISCOUNT[2] * self.tables


class Restaurants:
    """The dishes of one bucket of words behind frequent words, sorted (word, context) pairs, and the root's. ``tokens`` and
    ``dishes`` are the words' behind rare words, whose tables are the root's customers as first seated, one a dish."""

    def __init__(self, words: int, key: np.ndarray, customers: np.ndarray, tokens: np.ndarray | int = 0, dishes: np.ndarray | int = 0):
        self.words, self.key, self.n2, self.dishes = words, key, customers.astype(np.int64), dishes
        self.word, self.context = key // CONTEXTS, key % CONTEXTS
        self.t2 = np.ones(len(key), np.int64)
        self.count = np.bincount(self.word, weights=self.n2, minlength=words).astype(np.int64) + tokens
        self.n0 = np.bincount(self.word, minlength=words) + dishes
        self.t0 = np.minimum(self.n0, 1)

    def totals(self) -> Totals:
        out = Totals()
        out.root[:], out.tokens[:] = (self.n0.sum(), self.t0.sum()), self.count.sum()
        for values, n in ((out.customers, self.n2), (out.tables, self.t2)):
            values[:] = np.bincount(self.context, weights=n, minlength=CONTEXTS)
        return out

    def root(self, all_: Totals, base: float) -> np.ndarray:
        customers, tables = all_.root
        return (self.n0 - DISCOUNT[0] * self.t0 + (STRENGTH[0] + DISCOUNT[0] * tables) * base) / (customers + STRENGTH[0])

    def sweep(self, all_: Totals, base: float, rng: np.random.Generator) -> None:
        """Seat every dish anew behind the words, then at the root; a restaurant's tables are the root's customers."""
        self.t2 = seated(self.n2, all_.opening()[self.context] * self.root(all_, base)[self.word], 2, rng)
        self.n0 = np.bincount(self.word, weights=self.t2, minlength=self.words).astype(np.int64) + self.dishes
        self.t0 = seated(self.n0, np.full(self.words, (STRENGTH[0] + DISCOUNT[0] * all_.root[1]) * base), 0, rng)

    def predict(self, all_: Totals, base: float, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        own = _find(self.key, word * CONTEXTS + context)
        seats = np.where(own >= 0, self.n2[own] - DISCOUNT[2] * self.t2[own], 0) if len(self.key) else np.zeros(len(own))
        return (seats + all_.opening()[context] * self.root(all_, base)[word]) / (all_.customers[context] + STRENGTH[2])


def behind_rare(contexts: int, words: int, key: np.ndarray, customers: np.ndarray, roots: np.ndarray, bucket: int, asked: np.ndarray) -> np.ndarray:
    """Probabilities of ``asked`` pairs (context x words + word) in whole restaurants behind rare words, seated by Gibbs
    sweeps given the root's probabilities of the words (one row a sample) and averaged over the retained samples."""
    rng = np.random.default_rng([17, bucket + 1, 1])
    n, context, word = customers.astype(np.int64), key // words, key % words
    total, tables = np.bincount(context, weights=n, minlength=contexts), np.ones(len(key), np.int64)
    own, out = _find(key, asked), np.zeros(len(asked))
    for k in range(BURN + SAMPLES):
        root = roots[max(0, k - BURN)]
        opening = STRENGTH[1] + DISCOUNT[1] * np.bincount(context, weights=tables, minlength=contexts)
        tables = seated(n, opening[context] * root[word], 1, rng)
        if k >= BURN:
            opening = STRENGTH[1] + DISCOUNT[1] * np.bincount(context, weights=tables, minlength=contexts)
            seats = np.where(own >= 0, n[own] - DISCOUNT[1] * tables[own], 0) if len(key) else np.zeros(len(own))
            out += (seats + opening[asked // words] * root[asked % words]) / (total[asked // words] + STRENGTH[1])
    return out / SAMPLES


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def chain(start: Restaurants, all_: Totals, base: float, bucket: int, burn: int, samples: int) -> Iterator[Restaurants]:
    """The retained states of one bucket. The seed is the bucket's, so every pass and every repeated task sees the same."""
    rng = np.random.default_rng([17, bucket + 1])
    for k in range(burn + samples):
        start.sweep(all_, base, rng)
        if k >= burn:
            yield start


def _restaurants(cell: bytes) -> Restaurants:
    words, *rest = unpacked(cell)
    return Restaurants(int(words[0]), *rest)


def gathered(rows: DataFrame, heavy: tuple, all_: Totals | None, base: float, burn: int, samples: int) -> list[Totals]:
    """Totals over all buckets of the first seating (one table a dish), or of every retained sample."""

    def states(bucket: int, cell: bytes) -> Iterator[Totals]:
        start = _restaurants(cell)
        if all_ is None:
            yield start.totals()
        else:
            yield from (s.totals() for s in chain(start, all_, base, bucket, burn, samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, t in enumerate(states(bucket, cell.as_py())):
                    sums[k] = sums.get(k, 0) + t.values
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(v[at])], ["k", "at", "v"])

    got = fetched(rows.select("bucket", "pairs").mapInArrow(run, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")))  # a bounded number of restaurants
    out = [Totals() for _ in range(1 if all_ is None else samples)]
    for k, own in enumerate(states(*heavy)):
        out[k].values[:] = own.values
    for k, part in got.groupby("k"):
        out[k].values[part["at"].to_numpy()] += part["v"].to_numpy()
    return out


def heavy_pairs(rows: DataFrame, asked: DataFrame, heavy: np.ndarray) -> bytes:
    """Training pairs of the heavy words, at most HEAVY x CONTEXTS counts, and their tokens and dishes behind rare words, summed
    by Spark."""
    words = max(1, len(heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(max(1, len(heavy)) * CONTEXTS, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                word, context, document = unpacked(cell.as_py())
                sums += np.bincount((word.astype(np.int64) * CONTEXTS + context)[document >> 15 == 1], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["key", "n"])

    got = fetched(rows.select("cell").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))).sort_values("key")

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, words), np.int64)
        for batch in batches:
            for cell in batch.column(0):
                codes, *numbers = unpacked(cell.as_py())
                sums[:, _find(heavy, codes)] += np.stack(numbers).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(words)), pa.array(sums[0]), pa.array(sums[1])], ["word", "tokens", "dishes"])

    rare = fetched(asked.select("cell").mapInArrow(behind, "word long, tokens long, dishes long").groupBy("word").agg(F.sum("tokens").alias("tokens"), F.sum("dishes").alias("dishes")))
    tokens, dishes = np.zeros((2, len(heavy)), np.int64)
    if len(heavy):
        tokens[rare["word"]], dishes[rare["word"]] = rare["tokens"], rare["dishes"]
    return packed(np.array([len(heavy)]), got["key"].to_numpy(np.int64), got["n"].to_numpy().astype(np.uint32), tokens, dishes)


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (runs of non-blanks, A-Z lower-cased) and one end per text; a null text is its end alone. The model
    is a hierarchical Pitman-Yor process over words: every word has the restaurant of what follows it, whose parent is the
    root, whose base is uniform over the training words and one unknown word. Restaurants are seated in parallel by Gibbs
    sweeps, and predictive probabilities are averaged over the retained samples.

    Tokens behind the most frequent words are dealt by word, so that a bucket has the root's dishes of its words; of these
    restaurants it needs the totals from the pass before, a table of CONTEXTS rows. Tokens behind all other words are dealt
    by that word, so that a bucket has these restaurants whole; it asks the buckets of its words for the root's
    probabilities. No task or driver holds the vocabulary. The few words with a large share of all tokens
    (counted over all whole texts) stay where they are and are scored from a table of at most HEAVY x CONTEXTS
    probabilities, so no bucket holds a word with more than 1 / HEAVY of the tokens. Rows without doc_id are for
    training. Repeated doc_ids stay separate rows; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    heavy, frequent = frequent_words(docs)
    buckets = BUCKETS * partitions(spark)
    dealt = scratch(spark, "lm-tokens")
    tokens = kept(token_batches(docs, heavy, frequent, buckets, partitions(spark)), dealt, "kind")
    rare = kept(tokens.where("kind = 'r'").groupBy("bucket").applyInArrow(merged_rare(frequent), "bucket int, pairs binary, tokens binary"), scratch(spark, "lm-rare"))
    dropped(spark, f"{dealt}/kind=r")  # its rows are in lm-rare, as those of kind n are in lm-buckets
    asked = kept(asks(rare, heavy, buckets), scratch(spark, "lm-asks"))
    both = tokens.where("kind = 'n'").unionByName(asked.where("bucket >= 0"))
    rows = kept(both.groupBy("bucket").applyInArrow(merged, "bucket int, pairs binary, tokens binary, asks binary"), scratch(spark, "lm-buckets"))
    dropped(spark, f"{dealt}/kind=n")
    hot = (-1, heavy_pairs(tokens.where("kind = 'h'"), asked.where("bucket < 0"), heavy))
    first = gathered(rows, hot, None, 0.0, 0, 1)[0]
    train_tokens = int(first.tokens[0])
    words = int(first.root[1])
    base = 1 / (words + 1)
    settled = gathered(rows, hot, first, base, BURN, 1)[0]
    samples = gathered(rows, hot, settled, base, BURN, SAMPLES)

    def states(bucket: int, start: Restaurants) -> list[Restaurants]:
        return [copy(s) for s in chain(start, settled, base, bucket, BURN, SAMPLES)]

    def probabilities(seatings: list[Restaurants], word: np.ndarray, context: np.ndarray) -> np.ndarray:
        each = (s.predict(t, base, word, context) for s, t in zip(seatings, samples, strict=True))
        return np.log10(np.maximum(sum(each) / SAMPLES, 1e-300))

    def roots(seatings: list[Restaurants]) -> np.ndarray:
        return np.stack([s.root(t, base) for s, t in zip(seatings, samples, strict=True)])

    def base_log(counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (train_tokens + words + 1))

    def sums(document: np.ndarray, count: np.ndarray, plain: np.ndarray, model: np.ndarray) -> bytes:
        there, at = np.unique(document, return_inverse=True)
        known = np.bincount(at, weights=count > 0, minlength=len(there)).astype(np.uint32)
        return packed(there.astype(np.uint16), known, np.bincount(at, weights=plain, minlength=len(there)), np.bincount(at, weights=model, minlength=len(there)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def send() -> pa.RecordBatch:
            cells = [packed(np.arange(v.shape[1]).astype(np.uint16), v[0].astype(np.uint32), v[1], v[2]) for v in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(cells, pa.binary())], ["batch", "cell"])

        for rows_ in batches:
            for bucket, pairs, cell in zip(rows_.column(0).to_pylist(), rows_.column(1), rows_.column(2), strict=True):
                ids, sizes, word, counts, context, document = unpacked(cell.as_py())
                start = _restaurants(pairs.as_py())
                seatings = states(bucket, start)
                # some batches at a time: words first, then their tokens
                words_at = np.concatenate([[0], np.cumsum(sizes)])
                tokens_at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[words_at]
                cuts = [0, *(np.flatnonzero(np.diff(tokens_at[1:] // CHUNK)) + 1).tolist(), len(sizes)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    w, t = slice(words_at[i], words_at[j]), slice(tokens_at[i], tokens_at[j])
                    key, back = np.unique(np.repeat(word[w].astype(np.int64), counts[w]) * CONTEXTS + context[t], return_inverse=True)
                    model = probabilities(seatings, key // CONTEXTS, key % CONTEXTS)[back]
                    count = start.count[key // CONTEXTS][back]
                    plain, edges = base_log(count), tokens_at[i : j + 1] - tokens_at[i]
                    for batch, a, b in zip(ids[i:j].tolist(), edges[:-1], edges[1:], strict=True):
                        at = document[t][a:b]
                        wide = max(held[batch].shape[1] if batch in held else 0, int(at.max()) + 1)
                        new = np.stack([np.bincount(at, weights=x[a:b], minlength=wide) for x in (count > 0, plain, model)])
                        if batch in held:
                            new[:, : held[batch].shape[1]] += held[batch]
                            size -= held[batch].size
                        held[batch] = new
                        size += new.size
                    if size > SUMS:
                        yield send()
                        held, size = {}, 0
        if held:
            yield send()

    start = _restaurants(hot[1])
    hot_count = start.count
    hot_roots = roots(states(-1, start))
    grid = np.arange(len(heavy) * CONTEXTS)
    hot_log = spark.sparkContext.broadcast(probabilities(states(-1, start), grid // CONTEXTS, grid % CONTEXTS).astype("f4"))  # HEAVY x CONTEXTS numbers

    def score_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in batches:
            out = []
            for cell in rows_.column(1):
                word, context, document = unpacked(cell.as_py())
                count = hot_count[word]
                out.append(sums(document & 0x7FFF, count, base_log(count), hot_log.value[word.astype(np.int64) * CONTEXTS + context].astype("f8")))
            yield pa.RecordBatch.from_arrays([rows_.column(0), pa.array(out, pa.binary())], ["batch", "cell"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in batches:
            for bucket, pairs, cell in zip(rows_.column(0).to_pylist(), rows_.column(1), rows_.column(2), strict=True):
                to, sizes, word = unpacked(cell.as_py())
                if len(to):
                    start = _restaurants(pairs.as_py())
                    values = roots(states(bucket, start))
                    cells = [packed(start.count[w], *values[:, w].astype("f4")) for w in np.split(word, np.cumsum(sizes)[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([bucket] * len(to), pa.int32()), pa.array(cells, pa.binary())], ["bucket", "source", "reply"])

    def rare_cells(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The tokens of a bucket of rare contexts, given the replies of the buckets of its words: per batch its documents and
        their sums."""
        bucket, sources = table["bucket"][0].as_py(), table["source"].to_pylist()
        at = sources.index(None)
        known, contexts, key, customers = unpacked(table["pairs"][at].as_py())
        of = asked_of(known, heavy, buckets)
        count, root = np.zeros(len(known), np.int64), np.zeros((SAMPLES, len(known)))
        place = _find(heavy, known[of < 0])
        if len(place):
            count[of < 0], root[:, of < 0] = hot_count[place], hot_roots[:, place]
        for source, cell in zip(sources, table["reply"], strict=True):
            if source is not None:
                n, *values = unpacked(cell.as_py())
                count[of == source], root[:, of == source] = n, np.stack(values)
        batch, sizes, context, word, document = unpacked(table["tokens"][at].as_py())
        pair, back = np.unique(context.astype(np.int64) * len(known) + word, return_inverse=True)
        model = np.log10(np.maximum(behind_rare(int(contexts[0]), len(known), key, customers, root, bucket, pair), 1e-300))[back]
        count = count[word]
        plain, edges = base_log(count), np.concatenate([[0], np.cumsum(sizes)]).tolist()
        for b, i, j in zip(batch.tolist(), edges[:-1], edges[1:], strict=True):
            yield b, document[i:j], np.stack([count[i:j] > 0, plain[i:j], model[i:j]])

    def score_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets of a task, sorted, in the worker that also combines them: one cell per batch of documents for all of
        them, as far as memory goes."""
        held: dict[int, np.ndarray] = {}
        size = 0

        def send() -> pa.RecordBatch:
            cells = [packed(np.arange(v.shape[1]).astype(np.uint16), v[0].astype(np.uint32), v[1], v[2]) for v in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(cells, pa.binary())], ["batch", "cell"])

        for table in run_chunks(batches, ["bucket"], 1):
            for batch, at, values in rare_cells(table):
                old = held.get(batch, np.zeros((3, 0)))
                wide = max(old.shape[1], int(at.max()) + 1)
                new = np.stack([np.bincount(at, weights=v, minlength=wide) for v in values])
                new[:, : old.shape[1]] += old
                held[batch] = new
                size += new.size - old.size
                if size > SUMS:
                    yield send()
                    held, size = {}, 0
        if held:
            yield send()

    def whole(table: pa.Table) -> pa.Table:
        there = table["docs"].to_pylist()
        known, ids, sizes = unpacked(next(cell for cell, own in zip(table["cell"].to_pylist(), there, strict=True) if own))
        out = np.zeros((3, len(ids)))
        for cell, own in zip(table["cell"].to_pylist(), there, strict=True):
            if not own:
                at, *values = unpacked(cell)
                for k, v in enumerate(values):
                    out[k, at] += v
        docs_ = pa.array(ids, mask=~known)
        held = np.array([is_held(d) for d in docs_.to_pylist()])
        return pa.table({"doc_id": docs_, "held_out": held, "n_tokens": sizes.astype(np.int64), "n_known": out[0].astype(np.int64), "train_tokens": np.full(len(ids), train_tokens), "base_score": out[1], "score": out[2]})

    replies = rows.select("bucket", "pairs", "asks").mapInArrow(reply, "bucket int, source int, reply binary")
    answered = rare.unionByName(replies, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")
    behind = answered.mapInArrow(score_rare, "batch long, cell binary")
    parts = rows.select("bucket", "pairs", "tokens").mapInArrow(score, "batch long, cell binary").unionByName(behind)
    parts = parts.unionByName(tokens.where("kind = 'h'").select("batch", "cell").mapInArrow(score_heavy, "batch long, cell binary"))
    parts = parts.withColumn("docs", F.lit(False)).unionByName(tokens.where("kind = 'd'").select("batch", "cell", F.lit(True).alias("docs")))
    return parts.groupBy("batch").applyInArrow(whole, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
