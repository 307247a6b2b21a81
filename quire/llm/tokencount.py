"""Token counts from flat token files that have no index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.bpe import binary_column, memo
from quire.llm.common import shared_root, slices, texts_in

#: End-of-document identifier of the public vocabulary, and documents written to one file.
END, PER_FILE = 50256, 5000
BLOCK = 1 << 20
#: Text that a worker encodes at a time.
TEXT_BYTES = 2 << 20


def write_token_files(docs: DataFrame, path: str, end: int = END, vocabulary: str | None = None) -> None:
    """Write each partition's documents as flat unsigned 16-bit ids, the end identifier after every document.

    Spark's text writer commits the files: a row is a document's id bytes and the line separator is the end identifier, so
    lost tasks leave nothing behind. Null texts are empty documents. Ids must be below 65,536, which is checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = memo(vocabulary)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, counts = table.documents(texts_in(batch))
            if len(ids) and (ids.max() > 0xFFFF or (ids == end).any()):
                raise ValueError("an id is the end identifier or does not fit in 16 bits")
            yield pa.RecordBatch.from_arrays([binary_column(ids.astype("<u2"), counts)], ["ids"])

    separator = int(end).to_bytes(2, "little").decode("latin-1")
    rows = docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", PER_FILE).text(path)


def scan_block_counts(tokens: np.ndarray, end: int, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """Counts before each separator of an array searched block by block, and the count after the last one.

    Blocks are searched alone; a document's count is its separator's place less the one before, and a block without any
    passes the last place on: an exclusive prefix maximum over the blocks.
    """
    found = [np.flatnonzero(tokens[b : b + block] == end) + b for b in range(0, len(tokens), block)]
    last = np.maximum.accumulate([-1, *(int(f[-1]) if len(f) else -1 for f in found)])
    counts = [np.diff(f, prepend=carry) - 1 for f, carry in zip(found, last[:-1], strict=True)]
    return np.concatenate(counts) if counts else np.empty(0, np.int64), len(tokens) - 1 - int(last[-1])


def token_counts(spark: SparkSession, path: str, width: int = 2, end: int = END) -> DataFrame:
    """One row per document of the files under ``path``: stream, ordinal, file, start, n_tokens (its end not counted).

    Files are flat little-endian ids of ``width`` bytes. Numbered parts of one writer (same name up to ``-c000``) are one
    stream, in order; a document may run over any number of them. Tokens after a stream's last separator are its last
    document; an empty file adds nothing.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(content.as_buffer() or b"", kind)
                counts, tail = scan_block_counts(tokens, end)
                n = len(counts)
                columns = [pa.array([name] * (n + 1)), pa.array(np.arange(n + 1)), pa.array(np.append(counts, tail)), pa.array(np.append(np.zeros(n, bool), True))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "k", "n", "tail"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    rows = files.mapInArrow(scan, "file string, k long, n long, tail boolean")
    rows = rows.withColumn("stream", F.regexp_replace("file", r"[-.]c\d+(\.\w+)*$", ""))
    # One row per file is stitched; documents only join their file's carry.
    in_stream = W.partitionBy("stream").orderBy("_file")
    before = in_stream.rowsBetween(W.unboundedPreceding, -1)
    tails = rows.where("tail").select("stream", F.col("file").alias("_file"), F.col("k").alias("_ends"), F.col("n").alias("_left"))
    tails = tails.withColumns({"base": F.coalesce(F.sum("_ends").over(before), F.lit(0)), "_run": F.sum((F.col("_ends") > 0).cast("int")).over(in_stream)})
    tails = tails.withColumn("_sofar", F.sum("_left").over(W.partitionBy("stream", "_run").orderBy("_file")))
    tails = tails.select("_file", "base", F.coalesce(F.lag("_sofar").over(in_stream), F.lit(0)).alias("carry"), F.lead("_file").over(in_stream).isNull().alias("last"))
    joined = rows.join(tails, rows["file"] == tails["_file"])
    count = F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    kept = joined.select("stream", (F.col("base") + F.col("k")).alias("ordinal"), "file", count.alias("n_tokens"), "tail", "last").where("not tail or (last and n_tokens > 0)")
    start = F.sum(F.col("n_tokens") + 1).over(W.partitionBy("stream").orderBy("ordinal")) - F.col("n_tokens") - 1
    return kept.select("stream", "ordinal", "file", start.alias("start"), "n_tokens")


def document_token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) of every document, through token files in the shared folder.

    ``docs`` is a plain table scan, whose partitions and row order repeat: the same scan without texts gives the order of
    identifiers in each written part. A part whose numbers of documents and identifiers differ raises an error.
    """
    spark = docs.sparkSession
    path = f"{shared_root(spark)}/quire-tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary=vocabulary)
    found = token_counts(spark, path).withColumn("part", F.regexp_extract("stream", r"part-(\d+)", 1).cast("int"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], ["doc_id", "part", "ordinal"])
            seen += n

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(order, "doc_id long, part int, ordinal long")
    both = ids.withColumn("_id", F.lit(True)).join(found, ["part", "ordinal"], "full_outer")
    lost = F.col("n_tokens").isNull() | F.col("_id").isNull()
    count = F.when(lost, F.raise_error(F.lit("documents and token files differ"))).otherwise(F.col("n_tokens"))
    return both.select("doc_id", "file", "ordinal", "start", count.cast("long").alias("n_tokens"))
