"""Helpers shared by the operators: shared storage, bounded Arrow batches, sorted runs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Blank characters of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"


@cache
def _own_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="quire-llm-")


def shared_root(spark: SparkSession) -> str:
    """The folder all machines share, as the session names it; a session on this machine alone without the setting, as in
    tests, gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_root(context.applicationId)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path on the shared storage."""
    return f"{shared_root(spark)}/quire-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and a lost executor costs no recomputation."""
    return saved_to(scratch(df.sparkSession, name), df)


def saved_to(path: str, df: DataFrame, by: str | None = None) -> DataFrame:
    """As ``saved``; the values of a column ``by`` get folders of their own."""
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete what ``saved_to`` wrote and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which a cluster sets in proportion to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_in(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``, at least one row."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0))
        start, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def run_chunks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Cut a partition sorted by ``keys`` into tables of about ``rows`` rows that never split a run of equal keys."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            values = np.asarray(table.column(key))
            new[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(new)
        start = 0
        while len(cuts) and cuts[-1] > start:
            wanted = cuts[np.searchsorted(cuts, min(start + rows, cuts[-1]))]
            yield table.slice(start, wanted - start)
            start = int(wanted)
        held, count = [table.slice(start)], table.num_rows - start
    if count:
        yield pa.concat_tables(held).combine_chunks()


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` places, the smallest place reachable over the pairs (left, right)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
