"""Exact de-duplication by sorting whole contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import BLANK, partitions, saved

#: A group of equal texts is sorted as at least so many runs, or as many as the shuffle has partitions, so a third of all rows
#: being copies still spreads over all tasks.
SALTS = 64
#: Characters of a text that splitters hold; texts with the same beginning are told apart by a hash, then in full.
PREFIX = 32


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, " ")


def ranked(docs: DataFrame, row: Column, salts: int | None = None) -> DataFrame:
    """row, doc_id, keep_id, group_size, text_sha256 and head, true for one row of each group of equal texts: one with the
    smallest doc_id, or any if none has one."""
    salts = salts or max(SALTS, partitions(docs.sparkSession))
    # rows without doc_id are dealt by their place, so that they do not all share a salt
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string"))), F.lit(salts))
    keyed = docs.select(row.alias("row"), "doc_id", normalised().alias("_text"), salt.alias("_salt"))
    keyed = keyed.withColumn("_start", F.substring("_text", 1, PREFIX)).withColumn("_hash", F.xxhash64("_text"))
    ranged = keyed.repartitionByRange("_start", "_hash", "_salt")
    run = W.partitionBy("_start", "_hash", "_text", "_salt").orderBy(F.col("doc_id").asc_nulls_last())
    rows = ranged.select("row", "doc_id", "_salt", F.row_number().over(run).alias("_place"), F.sha2("_text", 256).alias("text_sha256"))
    rows = saved(rows, "runs")
    runs = rows.groupBy("text_sha256", "_salt").agg(F.min("doc_id").alias("_low"), F.count("*").alias("_n"))
    whole = W.partitionBy("text_sha256")
    first = F.min(F.struct(F.col("_low").isNull().alias("none"), F.col("_low"), F.col("_salt"))).over(whole)
    runs = runs.select("_salt", F.col("text_sha256").alias("_sha"), F.min("_low").over(whole).alias("keep_id"), F.sum("_n").over(whole).alias("group_size"), first["_salt"].alias("_first"))
    runs = runs.withColumnRenamed("_salt", "_of")
    found = rows.join(runs, (F.col("text_sha256") == F.col("_sha")) & (F.col("_salt") == F.col("_of")))
    head = (F.col("_place") == 1) & (F.col("_salt") == F.col("_first"))
    return found.select("row", "doc_id", "keep_id", "group_size", head.alias("head"), "text_sha256")


def exact_groups(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after every run of blanks is one space; null counts as empty. Content sort: Spark samples
    splitters over (beginning, hash, salt) and deals rows into ranges, each range is sorted externally by these and the
    whole text, neighbours that are equal in full form a run whose head is its smallest doc_id, and the heads of a text's
    few runs are merged. Only this pass moves texts. Rows with a repeated doc_id are rows of their own, all kept if theirs is
    the smallest. A row without doc_id stays only if no row of its group has one, and then only one of them does. Other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    found = ranked(docs, F.lit(None), salts)
    kept = F.when(F.col("keep_id").isNull(), F.col("head")).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: one with the smallest doc_id, or any if none has one.

    Rows take their columns along when texts are dealt, so repeated and missing doc_ids need no key.
    """
    return ranked(docs, F.struct("*")).where("head").select("row.*")
