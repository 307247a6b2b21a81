"""The corpus pipeline: stages that each take and keep documents, the last of which packs them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact, langid, packing, pii, simhash
from quire.llm.common import shared_root

#: A document stays if its text has a letter and some language holds more than its bytes' even share by this factor.
MIN_LEAD = 1.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told (no letters, or no language prevails).

    Rows are judged one by one, with or without a doc_id and however often it occurs; without labelled rows none is told.
    """
    network = langid.train(docs)
    least = MIN_LEAD / len(network.labels) if network and len(network.labels) > 1 else 0
    return langid.labelled(docs, network).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep one row: with the smallest doc_id, or any if none has one."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keep one row: with the smallest doc_id, or any if none has one."""
    return simhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values; a text's length column follows its new text."""
    clean = pii.pseudonymised(docs).withColumn("n_chars", F.when(F.col("n_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into token sequences."""
    return packing.packed(docs)


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    root = f"{shared_root(spark)}/quire-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


#: A trained network, fingerprints by a seeded hash and tokenizer ids have no SQL form.
ORACLE_SQL = None
