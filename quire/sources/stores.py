"""Stored tables: history reads, registry scans, appends and inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T


def user_history(reports: DataFrame, user_id: int) -> DataFrame:
    """Reports of one user, newest first, null times last. The equality reaches the scan."""
    return reports.filter(F.col("user_id") == user_id).orderBy(F.col("created_at").desc_nulls_last(), "report_id")


def registry_jdbc(spark: SparkSession, url: str, dbtable: str, bounds: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Registry table over JDBC; bounds (column, lower, upper, partitions) split the read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if bounds:
        col, lo, hi, n = bounds
        reader = (
            reader.option("partitionColumn", col).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", n)
        )
    return reader.load()


def list_versions(templates: DataFrame, template_id: str) -> DataFrame:
    return templates.filter(F.col("template_id") == template_id)


def exists(templates: DataFrame, template_id: str, version: str) -> DataFrame:
    """One row, one column ``present``; the scan stops at the first hit."""
    hit = templates.filter((F.col("template_id") == template_id) & (F.col("version") == version)).limit(1)
    return hit.agg((F.count("*") > 0).alias("present"))


def rules_records(rules: DataFrame, name: Column, kind: Column, notes: Column) -> DataFrame:
    """Storable records: id, time, name, type (generic when blank), notes, status."""
    kind = F.coalesce(F.nullif(T.strip(kind), F.lit("")), F.lit("generic"))
    return rules.select(
        F.uuid().alias("rules_id"),
        F.current_timestamp().alias("created_at"),
        F.coalesce(name, F.lit("")).alias("document_name"),
        kind.alias("document_type"),
        F.coalesce(notes, F.lit("")).alias("notes"),
        F.lit("active").alias("status"),
        F.struct(*rules.columns).alias("rules"),
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def save_documents(docs: DataFrame, table: str, buckets: int, path: str) -> None:
    """Store documents bucketed by ``doc_id``: block, section and score jobs on the table then need no exchange of text."""
    docs.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", path).saveAsTable(table)


def absent_users(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users to insert: not stored yet; a blank name becomes the part of the e-mail before the at sign."""
    fresh = incoming.join(existing.select("user_id"), "user_id", "left_anti")
    name = F.coalesce(F.nullif("name", F.lit("")), F.split("email", "@")[0])
    return fresh.select("user_id", "email", name.alias("name"))
