"""Preset catalogue: search, duplicates, import merge, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T

FIELDS = ["bodyFont", "bodySizePt", "marginTopIn", "marginLeftIn", "marginBottomIn", "marginRightIn", "lineSpacingPt"]

# Named presets (font, size, the four margins, line spacing).
NAMED = {
    "academic": ("Times New Roman", "12", "1.0", "24.0"),
    "formal": ("Calibri", "11", "0.75", "16.5"),
    "compact": ("Arial", "10", "0.5", "12.0"),
    "generous": ("Calibri", "12", "1.5", "24.0"),
    "minimal": ("Courier", "10", "0.25", "12.0"),
}


def normalise(presets: DataFrame) -> DataFrame:
    """Names trimmed (empty ones dropped), null fields to '', empty category to general, blank tags removed."""
    name = T.strip(F.coalesce("name", F.lit("")))
    tags = F.filter(F.transform("tags", T.strip), lambda t: t != "")
    return presets.select(
        name.alias("name"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("general")).alias("category"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS],
    ).filter(F.col("name") != "")


def search(
    presets: DataFrame, term: str, category: str = "all", favourites: DataFrame | None = None, default: str = ""
) -> DataFrame:
    """Presets whose name, category or tags contain the term; favourites first, then the default one, then by name."""
    hay = F.lower(F.concat("name", F.lit(" "), "category", F.lit(" "), F.array_join("tags", " ")))
    hits = presets.filter(hay.contains(term.strip().lower()))
    if favourites is not None:
        hits = hits.join(favourites.select("name", F.lit(True).alias("favourite")), "name", "left")
    else:
        hits = hits.withColumn("favourite", F.lit(False))
    hits = hits.withColumn("favourite", F.coalesce("favourite", F.lit(False)))
    if category == "favorites":
        hits = hits.filter("favourite")
    elif category != "all":
        hits = hits.filter(F.col("category") == category)
    return hits.orderBy(F.desc("favourite"), F.col("name") != default, "name")


def duplicates(presets: DataFrame) -> DataFrame:
    """name, duplicate: first other preset with the same seven fields. Minima only, so a field set shared by very many
    presets is never gathered."""
    first = presets.groupBy(*FIELDS).agg(F.min("name").alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    tagged = presets.join(first, FIELDS)
    second = tagged.filter(F.col("name") > F.col("_first")).groupBy(*FIELDS).agg(F.min("name").alias("_second"))
    return tagged.join(second, FIELDS).select(
        "name", F.when(F.col("name") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("duplicate")
    )


def import_merge(existing: DataFrame, incoming: DataFrame, strategy: str) -> DataFrame:
    """name, origin, outcome of merging two catalogues with unique names.

    skip keeps the existing one, overwrite takes the new one, rename adds the smallest free `` (n)`` suffix, n >= 2.
    """
    e = existing.select("name", F.lit(True).alias("_old"))
    i = incoming.select("name", F.lit(True).alias("_new"))
    j = e.join(i, "name", "full_outer")
    clash = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    j = j.withColumn("outcome", F.when(clash, F.lit(strategy)).when(F.col("_new").isNotNull(), "imported").otherwise("kept"))
    if strategy != "rename":
        origin = F.when((F.col("outcome") == "kept") | (F.col("outcome") == "skip"), "existing").otherwise("incoming")
        return j.select("name", origin.alias("origin"), "outcome")
    taken = existing.select("name").unionByName(incoming.select("name")).distinct()
    parts = taken.select(
        F.regexp_extract("name", r"^(.*) \((\d+)\)$", 1).alias("base"),
        F.regexp_extract("name", r"^(.*) \((\d+)\)$", 2).try_cast("int").alias("n"),
    ).filter(F.col("n") >= 2)
    # Suffixes 2, 3, ... are used without a gap as long as the suffix equals its rank + 1.
    w = Window.partitionBy("base").orderBy("n")
    used = (
        parts.distinct()
        .withColumn("r", F.row_number().over(w))
        .groupBy("base")
        .agg(F.count_if(F.col("n") == F.col("r") + 1).alias("used"))
    )
    kept = j.select("name", F.when(F.col("_old").isNotNull(), "existing").otherwise("incoming").alias("origin"),
                    F.when(F.col("outcome") == "rename", "kept").otherwise(F.col("outcome")).alias("outcome"))
    renamed = (
        j.filter(F.col("outcome") == "rename")
        .join(used.withColumnRenamed("base", "name"), "name", "left")
        .select(
            F.concat("name", F.lit(" ("), (F.coalesce("used", F.lit(0)) + 2).cast("string"), F.lit(")")).alias("name"),
            F.lit("incoming").alias("origin"),
            F.lit("renamed").alias("outcome"),
        )
    )
    return kept.unionByName(renamed)


def named_presets(spark: SparkSession) -> DataFrame:
    rows = [(k, f, s, m, m, m, m, sp) for k, (f, s, m, sp) in NAMED.items()]
    return spark.createDataFrame(rows, "preset string, " + ", ".join(f"{f} string" for f in FIELDS))


def expand_named(rows: DataFrame, presets: DataFrame) -> DataFrame:
    """Apply a row's named preset over its fields; an unknown preset changes nothing. ``presets`` has five rows."""
    p = presets.select("preset", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    return rows.join(F.broadcast(p), "preset", "left").select(
        "name", "preset", *[F.coalesce(f"_{f}", f).alias(f) for f in FIELDS]
    )
