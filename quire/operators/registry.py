"""A versioned template registry as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Version pattern and layout defaults.
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"
LAYOUT_DEFAULTS = {"width_in": 8.5, "height_in": 11.0, "top_in": 1.0, "right_in": 1.0, "bottom_in": 1.0, "left_in": 1.0}
STYLE_DEFAULTS = {"font_name": "Calibri", "font_size_pt": 11.0, "line_spacing": 1.15}


def canonical_json(header_footer: Column, page_layout: Column, styles: Column) -> Column:
    """Compact JSON with sorted keys: structs are passed with sorted fields, map entries are sorted here."""
    sorted_styles = F.map_from_entries(F.array_sort(F.map_entries(styles)))
    return F.to_json(
        F.struct(header_footer.alias("header_footer"), page_layout.alias("page_layout"), sorted_styles.alias("styles"))
    )


def checksum(payload: Column) -> Column:
    return F.sha2(payload, 256)


def integrity(templates: DataFrame) -> DataFrame:
    """Rows whose stored checksum differs from the one recomputed from the payload."""
    t = templates.withColumn("computed", checksum(F.col("payload")))
    return t.filter(F.col("stored") != F.col("computed")).select("template_id", "version", "stored", "computed")


def valid_version(version: Column) -> Column:
    return version.rlike(SEMVER)


def version_key(version: Column) -> Column:
    return F.split(version, "[.]").cast("array<decimal(38,0)>")


def latest_live(templates: DataFrame) -> DataFrame:
    """template_id, latest: highest valid, non-deprecated version in numeric order (a plain max, no sort)."""
    live = templates.filter(~F.col("deprecated") & valid_version(F.col("version")))
    return live.groupBy("template_id").agg(F.max(F.struct(version_key(F.col("version")).alias("k"), "version")).alias("m")).select(
        "template_id", F.col("m.version").alias("latest")
    )


# The hint texts.
MIGRATE = "Please migrate to "
NO_VERSION = "No non-deprecated version is available."


def deprecation_report(templates: DataFrame) -> DataFrame:
    """Deprecated versions with a migration hint."""
    old = templates.filter("deprecated").select("template_id", "version").distinct()
    hint = F.when(
        F.col("latest").isNotNull(), F.concat(F.lit(MIGRATE), "template_id", F.lit("@"), "latest", F.lit("."))
    ).otherwise(NO_VERSION)
    return old.join(latest_live(templates), "template_id", "left").select("template_id", "version", hint.alias("hint"))


def key_violations(templates: DataFrame) -> DataFrame:
    return templates.groupBy("template_id", "version").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def append_only(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Rows of ``incoming`` that may be appended: key not present yet, first row per key."""
    keys = ["template_id", "version"]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in keys]), order).alias("r"))
    fresh = first.join(existing.select(*keys), keys, "left_anti")
    return fresh.select(*keys, "r.*")


def layout_failures(layouts: DataFrame) -> DataFrame:
    """template key and reason of every layout that breaks a rule. Measures are in inches."""
    measures = ["width", "height", "margin_top", "margin_right", "margin_bottom", "margin_left"]
    positive = F.lit(True)
    for m in measures:
        positive = positive & (F.col(m) > 0)
    usable = (F.col("width") - F.col("margin_left") - F.col("margin_right") > 0) & (
        F.col("height") - F.col("margin_top") - F.col("margin_bottom") > 0
    )
    reasons = F.array_compact(
        F.array(
            F.when(~positive, "measure_not_positive"),
            F.when(~usable, "no_usable_area"),
            F.when(F.col("keep_with_next") & F.col("force_page_break_before"), "flag_conflict"),
            F.when(F.trim("title") == "", "empty_text"),
        )
    )
    return layouts.select("id", F.explode(reasons).alias("reason"))


def ragged_tables(cells: DataFrame) -> DataFrame:
    """table_id, min_cells, max_cells of tables whose rows differ in cell count."""
    rows = cells.groupBy("table_id", "row_no").agg(F.count("*").alias("n"))
    return rows.groupBy("table_id").agg(F.min("n").alias("min_cells"), F.max("n").alias("max_cells")).filter(
        F.col("min_cells") != F.col("max_cells")
    )


def unknown_styles(elements: DataFrame, styles: DataFrame) -> DataFrame:
    """doc, style, uses of styles a document does not define."""
    used = elements.groupBy("doc", "style").agg(F.count("*").alias("uses"))
    return used.join(styles.select("doc", "style"), ["doc", "style"], "left_anti")


LAYOUT_SCHEMA = "size STRUCT<width_in: DOUBLE, height_in: DOUBLE>, margins STRUCT<top_in: DOUBLE, right_in: DOUBLE, bottom_in: DOUBLE, left_in: DOUBLE>"


def layout_columns(layout_json: Column) -> dict[str, Column]:
    """Page layout of a template with defaults for what is missing."""
    j = F.from_json(layout_json, LAYOUT_SCHEMA)
    return {
        k: F.coalesce(j["size" if k in ("width_in", "height_in") else "margins"][k], F.lit(v)) for k, v in LAYOUT_DEFAULTS.items()
    }


STYLES_SCHEMA = "MAP<STRING, STRUCT<font_name: STRING, font_size_pt: DOUBLE, line_spacing: DOUBLE, keep_with_next: BOOLEAN, space_after_pt: DOUBLE>>"


def style_rows(templates: DataFrame, styles_json: str) -> DataFrame:
    """One row per template style with defaults; zero spacing becomes null."""
    rows = templates.select("template_id", "version", F.explode(F.from_json(styles_json, STYLES_SCHEMA)).alias("style", "p"))
    return rows.select(
        "template_id",
        "version",
        "style",
        F.coalesce("p.font_name", F.lit(STYLE_DEFAULTS["font_name"])).alias("font_name"),
        F.coalesce("p.font_size_pt", F.lit(STYLE_DEFAULTS["font_size_pt"])).alias("font_size_pt"),
        F.coalesce("p.line_spacing", F.lit(STYLE_DEFAULTS["line_spacing"])).alias("line_spacing"),
        F.coalesce("p.keep_with_next", F.lit(False)).alias("keep_with_next"),
        F.when(F.col("p.space_after_pt") > 0, F.col("p.space_after_pt")).alias("space_after_pt"),
    )
