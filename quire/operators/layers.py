"""Layered rule sets in long form ``(entity, key, value, priority, seq, source)`` and in wide form.

Merges are partial aggregates (max_by), so an entity with a huge number of rule rows is combined before the shuffle.
Nested settings use dotted keys (``headings.1.font``), which merges nested maps by leaf.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.units import TWIPS_PER_POINT

# System defaults of the merged rules.
DEFAULTS = {
    "page_width_dxa": "11906",
    "page_height_dxa": "16838",
    "margin_top_dxa": "1440",
    "margin_bottom_dxa": "1440",
    "margin_left_dxa": "1800",
    "margin_right_dxa": "1800",
    "margin_header_dxa": "720",
    "margin_footer_dxa": "720",
    "body_font": "Times New Roman",
    "body_size_halfpt": "24",
    "body_alignment": "both",
    "body_line_spacing_val": "360",
    "body_line_spacing_rule": "auto",
    "body_space_before": "0",
    "body_space_after": "120",
    "body_first_line_indent_dxa": "0",
    "body_line_spacing_factors.single": "1.0",
    "body_line_spacing_factors.1": "1.0",
    "body_line_spacing_factors.1.0": "1.0",
    "body_line_spacing_factors.1.5": "1.5",
    "body_line_spacing_factors.double": "2.0",
    "cover_title_size_pt": "20.0",
    "cover_title_leading_factor": "1.15",
    "cover_title_alignment": "center",
    "cover_title_space_after_pt": "12.0",
    "cover_title_bold": "true",
    "cover_subtitle_size_pt": "10.0",
    "cover_subtitle_leading_factor": "1.1",
    "cover_subtitle_alignment": "center",
    "cover_subtitle_space_after_pt": "10.0",
    "cover_subtitle_italic": "true",
    "cover_summary_size_pt": "9.0",
    "cover_summary_leading_factor": "1.05",
    "cover_summary_alignment": "center",
    "cover_summary_space_after_pt": "8.0",
    "signature_alignment": "center",
    "signature_label_size_pt": "10.0",
    "signature_label_bold": "true",
    "signature_line_size_pt": "10.0",
    "signature_name_size_pt": "9.0",
    "signature_name_italic": "false",
    "signature_block_space_before_pt": "18.0",
    "heading_leading_factor": "1.2",
    "list_left_indent_pt": "18.0",
    "list_block_spacing_pt": "6.0",
    "has_page_numbers": "false",
    "page_number_alignment": "center",
    "prelim_page_format": "lowerRoman",
    "body_page_format": "decimal",
    "page_number_section_restart": "false",
    "detected_section_headings": "[]",
    "has_toc": "false",
    "has_list_of_figures": "false",
    "has_bulleted_lists": "false",
    "has_numbered_lists": "false",
    "table_count": "0",
    "tables_use_borders": "true",
    "image_count": "0",
    "has_cover_image": "false",
    "footer_count": "0",
    "header_count": "0",
    "has_markdown_leak": "false",
    "has_xml_artifact_numbers": "false",
    "has_mixed_fonts": "false",
    "has_inconsistent_sizes": "false",
    "font_substitution_detected": "false",
    "extraction_warnings": "[]",
    "confidence": "high",
}
# Size, spacing before and after by heading level; what all levels share.
HEADING_LEVELS = {1: ("36", "240", "120"), 2: ("32", "200", "100"), 3: ("28", "160", "80"), 4: ("26", "120", "60"), 5: ("24", "100", "50"), 6: ("22", "80", "40")}
HEADING_SHARED = {"font": "Calibri", "bold": "true", "italic": "false", "underline": "false", "caps": "false", "small_caps": "false", "alignment": "left", "numbering": "false"}
for _level, _own in HEADING_LEVELS.items():
    _leaves = HEADING_SHARED | dict(zip(("size_halfpt", "space_before", "space_after"), _own))
    DEFAULTS |= {f"headings.{_level}.{k}": v for k, v in _leaves.items()}
SPACING_FACTORS = {"single": 1.0, "1": 1.0, "1.0": 1.0, "1.5": 1.5, "double": 2.0}
REQUIRED = ["page_width_dxa", "page_height_dxa", "margin_top_dxa", "body_font", "body_size_halfpt"]
MARGINS = ["margin_top_dxa", "margin_bottom_dxa", "margin_left_dxa", "margin_right_dxa"]
PRIORITIES = [0, 1, 2]


def merge(rules: DataFrame) -> DataFrame:
    """entity, key, value, source: the highest layer with a value wins; a null never overrides."""
    known = rules.filter(F.col("value").isNotNull())
    best = F.max_by(F.struct("value", "source"), F.struct("priority", "seq")).alias("w")
    return known.groupBy("entity", "key").agg(best).select(
        "entity", "key", F.col("w.value").alias("value"), F.col("w.source").alias("source")
    )


def source_flags(rules: DataFrame) -> DataFrame:
    """entity, extracted, overridden: whether a layer contributed anything."""
    has = F.col("value").isNotNull()
    return rules.groupBy("entity").agg(
        F.bool_or(has & (F.col("priority") == 1)).alias("extracted"),
        F.bool_or(has & (F.col("priority") == 2)).alias("overridden"),
    )


def widen(merged: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entity with a column per key (dots become underscores)."""
    wide = merged.groupBy("entity").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.replace(".", "_")) for k in keys]
    )
    return wide


def layer_maps(rules: DataFrame, names: dict[int, str]) -> DataFrame:
    """entity and, per priority -> name, a map of its leaves: key -> value, nulls left out; the last row of a key wins.

    Rows are combined per leaf before they move, then per entity; a map has at most one entry per key.
    """
    known = rules.filter(F.col("value").isNotNull() & F.col("priority").isin(*names))
    leaf = known.groupBy("entity", "key", "priority").agg(F.max_by("value", "seq").alias("value"))

    def one(priority: int) -> Column:
        entries = F.collect_list(F.when(F.col("priority") == priority, F.struct("key", "value")))
        return F.map_from_entries(F.array_sort(entries)).alias(names[priority])

    return leaf.groupBy("entity").agg(*[one(p) for p in names])


def no_rules() -> Column:
    return F.create_map().cast("map<string, string>")


class Rules(NamedTuple):
    """Two layers, as maps of leaves, over constant defaults."""

    extracted: Column
    overrides: Column
    defaults: dict[str, str]


def resolved(extracted: Column, overrides: Column, defaults: dict[str, str] | None = None) -> Rules:
    """The highest layer with a value wins leaf by leaf; a null never overrides, a null map is empty.

    Layers hold only the leaves that are there. They are laid over the constant defaults where the row is, so defaults are
    not part of a shuffle.
    """
    return Rules(extracted, overrides, DEFAULTS if defaults is None else defaults)


def _leaves(rows: DataFrame, rules: Rules, **others: Column) -> DataFrame:
    """entity, key, value, source of every leaf, and what the maps ``others`` have at the key.

    The keys are exploded, then looked up in the layers, which are short: no map as long as the defaults is built per row.
    """
    maps = {"_low": rules.extracted, "_high": rules.overrides, **others}
    rows = T.settle(rows, ["entity"], **{n: F.coalesce(m, no_rules()) for n, m in maps.items()})
    keys = reduce(F.array_union, [F.map_keys(n) for n in maps])
    filled = lambda k: F.coalesce(*[F.try_element_at(n, k) for n in maps]).isNotNull()
    own = F.filter(keys, lambda k: ~k.isin(list(rules.defaults)) & filled(k))
    entry = F.transform(own, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value")))
    # Apart from the explosion, so that this is generated code.
    rows = T.settle(rows, ["entity", *maps], _own=entry)
    base = F.lit(json.dumps([{"key": k, "value": v} for k, v in rules.defaults.items()]))
    entries = F.concat(F.from_json(base, "array<struct<key: string, value: string>>"), "_own")
    rows = rows.select("entity", *maps, F.explode(entries).alias("_leaf"))
    rows = rows.select("entity", "_leaf.key", F.col("_leaf.value").alias("_value"), *[F.try_element_at(n, F.col("_leaf.key")).alias(n) for n in maps])
    source = F.when(F.col("_high").isNotNull(), "override").when(F.col("_low").isNotNull(), "extracted").otherwise("defaults")
    return rows.select("entity", "key", F.coalesce("_high", "_low", "_value").alias("value"), source.alias("source"), *others)


def rule_rows(rows: DataFrame, rules: Rules) -> DataFrame:
    """entity, key, value, source of what ``resolved`` made."""
    return _leaves(rows, rules)


def diff_maps(rows: DataFrame, before: Column, after: Column | Rules) -> DataFrame:
    """entity, key, before, after: leaves whose values differ between a map and another, or what ``resolved`` made, null-safe."""
    rules = after if isinstance(after, Rules) else resolved(no_rules(), after, {})
    leaves = T.settle(_leaves(rows, rules, _before=before), ["entity", "key"], before=F.col("_before"), after=F.col("value"))
    return leaves.where(~F.col("before").eqNullSafe(F.col("after")))


def split_priorities(props: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows by priority."""
    ok = F.col("priority").isin(*PRIORITIES)
    return props.filter(ok), props.filter(~ok | F.col("priority").isNull())


def priority_merge(props: DataFrame) -> DataFrame:
    """entity, key, value: highest priority wins, the later item wins a tie; nulls count as values."""
    item = F.max_by(F.struct("value"), F.struct("priority", "seq"))
    return props.groupBy("entity", "key").agg(item["value"].alias("value"))


def contradictions(props: DataFrame) -> DataFrame:
    """entity, keep_sources, break_sources: keep-with-next and page-break-before both asked for by anyone."""

    def sources(key: str) -> Column:
        hit = (F.col("key") == key) & (F.lower("value") == "true")
        return F.array_sort(F.collect_set(F.when(hit, F.col("source"))))

    both = props.filter(F.col("key").isin("keep_with_next", "force_page_break_before"))
    # Sources are few names; de-duplicating first keeps the sets small before the shuffle.
    distinct = both.select("entity", "key", "value", "source").distinct()
    out = distinct.groupBy("entity").agg(
        sources("keep_with_next").alias("keep_sources"), sources("force_page_break_before").alias("break_sources")
    )
    return out.filter((F.size("keep_sources") > 0) & (F.size("break_sources") > 0))


def number(name: str) -> Column:
    return F.col(name).try_cast("bigint")


def warnings() -> Column:
    """Range warnings of a wide rules row."""

    def msg(cond: Column, text: str) -> Column:
        return F.when(cond, F.lit(text))

    size, width = number("body_size_halfpt"), number("page_width_dxa")
    # The messages and their limits.
    items = [msg(F.col(k).isNull(), f"Required key is None: {k}") for k in REQUIRED]
    items.append(msg((width != 0) & (width < 3000), "Page width suspiciously small (< 2 inches)"))
    items.append(msg((size != 0) & (size < 16), "Body font size very small (< 8pt)"))
    items.append(msg(size > 96, "Body font size very large (> 48pt)"))
    for m in MARGINS:
        items.append(msg(number(m) < 0, "Negative margin detected"))
        items.append(msg(number(m) > 5400, "Unusually large margin detected"))
    return F.array_compact(F.array(*items))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity, key, before, after: keys whose values differ, null-safe."""
    a = before.select("entity", "key", F.col("value").alias("before"))
    b = after.select("entity", "key", F.col("value").alias("after"))
    return a.join(b, ["entity", "key"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def convert_overrides(forms: DataFrame) -> DataFrame:
    """Form strings to rule values; blanks and non-numbers give null. Rounding is half-even."""

    def num(name: str) -> Column:
        return T.strip(F.col(name)).try_cast("double")

    def to_int(c: Column) -> Column:
        return F.bround(c, 0).cast("int")

    def margin(name: str) -> Column:
        return F.when(num(name) >= 0, to_int(num(name) * 1440.0))

    font = T.strip(F.coalesce("bodyFont", F.lit("")))
    return forms.select(
        "entity",
        F.when(font != "", font).alias("body_font"),
        F.when(num("bodySizePt") > 0, to_int(num("bodySizePt") * 2.0)).alias("body_size_halfpt"),
        margin("marginTopIn").alias("margin_top_dxa"),
        margin("marginLeftIn").alias("margin_left_dxa"),
        margin("marginBottomIn").alias("margin_bottom_dxa"),
        margin("marginRightIn").alias("margin_right_dxa"),
        F.when(num("lineSpacingPt") > 0, to_int(num("lineSpacingPt") * 20.0)).alias("body_line_spacing_val"),
    )


def falsy_default(value: Column, default: Column) -> Column:
    """default when the value is null, empty, zero or false."""
    text = value.cast("string")
    return F.when(value.isNull() | text.isin("", "0", "0.0", "false"), default).otherwise(value)


def null_default(value: Column, default: Column) -> Column:
    """default only when the value is null."""
    return F.coalesce(value, default)


def spacing_factor(mode: Column, value: Column) -> Column:
    """Factor by spacing name, else value / 240, else single."""
    name = F.lower(T.strip(F.coalesce(mode, F.lit(""))))
    table = F.create_map(*[x for k, v in SPACING_FACTORS.items() for x in (F.lit(k), F.lit(v))])
    base = F.coalesce(value, F.lit(DEFAULTS["body_line_spacing_val"]))
    return F.coalesce(F.try_element_at(table, name), F.round(base.try_cast("double") / 240.0, 6), F.lit(1.0))


# How each field of the effective formatting falls back. A falsy value (null, empty, zero, false) gives the
# default; only a null gives the default; no default; whether the value is truthy.
FALSY_FIELDS = [
    "page_width_dxa", "page_height_dxa", "margin_top_dxa", "margin_bottom_dxa", "margin_left_dxa", "margin_right_dxa", "margin_header_dxa",
    "margin_footer_dxa", "body_size_halfpt", "body_line_spacing_val", "body_space_after", "body_page_format", "prelim_page_format",
    "page_number_alignment",
]
NULL_FIELDS = [
    "body_space_before", "cover_title_size_pt", "cover_title_leading_factor", "cover_title_alignment", "cover_title_space_after_pt",
    "cover_title_bold", "cover_subtitle_size_pt", "cover_subtitle_leading_factor", "cover_subtitle_alignment", "cover_subtitle_space_after_pt",
    "cover_subtitle_italic", "cover_summary_size_pt", "cover_summary_leading_factor", "cover_summary_alignment", "cover_summary_space_after_pt",
    "signature_alignment", "signature_label_size_pt", "signature_label_bold", "signature_line_size_pt", "signature_name_size_pt",
    "signature_name_italic", "signature_block_space_before_pt", "heading_leading_factor", "list_left_indent_pt", "list_block_spacing_pt",
]
PLAIN_FIELDS = [
    "body_left_indent_dxa", "body_right_indent_dxa", "body_first_line_indent_dxa", "list_first_line_indent_pt", "h1_left_indent_dxa",
    "h1_right_indent_dxa", "h1_first_line_indent_dxa", "h2_left_indent_dxa", "h2_right_indent_dxa", "h2_first_line_indent_dxa",
    "h3_left_indent_dxa", "h3_right_indent_dxa", "h3_first_line_indent_dxa",
]
FLAG_FIELDS = ["has_page_numbers", "page_number_section_restart", "has_cover_section", "has_prelim_section", "has_cover_image"]
HEADING_FIELDS = ["font", "size_halfpt", "alignment", "space_before", "space_after", "bold", "italic", "underline", "caps", "small_caps", "numbering"]


def truthy(value: Column) -> Column:
    return falsy_default(value, F.lit(None).cast("string")).isNotNull()


def effective_formatting(rows: DataFrame) -> DataFrame:
    """entity and every field a document writer reads, from ``rules`` and ``flat`` (maps of leaves), ``typography`` (font_family,
    alignment, line_spacing), ``heading_numbering`` and ``cover_summary_text``.

    Resolved value, then typography, then default. Without any resolved rule the flat ones stand in. Most keys treat falsy as
    missing, the cover, signature, list and spacing-before keys only null. A missing body-section flag is true. A heading
    attribute that is there counts even if it is null. Headings come as columns heading_<level>_<attribute> of six levels.
    """
    flat = F.coalesce("flat", no_rules())
    own = F.coalesce("rules", no_rules())
    own = F.when((F.size(own) == 0) & F.exists(F.map_values(flat), lambda v: v.isNotNull()), flat).otherwise(own)
    rows = rows.withColumn("_r", own)
    r = lambda k: F.try_element_at("_r", F.lit(k))
    t = lambda k: F.try_element_at("typography", F.lit(k))
    d = lambda k: F.lit(DEFAULTS[k])
    mode = falsy_default(t("line_spacing"), r("body_line_spacing_rule"))
    out = {k: falsy_default(r(k), d(k)) for k in FALSY_FIELDS}
    out["body_font"] = falsy_default(r("body_font"), falsy_default(t("font_family"), d("body_font")))
    out["body_alignment"] = falsy_default(r("body_alignment"), falsy_default(t("alignment"), d("body_alignment")))
    out["body_line_spacing_factor"] = spacing_factor(mode, r("body_line_spacing_val"))
    out |= {k: null_default(r(k), d(k)) for k in NULL_FIELDS}
    out |= {k: r(k) for k in PLAIN_FIELDS}
    out |= {k: truthy(r(k)) for k in FLAG_FIELDS}
    out["has_body_section"] = ~F.map_contains_key("_r", "has_body_section") | truthy(r("has_body_section"))
    out["heading_numbering"] = F.coalesce("heading_numbering", F.lit(False))
    out["page_number_format"] = falsy_default(r("page_number_format"), falsy_default(r("body_page_format"), d("body_page_format")))
    out["cover_summary_text"] = falsy_default(r("cover_summary_text"), F.col("cover_summary_text"))
    for level in HEADING_LEVELS:
        for field in HEADING_FIELDS:
            key = f"headings.{level}.{field}"
            out[f"heading_{level}_{field}"] = F.when(F.map_contains_key("_r", key), r(key)).otherwise(d(key))
    return rows.select("entity", *[c.alias(k) for k, c in out.items()])


def first_filled(*candidates: Column, default: str = "") -> Column:
    """First candidate that is not blank."""
    return F.coalesce(*[F.nullif(T.strip(c), F.lit("")) for c in candidates], F.lit(default))


def alignment_class(value: Column) -> Column:
    v = F.lower(T.strip(F.coalesce(value, F.lit(""))))
    return (
        F.when(v.isin("both", "justified", "justify"), "justify")
        .when(v == "center", "center")
        .when(v == "right", "right")
        .otherwise("left")
    )


def font_class(value: Column) -> Column:
    v = F.lower(T.strip(F.coalesce(value, F.lit(""))))
    return F.when(v.contains("times"), "Times-Roman").when(v.contains("courier"), "Courier").otherwise("Helvetica")


def constraint_list(line_spacing: Column, alignment: Column, depth: Column, target_pages: Column) -> Column:
    """key:value strings of a layout plan; target_pages only when set."""
    return F.array_compact(
        F.array(
            F.lit("margins:1in"),
            F.concat(F.lit("line_spacing:"), line_spacing),
            F.concat(F.lit("alignment:"), alignment),
            F.concat(F.lit("max_heading_depth:"), depth.cast("string")),
            F.when(target_pages > 0, F.concat(F.lit("target_pages:"), target_pages.cast("string"))),
        )
    )


def constraint_value(items: Column, key: str, default: Column) -> Column:
    """Value of the first ``key:`` string, else the default; an empty value also gives the default."""
    hit = F.try_element_at(F.filter(items, lambda x: F.startswith(x, F.lit(f"{key}:"))), F.lit(1))
    return F.coalesce(F.nullif(F.substring(hit, len(key) + 2, 2**31 - 1), F.lit("")), default)


def geometry(rows: DataFrame) -> DataFrame:
    """Usable width and height (also in points), half-column width (not below 0), whether cover pages are split off."""
    g = lambda k: falsy_default(F.col(k), F.lit(DEFAULTS[k])).try_cast("bigint")
    width = g("page_width_dxa") - g("margin_left_dxa") - g("margin_right_dxa")
    split = F.lit(False)
    for flag in ("has_cover_section", "has_prelim_section", "has_cover_image"):
        split = split | F.coalesce(flag, F.lit(False))
    height = g("page_height_dxa") - g("margin_top_dxa") - g("margin_bottom_dxa")
    return rows.select(
        "entity",
        width.alias("usable_width"),
        height.alias("usable_height"),
        (width / TWIPS_PER_POINT).alias("column_width_pt"),
        (height / TWIPS_PER_POINT).alias("usable_height_pt"),
        F.greatest(F.lit(0), F.floor(width / 2)).cast("bigint").alias("half_column"),
        split.alias("split_requested"),
    )


def has_style_reference() -> Column:
    """Any of seven signals: a file name, a positive count, or a detected heading."""
    out = T.strip(F.coalesce("source_filename", F.lit(""))) != ""
    for c in ("footer_count", "header_count", "section_count", "table_count", "image_count"):
        out = out | (F.coalesce(c, F.lit(0)) > 0)
    return out | (F.size(F.coalesce("detected_headings", F.array().cast("array<string>"))) > 0)


def style_digest() -> Column:
    """Text summary of a style reference row (fixed labels, first 16 headings); zero and null read as n/a."""

    def num(name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit(0)) == 0, "n/a").otherwise(F.col(name).cast("string"))

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("string")

    def row(label: str, *values: Column | str) -> Column:
        return F.concat(F.lit(f"- {label}: "), *[v if isinstance(v, Column) else F.lit(v) for v in values])

    def words(name: str, default: str) -> Column:
        return first_filled(F.col(name), default=default)

    size = F.when(F.col("body_size_halfpt") > 0, F.round(F.col("body_size_halfpt") / 2.0, 1).cast("string")).otherwise("unknown")
    spacing = F.when(F.coalesce("body_line_spacing_val", F.lit(0)) == 0, "360").otherwise(
        F.col("body_line_spacing_val").cast("string")
    )
    sections = F.when(F.coalesce("section_count", F.lit(0)) == 0, F.size(F.col("_heads"))).otherwise(F.col("section_count"))
    lines = F.array(
        F.lit("DOCX STYLE BLUEPRINT:"),
        F.lit("- Use the uploaded DOCX only as a structural and visual reference, not as wording to copy."),
        row("Body font", words("body_font", "Times New Roman")),
        row("Body size", size, "pt"),
        row("Body alignment", words("body_alignment", "both")),
        row("Body line spacing", spacing),
        row(
            "Body indents", "left ", num("body_left_indent_dxa"), " dxa, first-line ", num("body_first_line_indent_dxa"),
            " dxa, right ", num("body_right_indent_dxa"), " dxa",
        ),
        row("List left indent", num("list_left_indent_pt"), " pt"),
        row("Cover title size", num("cover_title_size_pt"), " pt"),
        row("Cover subtitle size", num("cover_subtitle_size_pt"), " pt"),
        row("Page numbering", "prelim ", words("prelim_page_format", "lowerRoman"), ", body ", words("body_page_format", "decimal")),
        row("Sections detected", sections.cast("string")),
        row("Tables detected", count("table_count")),
        row("Images detected", count("image_count")),
    )
    tail = F.when(
        F.size("_heads") > 0,
        F.concat(
            F.array(F.lit("Reference heading blueprint:")), F.transform(F.slice("_heads", 1, 16), lambda h: F.concat(F.lit("- "), h))
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(has_style_reference(), F.array_join(F.concat(lines, tail), "\n")).otherwise(
        "No DOCX style reference provided."
    )


def style_digests(rows: DataFrame) -> DataFrame:
    """entity, digest."""
    heads = F.filter(F.transform("detected_headings", T.strip), lambda h: h != "")
    return rows.withColumn("_heads", heads).select("entity", style_digest().alias("digest"))
