"""Style profiles of documents from paragraph, section, part and style rows.

Medians use the percentile aggregate, whose map-side buffers hold one count per distinct value, and modes are counted per
value before they are compared, so a document with very many paragraphs is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.text import let
from quire.functions.windows import ordered

# Fallbacks of the flat style record.
FALLBACKS = {
    "body_font": "Times New Roman",
    "body_size_halfpt": "24",
    "body_alignment": "both",
    "body_line_spacing_val": "360",
    "body_line_spacing_rule": "auto",
    "body_space_before": "0",
    "body_space_after": "120",
    "body_first_line_indent_dxa": "0",
    "body_is_bold": "false",
    "body_is_italic": "false",
    "body_is_underline": "false",
}
# Size, spacing before and after by heading level (levels 4 to 6 have no spacing, 5 and 6 no underline).
HEADING_FALLBACKS = {1: ("36", "240", "120"), 2: ("32", "200", "100"), 3: ("28", "160", "80"), 4: ("26",), 5: ("24",), 6: ("22",)}
for _level, (_size, *_spaces) in HEADING_FALLBACKS.items():
    _own = {"font": "Calibri", "size_halfpt": _size, "alignment": "left", "is_bold": "true", "is_italic": "false"}
    _own |= {"is_underline": "false"} if _level < 5 else {}
    _own |= dict(zip(("space_before", "space_after"), _spaces))
    FALLBACKS |= {f"h{_level}_{k}": v for k, v in _own.items()}
# Page numbers, counts and flags.
FALLBACKS |= {
    "has_page_numbers": "false",
    "page_number_format": "decimal",
    "page_number_alignment": "center",
    "element_count_tables": "0",
    "element_count_images": "0",
    "element_count_lists": "0",
    "element_count_paragraphs": "0",
    "flag_markdown_leak": "false",
    "flag_artifact_numbers": "false",
    "flag_mixed_fonts": "false",
    "flag_inconsistent_spacing": "false",
}
# Fonts that count as substituted, cover markers.
SUBSTITUTED = ["SimSun", "Courier", "Arial", "Calibri"]
COVER_ROWS, BODY_ROWS = 30, 10
MARKERS = ["submitted by", "partial fulfillment"]


def norm_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"{T.WS}+", ""))


def array_median(values: Column) -> Column:
    """Median of an array; null when empty."""
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull()))

    def mid(s: Column) -> Column:
        n = F.size(s)
        lo = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
        hi = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
        return F.when(n > 0, (lo + hi) / 2.0)

    return let(known, mid)


def with_rank(paras: DataFrame, order: list[str]) -> DataFrame:
    """pos: 0-based paragraph number per doc."""
    out = ordered(paras, ["doc"], order, sums={"pos": F.lit(1)})
    return out.withColumn("pos", F.col("pos") - 1)


def first_mode(rows: DataFrame, keys: list[str], value: str, pos: str | Column) -> DataFrame:
    """keys, value: most frequent non-null value; a tie goes to the one seen first."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(pos).alias("_first")
    )
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_first")).alias(value))


METRICS = ["left_indent", "right_indent", "first_line", "space_before", "space_after"]


def paragraph_profile(paras: DataFrame, order: list[str], min_len: int = 0) -> DataFrame:
    """doc, style, n, alignment mode, median of five metrics, rounded median line spacing."""
    rows = paras.filter((F.col("text_len") > 0) & (F.col("text_len") >= min_len))
    medians = rows.groupBy("doc", "style").agg(
        F.count("*").alias("n"),
        *[F.round(F.median(m), 4).alias(m) for m in METRICS],
        F.bround(F.median("line_spacing"), 0).cast("int").alias("line_spacing"),
    )
    mode = first_mode(rows, ["doc", "style"], "alignment", F.struct(*order))
    return medians.join(mode, ["doc", "style"], "left")


GEOMETRY = ["page_width", "page_height", "margin_top", "margin_bottom", "margin_left", "margin_right"]


def section_profile(sections: DataFrame) -> DataFrame:
    """doc, section_count, margins_differ, rounded medians of the page geometry, has_cover."""
    margins = F.struct("margin_top", "margin_bottom", "margin_left", "margin_right")
    # Distinct geometries are few; counting them first keeps the distinct set of a large document small.
    kinds = sections.groupBy("doc", *GEOMETRY).agg(F.count("*").alias("w"))
    return kinds.groupBy("doc").agg(
        F.sum("w").alias("section_count"),
        (F.count_distinct(margins) > 1).alias("margins_differ"),
        *[F.bround(F.percentile(g, 0.5, F.col("w")), 0).cast("int").alias(g) for g in GEOMETRY],
        (F.sum("w") >= 3).alias("has_cover"),
    )


def cover_sizes(paras: DataFrame) -> DataFrame:
    """doc, title_size, subtitle_size from the first paragraphs: median of per-paragraph medians of run sizes."""
    s = T.strip(F.col("text"))
    rows = paras.filter((F.col("pos") < COVER_ROWS) & (s != "")).withColumn("_m", array_median(F.col("run_sizes")))
    rows = rows.filter(F.col("_m").isNotNull())
    caps = s.rlike(r"\p{L}") & (F.upper(s) == s) & ~s.rlike(r"\p{Nd}")
    low = F.lower(s)
    sub = low.contains(MARKERS[0]) | low.contains(MARKERS[1]) | F.coalesce("italic", F.lit(False))
    return rows.groupBy("doc").agg(
        F.median(F.when(caps, F.col("_m"))).alias("title_size"),
        F.median(F.when(sub, F.col("_m"))).alias("subtitle_size"),
    ).filter(F.col("title_size").isNotNull() | F.col("subtitle_size").isNotNull())


HEADING_FLAGS = ("bold", "italic", "underline", "numbering")
HEADING_SWITCHES = ("caps", "small_caps")  # off only by the value 0
HEADING_VALUES = ("font", "size", "alignment", "space_before", "space_after")


def heading_map(styles: DataFrame) -> DataFrame:
    """doc, headings: map level -> all attributes of the first style row of each level 1-6.

    Flags are null where the style lacks them and then false; caps and small caps hold the written value, on unless it is 0.
    """
    attrs = F.struct(
        *HEADING_VALUES,
        *[F.coalesce(c, F.lit(False)).alias(c) for c in HEADING_FLAGS],
        *[F.coalesce(F.col(c) != "0", F.lit(False)).alias(c) for c in HEADING_SWITCHES],
    )
    first = styles.filter(F.col("level").between(1, 6)).groupBy("doc", "level").agg(F.min_by(attrs, "pos").alias("attrs"))
    return first.groupBy("doc").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "attrs")))).alias("headings")
    )


def part_facts(parts: DataFrame) -> DataFrame:
    """parts: doc, kind (footer/header), part, text, jc, instr. Footer and page-number facts per document."""
    footer = F.col("kind") == "footer"
    instr = F.lower(F.coalesce("instr", F.lit("")))
    paged = footer & instr.contains("page")
    roman = paged & instr.contains("roman")
    decimal = paged & ~instr.contains("roman")
    sample = footer & (T.strip(F.coalesce("text", F.lit(""))) != "")
    facts = parts.groupBy("doc").agg(
        F.count_if(footer).alias("footers"),
        F.count_if(F.col("kind") == "header").alias("headers"),
        F.min_by(T.strip(F.col("text")), F.when(sample, F.col("part"))).alias("sample"),
        F.bool_or(paged).alias("has_page_numbers"),
        F.max_by(
            F.when(instr.contains("upper"), "upperRoman").otherwise("lowerRoman"), F.when(roman, F.col("part"))
        ).alias("prelim_format"),
        F.max(F.when(decimal, "decimal")).alias("body_format"),
        (F.bool_or(roman) & F.bool_or(decimal)).alias("restart"),
    )
    mode = first_mode(parts.filter(footer), ["doc"], "jc", "part").withColumnRenamed("jc", "alignment")
    return facts.join(mode, "doc", "left")


def element_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tables, images, list items, bordered tables and a leading image, counted on the markup."""
    h = F.lower(html)
    first_para = F.regexp_extract(h, r"(?s)<p[^>]*>(.*?)</p>", 1)
    return pages.select(
        "page_id",
        F.regexp_count(h, F.lit(r"<table[\s>]")).alias("tables"),
        F.regexp_count(h, F.lit(r"<img[\s>/]")).alias("images"),
        F.regexp_count(h, F.lit(r"<li[\s>]")).alias("list_items"),
        F.regexp_count(h, F.lit(r"<p[\s>]")).alias("paragraphs"),
        h.rlike(r"<table[^>]*border").alias("uses_borders"),
        first_para.contains("<img").alias("leading_image"),
    )


def text_flags(c: Column) -> dict[str, Column]:
    return {
        "markdown_leak": c.rlike(rf"(?md)^{T.WS}*#") | c.contains("**") | c.contains("__"),
        "artifact_numbers": c.rlike(T.ARTIFACT),
    }


# The second detector's patterns.
ALT_MARKDOWN = rf"(?d)#{{1,6}}{T.WS}+|^\*\*|`{{3}}|---|\[.*\]\(.*\)"
ALT_ARTIFACT = r"\p{Nd}{10,}|artifact_\p{Nd}+|temp_\p{Nd}+"


def alternate_text_flags(c: Column) -> dict[str, Column]:
    return {"markdown_leak": c.rlike(ALT_MARKDOWN), "artifact_numbers": c.rlike(ALT_ARTIFACT)}


def variety_flags(paras: DataFrame, max_fonts: int = 2, max_sizes: int = 3, max_spacings: int | None = None) -> DataFrame:
    """doc, mixed_fonts, inconsistent_sizes or inconsistent_spacing, substituted: distinct values per document.

    Distinct combinations are taken first, so the distinct sets are built from few rows.
    """
    value = "size" if max_spacings is None else "line_spacing"
    limit = max_sizes if max_spacings is None else max_spacings
    few = paras.select("doc", "font", value).distinct()
    return few.groupBy("doc").agg(
        (F.count_distinct("font") > max_fonts).alias("mixed_fonts"),
        (F.count_distinct(value) > limit).alias("inconsistent"),
        F.bool_or(F.col("font").isin(*SUBSTITUTED)).alias("substituted"),
    )


def confidence(*fields: str) -> Column:
    missing = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    return F.when(missing > 1, "low").when(missing == 1, "medium").otherwise("high")


def fill(rows: DataFrame) -> DataFrame:
    """entity and every key of the flat style record: the row's own value, else for a heading's font or alignment the
    body's, else the fallback. A column that ``rows`` lacks counts as null."""

    def own(key: str) -> Column:
        return F.col(key) if key in rows.columns else F.lit(None).cast("string")

    def body(key: str) -> list[Column]:
        return [own(f"body_{key[3:]}")] if key[0] == "h" and key[3:] in ("font", "alignment") else []

    return rows.select("entity", *[F.coalesce(own(k), *body(k), F.lit(v)).alias(k) for k, v in FALLBACKS.items()])


def find_styles(requests: DataFrame, styles: DataFrame) -> DataFrame:
    """requests: request, doc, wanted; styles: doc, pos, style_id, name. First style whose normalised id or name is the
    wanted one: two key sets, one equi join."""
    by_id = styles.select("doc", norm_name(F.col("style_id")).alias("key"), "pos")
    by_name = styles.select("doc", norm_name(F.col("name")).alias("key"), "pos")
    first = by_id.unionByName(by_name).groupBy("doc", "key").agg(F.min("pos").alias("pos"))
    return requests.withColumn("key", norm_name(F.col("wanted"))).join(first, ["doc", "key"]).select(
        "request", "doc", "wanted", "pos"
    )


def usage_facts(paras: DataFrame) -> DataFrame:
    """doc, body font and size: first filled value among the first paragraphs; bold, italic and underline: seen in any of them;
    alignment, spacing and first-line indent: those of the first paragraph alone."""
    head = paras.filter(F.col("pos") < BODY_ROWS)

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.nullif(F.col(name).cast("string"), F.lit("")).isNotNull(), F.col("pos")))

    lead = F.col("pos") == 0
    return head.groupBy("doc").agg(
        first("font").alias("body_font"),
        first("size").alias("body_size"),
        *[F.bool_or(c).alias(c) for c in ("bold", "italic", "underline")],
        *[F.max(F.when(lead, F.nullif(F.col(c), F.lit("")))).alias(c) for c in ("alignment", "line_spacing_rule")],
        *[F.max(F.when(lead, F.col(c))).alias(c) for c in ("line_spacing", "space_before", "space_after", "first_line")],
    )


def heading_usage(paras: DataFrame, order: list[str]) -> DataFrame:
    """doc, level: last non-null font, size, alignment and spacing of the level's paragraphs; flags seen anywhere."""
    rows = paras.withColumn("level", F.regexp_extract("style", r"^Heading (\d)", 1).try_cast("int")).filter(
        F.col("level").isNotNull()
    )

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*order)))

    return rows.groupBy("doc", "level").agg(
        *[last(c).alias(c) for c in ("font", "size", "alignment", "space_before", "space_after")],
        *[F.bool_or(c).alias(c) for c in ("bold", "italic", "underline")],
    )
