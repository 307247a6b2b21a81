"""L11-L22, L29 (style profiles) and L23-L26 (presets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import presets as C
from quire.operators import styles as Y
from quire.plans import relations as R
from quire.plans import sqltext as S
from quire.plans.base import ctes, query, table
from quire.plans.layer_queries import _raw_wide

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
# One expression text per column; both engines read it.
_PARA = {
    "style": "CASE l_returnflag WHEN 'A' THEN 'Body Text' WHEN 'N' THEN 'Heading ' || CAST(1 + l_linenumber % 3 AS STRING) ELSE 'List Paragraph' END",
    "alignment": "CASE WHEN l_tax = 0.0 THEN NULL WHEN l_linestatus = 'O' THEN 'left' WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'both' ELSE 'center' END",
    "left_indent": "l_quantity",
    "right_indent": "CASE WHEN l_discount = 0.0 THEN NULL ELSE l_tax * 100 END",
    "first_line": "l_discount * 100",
    "space_before": "CASE WHEN l_quantity < 5 THEN NULL ELSE CAST(l_linenumber * 1.5 AS DOUBLE) END",
    "space_after": "l_quantity / 4",
    "line_spacing": "240 + l_linenumber * 15",
    "font": "CASE l_suppkey % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Georgia' WHEN 2 THEN 'Times New Roman' ELSE NULL END",
    "size": "CASE WHEN l_discount = 0.1 THEN NULL ELSE CAST(20 + l_partkey % 5 AS INT) END",
    "bold": "l_quantity > 30",
    "italic": "l_tax > 0.06",
    "underline": "l_suppkey % 6 = 0",
    "line_spacing_rule": "CASE l_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN '' ELSE NULL END",
    "text_len": "CAST(l_quantity * 4 AS INT)",
    "text": "CASE l_linenumber % 4 WHEN 0 THEN ' ANNUAL REPORT ' WHEN 1 THEN 'Submitted by supplier ' || CAST(l_suppkey AS STRING) WHEN 2 THEN 'ANNUAL 2024' ELSE 'plain text' END",
}
_RUNS = ["CAST(10 + l_partkey % 7 AS DOUBLE)", "CAST(9 + l_suppkey % 5 AS DOUBLE)", "CASE WHEN l_discount > 0.05 THEN NULL ELSE 14.0 END", "l_quantity"]

_SECTION = {
    "page_width": "CASE WHEN o_orderstatus = 'P' THEN 12240 ELSE 11906 END",
    "page_height": "CASE WHEN o_orderstatus = 'P' THEN 15840 ELSE 16838 END",
    "margin_top": "CASE WHEN o_orderpriority LIKE '1%' THEN 1800 ELSE 1440 END",
    "margin_bottom": "1440",
    "margin_left": "CASE WHEN o_orderpriority LIKE '2%' THEN 1441 ELSE 1800 END",
    "margin_right": "1800",
}
_PART = {
    "kind": "CASE WHEN s_suppkey % 3 = 0 THEN 'header' ELSE 'footer' END",
    "text": "CASE WHEN s_suppkey % 4 = 0 THEN '  ' ELSE s_name END",
    "jc": "CASE s_suppkey % 5 WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 2 THEN NULL ELSE 'center' END",
    "instr": "CASE s_suppkey % 6 WHEN 1 THEN 'PAGE \\\\* Roman' WHEN 2 THEN 'page \\\\* UPPER roman' WHEN 4 THEN 'PAGE' ELSE NULL END",
}


def _cols(d):
    return ", ".join(f"{e} AS {n}" for n, e in d.items())


ctes(
    v_para=f"""SELECT l_orderkey AS doc, {_cols(_PARA)}, [{', '.join(_RUNS)}] AS run_sizes, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY {', '.join(_ORDER)}) - 1 AS pos FROM lineitem""",
    para_mode="""SELECT doc, style, arg_max(alignment, n * 1000000 - first_pos) AS alignment FROM (SELECT doc, style, alignment,
        count(*) AS n, min(pos) AS first_pos FROM v_para WHERE text_len >= 20 AND alignment IS NOT NULL GROUP BY doc, style,
        alignment) GROUP BY doc, style""",
    v_sections=f"SELECT o_custkey AS doc, {_cols(_SECTION)} FROM orders",
    v_parts="SELECT s_nationkey AS doc, s_suppkey AS part, " + _cols(_PART).replace("\\\\\\\\", "\\") + " FROM supplier",
    cover_rows=f"""SELECT doc, list_median(list_filter(run_sizes, lambda v: v IS NOT NULL)) AS m, {S.strip('text')} AS s, italic
        FROM v_para WHERE pos < 30 AND {S.strip('text')} <> ''""",
    v_preset="""SELECT s_name AS name, CASE WHEN s_nationkey = 0 THEN '' ELSE 'NATION_' || s_nationkey END AS category,
        ['tag' || (s_suppkey % 5), ' ', 'x'] AS tags, CASE s_suppkey % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN NULL ELSE 'Calibri' END AS
        "bodyFont", CAST(9 + s_suppkey % 3 AS VARCHAR) AS "bodySizePt", '1.0' AS "marginTopIn", CAST(s_suppkey % 2 AS VARCHAR) AS
        "marginLeftIn", '1.0' AS "marginBottomIn", CASE WHEN s_suppkey % 7 < 3 THEN '' ELSE '0.5' END AS "marginRightIn",
        '12' AS "lineSpacingPt" FROM supplier""",
    clean_presets="""SELECT name, coalesce(nullif(category, ''), 'general') AS category, list_filter(list_transform(tags,
        lambda t: trim(t)), lambda t: t <> '') AS tags, coalesce("bodyFont", '') AS "bodyFont", "bodySizePt", "marginTopIn",
        "marginLeftIn", "marginBottomIn", "marginRightIn", "lineSpacingPt" FROM v_preset""",
    old_names="""SELECT s_name AS name FROM supplier UNION ALL SELECT s_name || ' (2)' FROM supplier WHERE s_nationkey < 8
        UNION ALL SELECT s_name || ' (3)' FROM supplier WHERE s_nationkey < 4 UNION ALL SELECT s_name || ' (5)' FROM supplier
        WHERE s_nationkey < 4""",
    new_names="SELECT replace(c_name, 'Customer', 'Supplier') AS name FROM customer",
)


def v_para(spark, d, ranked=True):
    cols = [f"{e} AS {n}" for n, e in _PARA.items()]
    li = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS doc", *_ORDER, *cols, f"array({', '.join(_RUNS)}) AS run_sizes"
    )
    return Y.with_rank(li, _ORDER) if ranked else li


@query(
    "l11_paragraph_profile",
    """SELECT v.doc, v.style, v.n, v.left_indent, v.right_indent, v.first_line, v.space_before, v.space_after, v.line_spacing,
    m.alignment FROM (SELECT doc, style, count(*) AS n, round(median(left_indent), 4) AS left_indent,
    round(median(right_indent), 4) AS right_indent, round(median(first_line), 4) AS first_line,
    round(median(CAST(space_before AS DOUBLE)), 4) AS space_before, round(median(space_after), 4) AS space_after,
    CAST(round_even(median(line_spacing), 0) AS INTEGER) AS line_spacing FROM v_para WHERE text_len >= 20 GROUP BY doc, style) v
    LEFT JOIN para_mode m ON m.doc = v.doc AND m.style = v.style""",
)
def _(spark, d):
    return Y.paragraph_profile(v_para(spark, d, ranked=False), _ORDER, min_len=20)


@query(
    "l12_section_profile",
    """SELECT doc, count(*) AS section_count, count(DISTINCT {'a': margin_top, 'b': margin_bottom, 'c': margin_left,
    'd': margin_right}) > 1 AS margins_differ, CAST(round_even(median(page_width), 0) AS INTEGER) AS page_width,
    CAST(round_even(median(page_height), 0) AS INTEGER) AS page_height, CAST(round_even(median(margin_top), 0) AS INTEGER) AS
    margin_top, CAST(round_even(median(margin_bottom), 0) AS INTEGER) AS margin_bottom, CAST(round_even(median(margin_left), 0) AS
    INTEGER) AS margin_left, CAST(round_even(median(margin_right), 0) AS INTEGER) AS margin_right, count(*) >= 3 AS has_cover
    FROM v_sections GROUP BY doc""",
)
def _(spark, d):
    s = table(spark, d, "orders").selectExpr("o_custkey AS doc", *[f"{e} AS {n}" for n, e in _SECTION.items()])
    return Y.section_profile(s)


@query(
    "l13_cover_sizes",
    """SELECT doc, median(m) FILTER (regexp_matches(s, '\\p{L}') AND upper(s) = s AND NOT regexp_matches(s, '\\p{Nd}')) AS title_size,
    median(m) FILTER (contains(lower(s), 'submitted by') OR contains(lower(s), 'partial fulfillment') OR italic) AS subtitle_size
    FROM cover_rows WHERE m IS NOT NULL GROUP BY doc HAVING title_size IS NOT NULL OR subtitle_size IS NOT NULL""",
)
def _(spark, d):
    return Y.cover_sizes(v_para(spark, d))


_STYLE = {
    "font": "p_type",
    "size": "20 + p_size",
    "alignment": "CASE p_size % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'left' ELSE NULL END",
    "space_before": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size * 20 END",
    "space_after": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 10 END",
    "bold": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size % 2 = 0 END",
    "italic": "p_size % 5 = 0",
    "underline": "CASE WHEN p_size % 3 = 0 THEN true END",
    "numbering": "p_partkey % 2 = 0",
    "caps": "CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE NULL END",
    "small_caps": "CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN 'true' ELSE NULL END",
}
_STYLE_SHOWN = {
    **{c: c for c in ("font", "size", "alignment", "space_before", "space_after")},
    **{c: f"coalesce({c}, false)" for c in ("bold", "italic", "underline", "numbering")},
    **{c: f"coalesce({c} <> '0', false)" for c in ("caps", "small_caps")},
}


@query(
    "l14_heading_styles",
    f"""SELECT doc, level, {', '.join(f'{e} AS {c}' for c, e in _STYLE_SHOWN.items())} FROM (SELECT *, row_number() OVER (PARTITION BY
    doc, level ORDER BY pos) AS n FROM (SELECT p_brand AS doc, p_partkey AS pos, p_size % 8 AS level, {_cols(_STYLE)} FROM part)
    WHERE level BETWEEN 1 AND 6) WHERE n = 1""",
)
def _(spark, d):
    styles = table(spark, d, "part").selectExpr("p_brand AS doc", "p_partkey AS pos", "p_size % 8 AS level", *[f"{e} AS {n}" for n, e in _STYLE.items()])
    return Y.heading_map(styles).select("doc", F.explode("headings").alias("level", "a")).select("doc", "level", "a.*")


@query(
    "l15_detected_headings",
    """SELECT doc_id, string_agg(text, '|' ORDER BY block_no) AS headings FROM corpus_blocks WHERE corpus IN ('page', 'conv')
    AND kind = 'heading' AND corpus = 'page' GROUP BY doc_id""",
)
def _(spark, d):
    heads = B.blocks(R.v_page_text(spark, d)).filter(F.col("kind") == "heading")
    return heads.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "|"
        ).alias("headings")
    )


@query(
    "l16_footer_facts",
    f"""SELECT f.*, m.alignment FROM (SELECT doc, count(*) FILTER (kind = 'footer') AS footers, count(*) FILTER (kind = 'header')
    AS headers, arg_min(trim(text), part) FILTER (kind = 'footer' AND trim(text) <> '') AS sample,
    bool_or(kind = 'footer' AND contains(i, 'page')) AS has_page_numbers,
    arg_max(CASE WHEN contains(i, 'upper') THEN 'upperRoman' ELSE 'lowerRoman' END, part) FILTER (kind = 'footer' AND
    contains(i, 'page') AND contains(i, 'roman')) AS prelim_format,
    max(CASE WHEN kind = 'footer' AND contains(i, 'page') AND NOT contains(i, 'roman') THEN 'decimal' END) AS body_format,
    bool_or(kind = 'footer' AND contains(i, 'page') AND contains(i, 'roman')) AND bool_or(kind = 'footer' AND contains(i, 'page')
    AND NOT contains(i, 'roman')) AS restart FROM (SELECT *, lower(coalesce(instr, '')) AS i FROM v_parts) GROUP BY doc) f
    LEFT JOIN (SELECT doc, arg_max(jc, n * 1000000 - fp) AS alignment FROM (SELECT doc, jc, count(*) AS n, min(part) AS fp
    FROM v_parts WHERE kind = 'footer' AND jc IS NOT NULL GROUP BY doc, jc) GROUP BY doc) m ON m.doc = f.doc""",
)
def _(spark, d):
    parts = table(spark, d, "supplier").selectExpr(
        "s_nationkey AS doc", "s_suppkey AS part", *[f"{e} AS {n}" for n, e in _PART.items()]
    )
    return Y.part_facts(parts)


def _cnt(p):
    return f"CAST({S.count_re('lower(html)', p)} AS INTEGER)"


@query(
    "l17_element_counts",
    f"""SELECT page_id, {_cnt('<table[\\s>]')} AS tables, {_cnt('<img[\\s>/]')} AS images, {_cnt('<li[\\s>]')} AS list_items,
    {_cnt('<p[\\s>]')} AS paragraphs, regexp_matches(lower(html), '<table[^>]*border') AS uses_borders,
    contains(regexp_extract(lower(html), '(?s)<p[^>]*>(.*?)</p>', 1), '<img') AS leading_image FROM pages""",
)
def _(spark, d):
    return Y.element_counts(table(spark, d, "pages"))


_ART = f"len(list_filter(regexp_extract_all(text, '{T.WORD}'), lambda w: regexp_full_match(w, '\\p{{Nd}}{{6,9}}'))) > 0"


@query(
    "l18_text_flags",
    f"""SELECT doc_id, regexp_matches(text, '(?m)^{T.WS}*#') OR contains(text, '**') OR contains(text, '__') AS markdown_leak,
    {_ART} AS artifact_numbers FROM documents""",
)
def _(spark, d):
    flags = Y.text_flags(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "l18_variety_flags",
    """SELECT doc, count(DISTINCT font) > 2 AS mixed_fonts, count(DISTINCT size) > 3 AS inconsistent,
    bool_or(font IN ('SimSun', 'Courier', 'Arial', 'Calibri')) AS substituted FROM v_para GROUP BY doc""",
)
def _(spark, d):
    return Y.variety_flags(v_para(spark, d, ranked=False))


@query(
    "l19_alternate_text_flags",
    f"""SELECT doc_id, regexp_matches(text, '{Y.ALT_MARKDOWN.replace("(?d)", "")}') AS markdown_leak,
    regexp_matches(text, '{Y.ALT_ARTIFACT}') AS artifact_numbers FROM documents""",
)
def _(spark, d):
    flags = Y.alternate_text_flags(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "l19_alternate_variety_flags",
    """SELECT doc, count(DISTINCT font) > 3 AS mixed_fonts, count(DISTINCT line_spacing) > 3 AS inconsistent FROM v_para
    GROUP BY doc""",
)
def _(spark, d):
    return Y.variety_flags(v_para(spark, d, ranked=False), max_fonts=3, max_spacings=3).drop("substituted")


@query(
    "l20_confidence",
    """SELECT entity, CASE n WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT entity,
    (page_width_dxa IS NULL)::INT + (page_height_dxa IS NULL)::INT + (headings_1_font IS NULL)::INT AS n FROM rule_raw_wide)""",
)
def _(spark, d):
    return _raw_wide(spark, d).select(
        "entity", Y.confidence("page_width_dxa", "page_height_dxa", "headings_1_font").alias("confidence")
    )


# A record with own values for some headings; the rest is inherited or falls back.
_RECORD = ["*", "headings_1_font AS h1_font", "headings_1_size_halfpt AS h1_size_halfpt"]
_RECORD += ["CASE WHEN entity % 3 = 0 THEN 'center' END AS h1_alignment", "CASE WHEN entity % 4 = 0 THEN 'Georgia' END AS h4_font"]
_RECORD += ["CASE WHEN entity % 5 = 0 THEN '7' END AS element_count_tables", "CASE WHEN entity % 2 = 0 THEN 'true' END AS h6_is_italic"]


# The fallback of every key of the flat style record, for the SQL text alone; headings follow per level.
_RECORD_FALLBACKS = {
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
_RECORD_HEADING = {"font": "Calibri", "alignment": "left", "is_bold": "true", "is_italic": "false"}
_RECORD_SIZES = {1: "36", 2: "32", 3: "28", 4: "26", 5: "24", 6: "22"}
_RECORD_UNDERLINED_LEVELS = (1, 2, 3, 4)
_RECORD_SPACES = {1: ("240", "120"), 2: ("200", "100"), 3: ("160", "80")}


def _record_sql() -> str:
    own = {"h1_font", "h1_size_halfpt", "h1_alignment", "h4_font", "element_count_tables", "h6_is_italic", "body_font", "body_size_halfpt"}
    own |= {"body_alignment", "body_line_spacing_val", "body_line_spacing_rule", "body_space_before", "body_space_after"}
    own |= {"has_page_numbers", "page_number_format"}
    values = dict(_RECORD_FALLBACKS)
    for n, size in _RECORD_SIZES.items():
        values |= {f"h{n}_size_halfpt": size} | {f"h{n}_{k}": v for k, v in _RECORD_HEADING.items()}
    values |= {f"h{n}_is_underline": "false" for n in _RECORD_UNDERLINED_LEVELS}
    for n, (before, after) in _RECORD_SPACES.items():
        values |= {f"h{n}_space_before": before, f"h{n}_space_after": after}
    out = []
    for key, value in values.items():
        chain = [key] if key in own else []
        chain += [f"body_{key[3:]}"] if key[:1] == "h" and key[2:] in ("_font", "_alignment") else []
        out.append(f"coalesce({', '.join([*chain, repr(value)])}) AS {key}")
    return f"SELECT entity, {', '.join(out)} FROM (SELECT {', '.join(_RECORD)} FROM rule_raw_wide)"


@query("l21_inferred_fill", _record_sql())
def _(spark, d):
    return Y.fill(_raw_wide(spark, d).selectExpr(*_RECORD))


@query(
    "l22_style_lookup",
    """WITH r AS (SELECT s_suppkey AS request, 'Brand#' || s_nationkey AS doc, CASE s_suppkey % 3 WHEN 0 THEN 'Small  RING'
        WHEN 1 THEN 'ECO NOMY' ELSE 'missing' END AS wanted FROM supplier)
    SELECT request, r.doc, wanted, min(p_partkey) AS pos FROM r JOIN part ON p_brand = r.doc AND
    (regexp_replace(lower(p_type), '\\s+', '', 'g') = regexp_replace(lower(wanted), '\\s+', '', 'g') OR
    regexp_replace(lower(p_name), '\\s+', '', 'g') = regexp_replace(lower(wanted), '\\s+', '', 'g'))
    GROUP BY request, r.doc, wanted""",
)
def _(spark, d):
    req = table(spark, d, "supplier").selectExpr(
        "s_suppkey AS request",
        "'Brand#' || s_nationkey AS doc",
        "CASE s_suppkey % 3 WHEN 0 THEN 'Small  RING' WHEN 1 THEN 'ECO NOMY' ELSE 'missing' END AS wanted",
    )
    styles = table(spark, d, "part").selectExpr("p_brand AS doc", "p_partkey AS pos", "p_type AS style_id", "p_name AS name")
    return Y.find_styles(req, styles)


@query(
    "l29_body_usage",
    """SELECT doc, arg_min(font, pos) FILTER (font IS NOT NULL) AS body_font, arg_min(size, pos) FILTER (size IS NOT NULL) AS
    body_size, bool_or(bold) AS bold, bool_or(italic) AS italic, bool_or(underline) AS underline, max(alignment) FILTER (pos = 0) AS
    alignment, nullif(max(line_spacing_rule) FILTER (pos = 0), '') AS line_spacing_rule, max(line_spacing) FILTER (pos = 0) AS
    line_spacing, max(space_before) FILTER (pos = 0) AS space_before, max(space_after) FILTER (pos = 0) AS space_after,
    max(first_line) FILTER (pos = 0) AS first_line FROM v_para WHERE pos < 10 GROUP BY doc""",
)
def _(spark, d):
    return Y.usage_facts(v_para(spark, d))


@query(
    "l29_heading_usage",
    """SELECT doc, CAST(style[9:9] AS INTEGER) AS level, arg_max(font, pos) FILTER (font IS NOT NULL) AS font,
    arg_max(size, pos) FILTER (size IS NOT NULL) AS size, arg_max(alignment, pos) FILTER (alignment IS NOT NULL) AS alignment,
    arg_max(space_before, pos) FILTER (space_before IS NOT NULL) AS space_before, arg_max(space_after, pos) FILTER (space_after IS
    NOT NULL) AS space_after, bool_or(bold) AS bold, bool_or(italic) AS italic, bool_or(underline) AS underline FROM v_para
    WHERE style LIKE 'Heading%' GROUP BY doc, level""",
)
def _(spark, d):
    return Y.heading_usage(v_para(spark, d, ranked=False), _ORDER)


def _presets(spark, d):
    raw = table(spark, d, "supplier").selectExpr(
        "s_name AS name",
        "CASE WHEN s_nationkey = 0 THEN '' ELSE 'NATION_' || s_nationkey END AS category",
        "array('tag' || (s_suppkey % 5), ' ', 'x') AS tags",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN NULL ELSE 'Calibri' END AS bodyFont",
        "CAST(9 + s_suppkey % 3 AS STRING) AS bodySizePt",
        "'1.0' AS marginTopIn",
        "CAST(s_suppkey % 2 AS STRING) AS marginLeftIn",
        "'1.0' AS marginBottomIn",
        "CASE WHEN s_suppkey % 7 < 3 THEN '' ELSE '0.5' END AS marginRightIn",
        "'12' AS lineSpacingPt",
    )
    return C.normalise(raw)


@query(
    "l23_preset_search",
    """SELECT name, category, array_to_string(tags, ' ') AS tags, name IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000) AS
    favourite FROM clean_presets WHERE contains(lower(name || ' ' || category || ' ' || array_to_string(tags, ' ')), 'tag3')""",
)
def _(spark, d):
    fav = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_name").alias("name"))
    hits = C.search(_presets(spark, d), " TAG3 ", favourites=fav)
    return hits.select("name", "category", F.array_join("tags", " ").alias("tags"), "favourite")


@query("l23_preset_categories", "SELECT DISTINCT category FROM clean_presets")
def _(spark, d):
    return _presets(spark, d).select("category").distinct().orderBy("category")


@query(
    "l24_duplicate_presets",
    """SELECT a.name, min(b.name) AS duplicate FROM clean_presets a JOIN clean_presets b ON a.name <> b.name AND
    a."bodyFont" = b."bodyFont" AND a."bodySizePt" = b."bodySizePt" AND a."marginTopIn" = b."marginTopIn" AND
    a."marginLeftIn" = b."marginLeftIn" AND a."marginBottomIn" = b."marginBottomIn" AND a."marginRightIn" = b."marginRightIn" AND
    a."lineSpacingPt" = b."lineSpacingPt" GROUP BY a.name""",
)
def _(spark, d):
    return C.duplicates(_presets(spark, d))


@query(
    "l25_import_merge",
    """WITH c AS (SELECT o.name AS old, n.name AS new, coalesce(o.name, n.name) AS name FROM old_names o FULL JOIN new_names n
        ON n.name = o.name),
    taken AS (SELECT name FROM old_names UNION SELECT name FROM new_names),
    free AS (SELECT c.name, min(i) AS n FROM c, range(2, 9) AS t(i) WHERE c.old IS NOT NULL AND c.new IS NOT NULL AND
        c.name || ' (' || i || ')' NOT IN (SELECT name FROM taken) GROUP BY c.name)
    SELECT 'skip' AS strategy, name, CASE WHEN old IS NULL THEN 'incoming' ELSE 'existing' END AS origin,
        CASE WHEN old IS NOT NULL AND new IS NOT NULL THEN 'skip' WHEN new IS NOT NULL THEN 'imported' ELSE 'kept' END AS outcome FROM c
    UNION ALL SELECT 'overwrite', name, CASE WHEN new IS NULL THEN 'existing' ELSE 'incoming' END,
        CASE WHEN old IS NOT NULL AND new IS NOT NULL THEN 'overwrite' WHEN new IS NOT NULL THEN 'imported' ELSE 'kept' END FROM c
    UNION ALL SELECT 'rename', name, CASE WHEN old IS NULL THEN 'incoming' ELSE 'existing' END,
        CASE WHEN old IS NULL THEN 'imported' ELSE 'kept' END FROM c
    UNION ALL SELECT 'rename', name || ' (' || n || ')', 'incoming', 'renamed' FROM free""",
)
def _(spark, d):
    s = table(spark, d, "supplier")
    old = s.select(F.col("s_name").alias("name"))
    for suffix, below in ((" (2)", 8), (" (3)", 4), (" (5)", 4)):
        old = old.unionByName(
            s.filter(F.col("s_nationkey") < below).select(F.concat("s_name", F.lit(suffix)).alias("name"))
        )
    new = table(spark, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"))
    out = None
    for strategy in ("skip", "overwrite", "rename"):
        part = C.import_merge(old, new, strategy).withColumn("strategy", F.lit(strategy))
        out = part if out is None else out.unionByName(part)
    return out


_NAMED_ROWS = ", ".join(f"('{k}', '{f}', '{s}', '{m}', '{sp}')" for k, (f, s, m, sp) in C.NAMED.items())


@query(
    "l26_preset_expansion",
    f"""SELECT name, preset, coalesce(f, "bodyFont") AS "bodyFont", coalesce(s, "bodySizePt") AS "bodySizePt",
    coalesce(m, "marginTopIn") AS "marginTopIn", coalesce(m, "marginLeftIn") AS "marginLeftIn", coalesce(m, "marginBottomIn") AS
    "marginBottomIn", coalesce(m, "marginRightIn") AS "marginRightIn", coalesce(sp, "lineSpacingPt") AS "lineSpacingPt"
    FROM (SELECT *, CASE category WHEN 'NATION_1' THEN 'academic' WHEN 'NATION_2' THEN 'formal' WHEN 'NATION_3' THEN 'compact'
    WHEN 'NATION_4' THEN 'generous' WHEN 'NATION_5' THEN 'minimal' ELSE 'none' END AS preset FROM clean_presets) p
    LEFT JOIN (VALUES {_NAMED_ROWS}) AS t(k, f, s, m, sp) ON t.k = p.preset""",
)
def _(spark, d):
    rows = _presets(spark, d).withColumn(
        "preset",
        F.expr(
            "CASE category WHEN 'NATION_1' THEN 'academic' WHEN 'NATION_2' THEN 'formal' WHEN 'NATION_3' THEN 'compact' "
            "WHEN 'NATION_4' THEN 'generous' WHEN 'NATION_5' THEN 'minimal' ELSE 'none' END"
        ),
    )
    return C.expand_named(rows, C.named_presets(spark))
