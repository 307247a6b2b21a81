"""L1-L10, L27, L28, R11, R12 (style digest), H8: rule layers over customers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import layers as L
from quire.plans import sqltext as S
from quire.plans.base import ctes, query, table
from quire.plans.score_queries import _rules

# The extracted layer as expressions both engines read; {k} is the customer key (shifted for the override layer).
LAYER = {
    "page_width_dxa": "CAST(2500 + ({k} % 20) * 500 AS STRING)",
    "page_height_dxa": "CASE WHEN {k} % 11 = 0 THEN NULL ELSE '15840' END",
    "margin_top_dxa": "CAST(({k} % 13) * 500 - 300 AS STRING)",
    "margin_bottom_dxa": "CASE WHEN {k} % 4 = 0 THEN NULL ELSE '1440' END",
    "margin_left_dxa": "CAST(({k} % 17) * 400 - 200 AS STRING)",
    "margin_right_dxa": "CAST(({k} % 6) * 1000 AS STRING)",
    "body_size_halfpt": "CAST(10 + {k} % 100 AS STRING)",
    "body_font": "CASE c_nationkey % 5 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Calibri' WHEN 2 THEN ' TIMES roman' WHEN 3 THEN 'Courier New' ELSE '' END",
    "body_alignment": "CASE {k} % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'left' WHEN 2 THEN ' Justify ' WHEN 3 THEN 'center' ELSE 'RIGHT' END",
    "body_line_spacing_val": "CAST(({k} % 4) * 120 AS STRING)",
    "body_line_spacing_rule": "CASE {k} % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'Double' ELSE NULL END",
    "body_space_before": "CAST({k} % 3 AS STRING)",
    "body_space_after": "CAST(({k} % 3) * 60 AS STRING)",
    "headings.1.font": "CASE WHEN {k} % 2 = 0 THEN NULL ELSE 'Calibri Light' END",
    "headings.1.size_halfpt": "CAST(36 + {k} % 8 AS STRING)",
    "headings.2.bold": "CASE {k} % 3 WHEN 0 THEN 'false' WHEN 1 THEN '' ELSE NULL END",
    "headings.6.alignment": "CASE WHEN {k} % 5 = 0 THEN 'center' ELSE NULL END",
    "margin_header_dxa": "CAST(({k} % 4) * 300 AS STRING)",
    "has_page_numbers": "CASE {k} % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '' ELSE NULL END",
    "has_body_section": "CASE {k} % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE NULL END",
    "page_number_format": "CASE {k} % 3 WHEN 0 THEN 'upperRoman' WHEN 1 THEN '' ELSE NULL END",
    "body_page_format": "CASE WHEN {k} % 5 = 0 THEN 'lowerLetter' ELSE NULL END",
    "cover_title_bold": "CASE {k} % 3 WHEN 0 THEN 'false' WHEN 1 THEN '' ELSE NULL END",
    "cover_summary_text": "CASE {k} % 4 WHEN 0 THEN 'Summary ' || c_name WHEN 1 THEN '' ELSE NULL END",
    "signature_name_size_pt": "CASE WHEN {k} % 2 = 0 THEN '0' ELSE NULL END",
    "list_first_line_indent_pt": "CASE WHEN {k} % 2 = 0 THEN CAST({k} % 9 AS STRING) ELSE NULL END",
    "h1_left_indent_dxa": "CASE WHEN {k} % 3 = 0 THEN '0' ELSE CAST({k} % 200 AS STRING) END",
}
_K = "c_custkey"


def _items():
    """(key, value expression, priority, seq, source) of every rule row of a customer."""
    for i, (key, expr) in enumerate(LAYER.items()):
        if key in L.DEFAULTS:
            yield key, f"'{L.DEFAULTS[key]}'", 0, i, "defaults"
        yield key, f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE {expr.format(k=_K)} END", 1, i, "extracted"
        yield key, f"CASE WHEN {_K} % 7 = 0 THEN {expr.format(k='(' + _K + ' + 5)')} ELSE NULL END", 2, i, "override"
    for i, (key, value) in enumerate(L.DEFAULTS.items()):
        if key not in LAYER:
            yield key, f"'{value}'", 0, 100 + i, "defaults"


def _props():
    """Style properties with ties, contradictions and invalid priorities."""
    yield "font_size_pt", "'11'", "0", 1, "system"
    yield "font_size_pt", f"CAST(8 + {_K} % 9 AS STRING)", "1", 2, "template"
    yield "font_size_pt", f"CAST(9 + {_K} % 5 AS STRING)", f"CASE WHEN {_K} % 4 = 0 THEN 1 ELSE 0 END", 3, "template:late"
    yield "font_size_pt", "'99'", f"CASE WHEN {_K} % 9 = 0 THEN 5 ELSE 2 END", 4, "user"
    yield "keep_with_next", f"CASE WHEN {_K} % 2 = 0 THEN 'true' ELSE 'false' END", "1", 5, "template"
    yield "keep_with_next", "'false'", "2", 6, "user"
    yield "force_page_break_before", f"CASE WHEN {_K} % 5 = 0 THEN 'true' ELSE 'false' END", "0", 7, "system"
    yield "force_page_break_before", f"CASE WHEN {_K} % 6 = 0 THEN 'true' ELSE 'false' END", "1", 8, "template"


def _duck_rows(items) -> str:
    structs = ", ".join(
        f"{{'key': '{k}', 'value': {v}, 'priority': CAST({p} AS INTEGER), 'seq': {s}, 'source': '{src}'}}" for k, v, p, s, src in items
    )
    return f"SELECT entity, r.key AS key, r.value AS value, r.priority AS priority, r.seq AS seq, r.source AS source FROM (SELECT c_custkey AS entity, unnest([{structs}]) AS r FROM customer)"


#: Customers of one task: each becomes some hundred rule rows.
SHARE = 1 << 12


def _customers(spark, d):
    """The customers dealt by key before each becomes many rows, which are then merged where they are. The few columns of a
    customer move, in as many parts as the table needs; a file that is one split does not stay in one task."""
    c = table(spark, d, "customer")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return c.repartition(max(width, -(-c.count() // SHARE)), _K)


def _placed_customers(spark, d):
    """The customers where they are if no split holds more than a task's share, else dealt by key: nothing has to meet, but a
    file that is one split would become all its leaves in one task. Counting the rows of a split reads no column."""
    c = table(spark, d, "customer")
    longest = c.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0
    return c if longest <= SHARE else _customers(spark, d)


def _spark_rows(spark, d, items):
    computed = {}

    def settled(expr):
        """Literals as they are; other expressions as columns made before the explosion, which is not generated code."""
        expr = str(expr)
        return expr if re.fullmatch(r"'[^']*'|\d+", expr) else computed.setdefault(expr, f"_e{len(computed)}")

    structs = ", ".join(
        f"named_struct('key', '{k}', 'value', {settled(v)}, 'priority', CAST({settled(p)} AS INT), 'seq', {s}, 'source', '{src}')"
        for k, v, p, s, src in items
    )
    c = _customers(spark, d).selectExpr("c_custkey AS entity", *[f"{e} AS {n}" for e, n in computed.items()])
    return c.selectExpr("entity", f"explode(array({structs})) AS r").select("entity", "r.*")


KEYS = list(LAYER)
WIDE = ", ".join(f"max(value) FILTER (key = '{k}') AS {k.replace('.', '_')}" for k in KEYS)

_FORM = {
    "bodyFont": "CASE c_nationkey % 4 WHEN 0 THEN ' Arial ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Georgia' END",
    "bodySizePt": "CASE WHEN c_custkey % 10 = 0 THEN 'twelve' WHEN c_custkey % 10 = 1 THEN '' ELSE CAST((c_custkey % 50) * 0.25 AS STRING) END",
    "marginTopIn": "CASE WHEN c_custkey % 8 = 0 THEN '-1' ELSE CAST((c_custkey % 9) * 0.125 AS STRING) END",
    "marginLeftIn": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE ' 1.5 ' END",
    "marginBottomIn": "CAST(c_custkey % 3 AS STRING)",
    "marginRightIn": "CASE WHEN c_custkey % 5 = 0 THEN 'abc' ELSE '0.7501' END",
    "lineSpacingPt": "CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE CAST((c_custkey % 40) * 0.625 AS STRING) END",
}


def _num(name):
    return f"TRY_CAST({S.strip(name)} AS DOUBLE)"


def _margin(name):
    return f"CASE WHEN {_num(name)} >= 0 THEN CAST(round_even({_num(name)} * 1440.0, 0) AS INTEGER) END"


def _falsy(x, default):
    return f"CASE WHEN {x} IS NULL OR CAST({x} AS VARCHAR) IN ('', '0', '0.0', 'false') THEN {default} ELSE {x} END"


def _warn_sql():
    parts = [f"CASE WHEN {k} IS NULL THEN 'Required key is None: {k}' END" for k in L.REQUIRED]
    n = lambda k: f"TRY_CAST({k} AS BIGINT)"
    parts.append(f"CASE WHEN {n('page_width_dxa')} <> 0 AND {n('page_width_dxa')} < 3000 THEN 'Page width suspiciously small (< 2 inches)' END")
    parts.append(f"CASE WHEN {n('body_size_halfpt')} <> 0 AND {n('body_size_halfpt')} < 16 THEN 'Body font size very small (< 8pt)' END")
    parts.append(f"CASE WHEN {n('body_size_halfpt')} > 96 THEN 'Body font size very large (> 48pt)' END")
    for m in L.MARGINS:
        parts.append(f"CASE WHEN {n(m)} < 0 THEN 'Negative margin detected' END")
        parts.append(f"CASE WHEN {n(m)} > 5400 THEN 'Unusually large margin detected' END")
    return f"concat_ws('|', {', '.join(parts)})"


ctes(
    v_rulekv=_duck_rows(_items()),
    v_props=_duck_rows(_props()),
    rule_merged="""SELECT entity, key, arg_max(value, priority) AS value, arg_max(source, priority) AS source FROM v_rulekv
        WHERE value IS NOT NULL GROUP BY entity, key""",
    rule_extracted="""SELECT entity, key, arg_max(value, priority) AS value FROM v_rulekv WHERE value IS NOT NULL AND priority < 2
        GROUP BY entity, key""",
    rule_wide=f"SELECT entity, {WIDE} FROM rule_merged GROUP BY entity",
    rule_raw_wide=f"SELECT entity, {WIDE} FROM v_rulekv WHERE priority = 1 GROUP BY entity",
    v_forms="SELECT c_custkey AS entity, " + ", ".join(f"{e} AS \"{n}\"" for n, e in _FORM.items()) + " FROM customer",
    v_measures="""SELECT c_custkey AS entity, abs(c_acctbal) AS amount, CASE c_custkey % 6 WHEN 0 THEN 'pt' WHEN 1 THEN ' IN '
        WHEN 2 THEN 'cm' WHEN 3 THEN 'mm' WHEN 4 THEN 'emu' ELSE 'px' END AS unit FROM customer""",
    v_styleref="""SELECT c_custkey AS entity, CASE WHEN c_custkey % 10 = 0 THEN c_name WHEN c_custkey % 10 = 1 THEN '  ' END AS
        source_filename, CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 7 = 1 THEN 0 END AS footer_count, 0 AS header_count,
        CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS section_count, CAST(NULL AS INTEGER) AS table_count, c_nationkey % 2 AS
        image_count, CASE WHEN c_mktsegment = 'BUILDING' THEN ['Intro', ' ', 'Results '] ELSE [] END AS detected_headings,
        CASE c_nationkey % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN '' END AS body_font, c_custkey % 30 AS body_size_halfpt,
        CASE WHEN c_custkey % 2 = 0 THEN 'left' END AS body_alignment, c_custkey % 4 * 100 AS body_left_indent_dxa,
        c_custkey % 3 * 120 AS body_line_spacing_val, c_custkey % 2 * 50 AS body_first_line_indent_dxa, c_custkey FROM customer""",
)


def _kv(spark, d):
    return _spark_rows(spark, d, _items())


def _wide(spark, d):
    return L.widen(L.merge(_kv(spark, d)), KEYS)


def _raw_wide(spark, d):
    return L.widen(_kv(spark, d).filter(F.col("priority") == 1), KEYS)


def _layer(condition: str, shift: str = "") -> str:
    leaves = ", ".join(f"'{k}', {e.format(k=f'({_K}{shift})')}" for k, e in LAYER.items())
    return f"CASE WHEN {condition} THEN map({leaves}) END"


def v_layers(spark, d):
    """A customer's extracted and override layer as maps; leaves may be null, a layer may be missing."""
    return _placed_customers(spark, d).selectExpr(
        "c_custkey AS entity", f"{_layer(_K + ' % 3 <> 0')} AS extracted", f"{_layer(_K + ' % 7 = 0', ' + 5')} AS overrides"
    )


def _sparse(spark, d):
    """The leaves of the two layers as rows, without the defaults."""
    return _spark_rows(spark, d, [x for x in _items() if x[2] > 0]).filter(F.col("value").isNotNull())


@query("l01_layered_merge", "SELECT * FROM rule_merged")
def _(spark, d):
    return L.rule_rows(v_layers(spark, d), L.resolved(F.col("extracted"), F.col("overrides")))


@query("l01_row_merge", "SELECT * FROM rule_merged")
def _(spark, d):
    maps = L.layer_maps(_sparse(spark, d), {1: "extracted", 2: "overrides"})
    # Maps are far larger than their size estimate; both sides are dealt by entity and are merged there.
    every = _customers(spark, d).select(F.col(_K).alias("entity")).join(maps.hint("merge"), "entity", "left")
    return L.rule_rows(every, L.resolved(F.col("extracted"), F.col("overrides")))


@query(
    "l01_source_flags",
    """SELECT entity, coalesce(bool_or(value IS NOT NULL AND priority = 1), false) AS extracted,
    bool_or(value IS NOT NULL AND priority = 2) AS overridden FROM v_rulekv GROUP BY entity""",
)
def _(spark, d):
    return L.source_flags(_kv(spark, d))


@query(
    "l02_priority_merge",
    """SELECT entity, key, arg_max(value, priority * 100 + seq) AS value FROM v_props WHERE priority IN (0, 1, 2)
    GROUP BY entity, key""",
)
def _(spark, d):
    return L.priority_merge(L.split_priorities(_spark_rows(spark, d, _props()))[0])


@query("l02_invalid_priorities", "SELECT entity, key, priority, source FROM v_props WHERE priority NOT IN (0, 1, 2)")
def _(spark, d):
    return L.split_priorities(_spark_rows(spark, d, _props()))[1].select("entity", "key", "priority", "source")


@query(
    "l03_contradictions",
    """SELECT entity, keep_sources, break_sources FROM (SELECT entity,
    string_agg(DISTINCT source, ',' ORDER BY source) FILTER (key = 'keep_with_next' AND value = 'true') AS keep_sources,
    string_agg(DISTINCT source, ',' ORDER BY source) FILTER (key = 'force_page_break_before' AND value = 'true') AS break_sources
    FROM v_props GROUP BY entity) WHERE keep_sources IS NOT NULL AND break_sources IS NOT NULL""",
)
def _(spark, d):
    out = L.contradictions(_spark_rows(spark, d, _props()))
    return out.select(
        "entity",
        F.array_join("keep_sources", ",").alias("keep_sources"),
        F.array_join("break_sources", ",").alias("break_sources"),
    )


@query(
    "l04_range_validation",
    f"""SELECT entity, warnings, warnings = '' AS is_valid FROM (SELECT entity, {_warn_sql()} AS warnings FROM rule_raw_wide)""",
)
def _(spark, d):
    w = _raw_wide(spark, d).select("entity", L.warnings().alias("w"))
    return w.select("entity", F.array_join("w", "|").alias("warnings"), (F.size("w") == 0).alias("is_valid"))


@query(
    "l05_rule_diff",
    """SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.key, b.key) AS key, a.value AS before, b.value AS after
    FROM (SELECT entity, key, value FROM v_rulekv WHERE priority = 1 AND value IS NOT NULL) a FULL JOIN rule_merged b
    ON a.entity = b.entity AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value""",
)
def _(spark, d):
    known = F.map_filter(F.col("extracted"), lambda _, v: v.isNotNull())
    return L.diff_maps(v_layers(spark, d), known, L.resolved(F.col("extracted"), F.col("overrides")))


@query(
    "l05_row_diff",
    """SELECT entity, key, max(value) FILTER (priority = 1) AS before, max(value) FILTER (priority = 2) AS after FROM v_rulekv
    WHERE priority > 0 AND value IS NOT NULL GROUP BY entity, key HAVING before IS DISTINCT FROM after""",
)
def _(spark, d):
    rows = _sparse(spark, d)
    return L.diff(rows.filter("priority = 1"), rows.filter("priority = 2"))


@query(
    "l06_override_conversion",
    f"""SELECT entity, nullif({S.strip('coalesce("bodyFont", chr(32))')}, '') AS body_font,
    CASE WHEN {_num('"bodySizePt"')} > 0 THEN CAST(round_even({_num('"bodySizePt"')} * 2.0, 0) AS INTEGER) END AS body_size_halfpt,
    {_margin('"marginTopIn"')} AS margin_top_dxa, {_margin('"marginLeftIn"')} AS margin_left_dxa,
    {_margin('"marginBottomIn"')} AS margin_bottom_dxa, {_margin('"marginRightIn"')} AS margin_right_dxa,
    CASE WHEN {_num('"lineSpacingPt"')} > 0 THEN CAST(round_even({_num('"lineSpacingPt"')} * 20.0, 0) AS INTEGER) END
    AS body_line_spacing_val FROM v_forms""",
)
def _(spark, d):
    forms = table(spark, d, "customer").selectExpr("c_custkey AS entity", *[f"{e} AS {n}" for n, e in _FORM.items()])
    return L.convert_overrides(forms)


@query(
    "l07_unit_conversion",
    """SELECT entity, emu, CAST(round(CAST(emu AS DECIMAL(30,10)) / 12700, 4) AS DOUBLE) AS points,
    amount / 1440.0 AS inches, amount / 2.0 AS half_points, amount / 20.0 AS twips FROM (
    SELECT entity, amount, CAST(round(CAST(amount AS DECIMAL(20,4)) * CASE lower(trim(unit)) WHEN 'pt' THEN 12700 WHEN 'in' THEN 914400
    WHEN 'cm' THEN 360000 WHEN 'mm' THEN 36000 WHEN 'emu' THEN 1 END, 0) AS BIGINT) AS emu FROM v_measures)""",
)
def _(spark, d):
    unit = F.expr(
        "CASE c_custkey % 6 WHEN 0 THEN 'pt' WHEN 1 THEN ' IN ' WHEN 2 THEN 'cm' WHEN 3 THEN 'mm' WHEN 4 THEN 'emu' ELSE 'px' END"
    )
    amount = F.abs("c_acctbal")
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), U.to_emu(amount, unit).alias("emu"), amount.alias("amount")
    )
    return rows.select(
        "entity",
        "emu",
        U.emu_to_pt(F.col("emu")).cast("double").alias("points"),
        U.dxa_to_inches(F.col("amount")).alias("inches"),
        U.halfpt_to_pt(F.col("amount")).alias("half_points"),
        U.twips_to_pt(F.col("amount")).alias("twips"),
    )


_TYPE = {
    "type_font": "CASE WHEN entity % 4 = 0 THEN 'Georgia' WHEN entity % 4 = 1 THEN '' ELSE NULL END",
    "type_alignment": "CASE WHEN entity % 2 = 0 THEN 'left' ELSE NULL END",
    "type_spacing": "CASE entity % 5 WHEN 0 THEN ' Double ' WHEN 1 THEN '1.5' WHEN 2 THEN '' ELSE NULL END",
}


# The expected defaults of the effective formatting, for the SQL text alone.
_FALSY_DEFAULTS = {
    "page_width_dxa": "11906",
    "page_height_dxa": "16838",
    "margin_top_dxa": "1440",
    "margin_bottom_dxa": "1440",
    "margin_left_dxa": "1800",
    "margin_right_dxa": "1800",
    "margin_header_dxa": "720",
    "margin_footer_dxa": "720",
    "body_size_halfpt": "24",
    "body_line_spacing_val": "360",
    "body_space_after": "120",
    "body_page_format": "decimal",
    "prelim_page_format": "lowerRoman",
    "page_number_alignment": "center",
}
_NULL_DEFAULTS = {
    "body_space_before": "0",
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
}
_NO_DEFAULTS = [
    "body_left_indent_dxa",
    "body_right_indent_dxa",
    "body_first_line_indent_dxa",
    "list_first_line_indent_pt",
    "h1_left_indent_dxa",
    "h1_right_indent_dxa",
    "h1_first_line_indent_dxa",
    "h2_left_indent_dxa",
    "h2_right_indent_dxa",
    "h2_first_line_indent_dxa",
    "h3_left_indent_dxa",
    "h3_right_indent_dxa",
    "h3_first_line_indent_dxa",
]
_FLAGS = ["has_page_numbers", "page_number_section_restart", "has_cover_section", "has_prelim_section", "has_cover_image"]
_HEADING_SIZES = {
    1: {"size_halfpt": "36", "space_before": "240", "space_after": "120"},
    2: {"size_halfpt": "32", "space_before": "200", "space_after": "100"},
    3: {"size_halfpt": "28", "space_before": "160", "space_after": "80"},
    4: {"size_halfpt": "26", "space_before": "120", "space_after": "60"},
    5: {"size_halfpt": "24", "space_before": "100", "space_after": "50"},
    6: {"size_halfpt": "22", "space_before": "80", "space_after": "40"},
}
_HEADING_SHARED = {
    "font": "Calibri",
    "alignment": "left",
    "bold": "true",
    "italic": "false",
    "underline": "false",
    "caps": "false",
    "small_caps": "false",
    "numbering": "false",
}


def _effective_sql() -> str:
    r = lambda k: f"m['{k}']"
    truthy = lambda x: f"NOT ({x} IS NULL OR {x} IN ('', '0', '0.0', 'false'))"
    out = {k: _falsy(r(k), f"'{v}'") for k, v in _FALSY_DEFAULTS.items()}
    out["body_font"] = _falsy(r("body_font"), "(" + _falsy("type_font", "'Times New Roman'") + ")")
    out["body_alignment"] = _falsy(r("body_alignment"), "(" + _falsy("type_alignment", "'both'") + ")")
    out["body_line_spacing_factor"] = f"""(CASE lower(trim(coalesce({_falsy('type_spacing', r('body_line_spacing_rule'))}, ''))) WHEN 'single' THEN 1.0
        WHEN '1' THEN 1.0 WHEN '1.0' THEN 1.0 WHEN '1.5' THEN 1.5 WHEN 'double' THEN 2.0 ELSE
        round(CAST(coalesce({r('body_line_spacing_val')}, '360') AS DOUBLE) / 240.0, 6) END)::DOUBLE"""
    out |= {k: f"coalesce({r(k)}, '{v}')" for k, v in _NULL_DEFAULTS.items()}
    out |= {k: r(k) for k in _NO_DEFAULTS}
    out |= {k: truthy(r(k)) for k in _FLAGS}
    out["has_body_section"] = f"NOT list_contains(map_keys(m), 'has_body_section') OR {truthy(r('has_body_section'))}"
    out["heading_numbering"] = "coalesce(numbered, false)"
    out["page_number_format"] = _falsy(r("page_number_format"), "(" + _falsy(r("body_page_format"), "'decimal'") + ")")
    out["cover_summary_text"] = _falsy(r("cover_summary_text"), "compiled_summary")
    for level, sizes in _HEADING_SIZES.items():
        for field, value in (sizes | _HEADING_SHARED).items():
            key = f"headings.{level}.{field}"
            out[f"heading_{level}_{field}"] = f"CASE WHEN list_contains(map_keys(m), '{key}') THEN {r(key)} ELSE '{value}' END"
    layer = ", ".join(f"{{'k': '{k}', 'v': {e.format(k=_K)}}}" for k, e in LAYER.items())
    return f"""SELECT entity, {', '.join(f'{e} AS {k}' for k, e in out.items())} FROM (SELECT *, map_from_entries(list_filter(CASE
        WHEN entity % 3 = 0 AND entity % 2 = 0 THEN [{{'k': 'body_font', 'v': 'Flat'}}, {{'k': 'body_space_after', 'v': NULL}}]
        WHEN entity % 3 = 0 THEN [] ELSE own END, lambda x: x.v IS NOT NULL OR x.k = 'headings.2.bold')) AS m FROM (SELECT
        c_custkey AS entity, [{layer}] AS own, {', '.join(f'{e} AS {n}' for n, e in _TYPE.items())} FROM customer))"""


_TYPE = {
    "type_font": "CASE WHEN c_custkey % 4 = 0 THEN 'Georgia' WHEN c_custkey % 4 = 1 THEN '' ELSE NULL END",
    "type_alignment": "CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE NULL END",
    "type_spacing": "CASE c_custkey % 5 WHEN 0 THEN ' Double ' WHEN 1 THEN '1.5' WHEN 2 THEN '' ELSE NULL END",
    "numbered": "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "compiled_summary": "CASE WHEN c_custkey % 2 = 0 THEN 'compiled' ELSE NULL END",
}


@query("l08_effective_formatting", _effective_sql())
def _(spark, d):
    """The extracted layer as the resolved rules: null leaves are left out but for one, which counts though it is null."""
    kept = "map_filter(extracted, (k, v) -> v IS NOT NULL OR k = 'headings.2.bold')"
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey AS entity", f"{_layer(_K + ' % 3 <> 0')} AS extracted", *[f"{e} AS {n}" for n, e in _TYPE.items()]
    )
    return L.effective_formatting(rows.selectExpr(
        "entity", f"{kept} AS rules",
        "CASE WHEN entity % 2 = 0 THEN map('body_font', 'Flat', 'body_space_after', CAST(NULL AS STRING)) END AS flat",
        "map('font_family', type_font, 'alignment', type_alignment, 'line_spacing', type_spacing) AS typography",
        "numbered AS heading_numbering", "compiled_summary AS cover_summary_text",
    ))


@query(
    "l09_label_pick",
    """SELECT c_custkey AS entity, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''), 'Prepared By') AS label
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '  ' END AS a, CASE WHEN c_custkey % 4 = 0 THEN
    ' ' || c_mktsegment ELSE NULL END AS b, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'Nation ' || c_nationkey END AS c
    FROM customer)""",
)
def _(spark, d):
    c = table(spark, d, "customer").selectExpr(
        "c_custkey AS entity",
        "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '  ' END AS a",
        "CASE WHEN c_custkey % 4 = 0 THEN ' ' || c_mktsegment ELSE NULL END AS b",
        "CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'Nation ' || c_nationkey END AS c",
    )
    return c.select("entity", L.first_filled(F.col("a"), F.col("b"), F.col("c"), default="Prepared By").alias("label"))


@query(
    "l10_normalised_categories",
    """SELECT entity, CASE WHEN a IN ('both', 'justified', 'justify') THEN 'justify' WHEN a = 'center' THEN 'center'
    WHEN a = 'right' THEN 'right' ELSE 'left' END AS alignment, CASE WHEN contains(f, 'times') THEN 'Times-Roman'
    WHEN contains(f, 'courier') THEN 'Courier' ELSE 'Helvetica' END AS font FROM (SELECT entity,
    lower(trim(coalesce(body_alignment, ''))) AS a, lower(coalesce(body_font, '')) AS f FROM rule_raw_wide)""",
)
def _(spark, d):
    return _raw_wide(spark, d).select(
        "entity",
        L.alignment_class(F.col("body_alignment")).alias("alignment"),
        L.font_class(F.col("body_font")).alias("font"),
    )


@query(
    "l27_constraint_strings",
    """SELECT doc_id, concat_ws('|', 'margins:1in', 'line_spacing:' || line_spacing, 'alignment:' || alignment,
    'max_heading_depth:' || max_heading_depth, CASE WHEN target_pages > 0 THEN 'target_pages:' || target_pages END) AS items,
    line_spacing AS spacing_read, CASE WHEN target_pages > 0 THEN target_pages::VARCHAR ELSE 'auto' END AS pages_read
    FROM conv_brief""",
)
def _(spark, d):
    items = L.constraint_list(
        F.col("line_spacing"), F.col("alignment"), F.col("max_heading_depth"), F.col("target_pages")
    )
    r = _rules(spark, d).select("doc_id", items.alias("items"))
    return r.select(
        "doc_id",
        F.array_join("items", "|").alias("items"),
        L.constraint_value(F.col("items"), "line_spacing", F.lit("single")).alias("spacing_read"),
        L.constraint_value(F.col("items"), "target_pages", F.lit("auto")).alias("pages_read"),
    )


def _geo(k):
    return f"CAST({_falsy(k, chr(39) + L.DEFAULTS[k] + chr(39))} AS BIGINT)"


@query(
    "l28_geometry",
    f"""SELECT entity, w AS usable_width, h AS usable_height, w / 20.0::DOUBLE AS column_width_pt, h / 20.0::DOUBLE AS usable_height_pt, CAST(greatest(0, floor(w / 2.0)) AS BIGINT) AS half_column,
    entity % 4 = 0 OR entity % 6 = 1 AS split_requested FROM (SELECT entity, {_geo('page_width_dxa')} - {_geo('margin_left_dxa')} -
    {_geo('margin_right_dxa')} AS w, {_geo('page_height_dxa')} - {_geo('margin_top_dxa')} - {_geo('margin_bottom_dxa')} AS h
    FROM rule_wide)""",
)
def _(spark, d):
    rows = _wide(spark, d).selectExpr(
        "*",
        "entity % 4 = 0 AS has_cover_section",
        "CASE WHEN entity % 6 = 1 THEN true END AS has_prelim_section",
        "CAST(NULL AS BOOLEAN) AS has_cover_image",
    )
    return L.geometry(rows)


def _styleref(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS entity",
        "CASE WHEN c_custkey % 10 = 0 THEN c_name WHEN c_custkey % 10 = 1 THEN '  ' END AS source_filename",
        "CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 7 = 1 THEN 0 END AS footer_count",
        "0 AS header_count",
        "CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS section_count",
        "CAST(NULL AS INT) AS table_count",
        "c_nationkey % 2 AS image_count",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN array('Intro', ' ', 'Results ') ELSE array() END AS detected_headings",
        "CASE c_nationkey % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN '' END AS body_font",
        "c_custkey % 30 AS body_size_halfpt",
        "CASE WHEN c_custkey % 2 = 0 THEN 'left' END AS body_alignment",
        "c_custkey % 4 * 100 AS body_left_indent_dxa",
        "c_custkey % 3 * 120 AS body_line_spacing_val",
        "c_custkey % 2 * 50 AS body_first_line_indent_dxa",
        "CAST(NULL AS INT) AS body_right_indent_dxa",
        "CASE WHEN c_custkey % 5 = 0 THEN 18 END AS list_left_indent_pt",
        "CASE WHEN c_custkey % 2 = 0 THEN 20 END AS cover_title_size_pt",
        "CAST(NULL AS INT) AS cover_subtitle_size_pt",
        "CASE WHEN c_custkey % 4 = 0 THEN 'upperRoman' END AS prelim_page_format",
        "'' AS body_page_format",
    )


_HAS_REF = """(trim(coalesce(source_filename, '')) <> '' OR coalesce(footer_count, 0) > 0 OR header_count > 0 OR section_count > 0
    OR coalesce(table_count, 0) > 0 OR image_count > 0 OR len(detected_headings) > 0)"""


@query("r11_has_style_reference", f"SELECT entity, {_HAS_REF} AS has_reference FROM v_styleref")
def _(spark, d):
    return _styleref(spark, d).select("entity", L.has_style_reference().alias("has_reference"))


@query(
    "r12_style_digest",
    f"""SELECT entity, CASE WHEN NOT {_HAS_REF} THEN 'No DOCX style reference provided.' ELSE 'DOCX STYLE BLUEPRINT:' || chr(10) ||
    '- Use the uploaded DOCX only as a structural and visual reference, not as wording to copy.' || chr(10) ||
    '- Body font: ' || coalesce(nullif(body_font, ''), 'Times New Roman') || chr(10) || '- Body size: ' ||
    CASE WHEN body_size_halfpt > 0 THEN (body_size_halfpt // 2) || CASE WHEN body_size_halfpt % 2 = 1 THEN '.5' ELSE '.0' END
    ELSE 'unknown' END || 'pt' || chr(10) || '- Body alignment: ' || coalesce(body_alignment, 'both') || chr(10) ||
    '- Body line spacing: ' || CASE WHEN body_line_spacing_val = 0 THEN '360' ELSE body_line_spacing_val::VARCHAR END || chr(10) ||
    '- Body indents: left ' || CASE WHEN body_left_indent_dxa = 0 THEN 'n/a' ELSE body_left_indent_dxa::VARCHAR END ||
    ' dxa, first-line ' || CASE WHEN body_first_line_indent_dxa = 0 THEN 'n/a' ELSE body_first_line_indent_dxa::VARCHAR END ||
    ' dxa, right n/a dxa' || chr(10) || '- List left indent: ' || CASE WHEN c_custkey % 5 = 0 THEN '18' ELSE 'n/a' END || ' pt' || chr(10)
    || '- Cover title size: ' || CASE WHEN c_custkey % 2 = 0 THEN '20' ELSE 'n/a' END || ' pt' || chr(10) ||
    '- Cover subtitle size: n/a pt' || chr(10) || '- Page numbering: prelim ' || CASE WHEN c_custkey % 4 = 0 THEN 'upperRoman' ELSE
    'lowerRoman' END || ', body decimal' || chr(10) || '- Sections detected: ' || CASE WHEN section_count = 0 AND
    len(detected_headings) > 0 THEN 2 ELSE section_count END || chr(10) || '- Tables detected: 0' || chr(10) ||
    '- Images detected: ' || image_count || CASE WHEN len(detected_headings) > 0 THEN chr(10) || 'Reference heading blueprint:' ||
    chr(10) || '- Intro' || chr(10) || '- Results' ELSE '' END END AS digest FROM v_styleref""",
)
def _(spark, d):
    return L.style_digests(_styleref(spark, d))


def _inch(x):
    cents = f"((abs({x}) * 100 + 720) // 1440)"
    return f"""CASE WHEN {x} < 0 AND {cents} > 0 THEN '-' ELSE '' END || ({cents} // 100) || '.' ||
        lpad(({cents} % 100)::VARCHAR, 2, '0') || '"'"""


@query(
    "h08_rules_summary",
    f"""SELECT entity, {_inch('CAST(page_width_dxa AS BIGINT)')} AS page_width, {_inch('CAST(page_height_dxa AS BIGINT)')} AS
    page_height, {_inch('CAST(margin_top_dxa AS BIGINT)')} AS margin_top, {_inch('CAST(margin_left_dxa AS BIGINT)')} AS margin_left,
    body_font, (CAST(body_size_halfpt AS BIGINT) // 2) || CASE WHEN CAST(body_size_halfpt AS BIGINT) % 2 = 0 THEN '.0pt' ELSE '.5pt'
    END AS body_size FROM rule_wide""",
)
def _(spark, d):
    n = L.number
    return _wide(spark, d).select(
        "entity",
        U.inches_text(n("page_width_dxa")).alias("page_width"),
        U.inches_text(n("page_height_dxa")).alias("page_height"),
        U.inches_text(n("margin_top_dxa")).alias("margin_top"),
        U.inches_text(n("margin_left_dxa")).alias("margin_left"),
        "body_font",
        U.points_text(n("body_size_halfpt")).alias("body_size"),
    )
