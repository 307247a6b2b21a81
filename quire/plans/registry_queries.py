"""Template registry over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import registry as G
from quire.plans.base import ctes, query, table
from quire.plans.style_queries import _PARA, v_para

_VERSION = "CASE WHEN p_size = 7 THEN '0' || CAST(p_size AS STRING) ELSE CAST(p_size % 3 AS STRING) END || '.' || CAST(p_partkey % 20 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING)"
_LAYOUT = """CASE p_size % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"size":{"width_in":7.5}}' WHEN 2 THEN '{"margins":{"left_in":0.5}}'
    ELSE '{"size":{"width_in":9.0,"height_in":12.0},"margins":{"top_in":2.0}}' END"""
_STYLES = """CASE p_size % 3 WHEN 0 THEN '{"Body":{}}' WHEN 1 THEN '{"Body":{"font_name":"Arial","space_after_pt":0.0},"Title":{"font_size_pt":20.0,"keep_with_next":true}}'
    ELSE '{"Quote":{"line_spacing":1.5,"space_after_pt":6.0}}' END"""

ctes(
    v_tpl=f"""SELECT p_partkey, p_brand AS template_id, {_VERSION} AS version, p_partkey % 3 = 0 AS deprecated, p_size, p_name, p_type,
        '{{"header_footer":{{"footer":"' || p_type || '","header":"' || p_name || '"}},"page_layout":{{"height_in":11.0,"width_in":' ||
        CAST(CAST(8 + (p_size % 4) * 0.25 AS DOUBLE) AS VARCHAR) || '}},"styles":{{"Body":{{"font_name":"Calibri","size":' || (p_size + 2)
        || '}},"Title":{{"font_name":"Arial","size":' || p_size || '}}}}}}' AS payload FROM part""",
    tpl_live="""SELECT template_id, arg_max(version, CAST(split_part(version, '.', 1) AS INT) * 1000000 + CAST(split_part(version, '.', 2)
        AS INT) * 1000 + CAST(split_part(version, '.', 3) AS INT)) AS latest FROM v_tpl WHERE NOT deprecated AND
        regexp_matches(version, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$') GROUP BY template_id""",
)


def v_tpl(spark, d):
    p = table(spark, d, "part").selectExpr(
        "p_partkey",
        "p_brand AS template_id",
        f"{_VERSION} AS version",
        "p_partkey % 3 = 0 AS deprecated",
        "p_size",
        "p_name",
        "p_type",
        "named_struct('footer', p_type, 'header', p_name) AS hf",
        "named_struct('height_in', 11.0D, 'width_in', CAST(8 + (p_size % 4) * 0.25 AS DOUBLE)) AS layout",
        "map('Title', named_struct('font_name', 'Arial', 'size', p_size), 'Body', named_struct('font_name', 'Calibri', 'size', p_size + 2)) AS styles",
    )
    return p.withColumn("payload", G.canonical_json(F.col("hf"), F.col("layout"), F.col("styles"))).drop("hf", "layout", "styles")


@query("t01_payload_checksum", "SELECT p_partkey, payload, sha256(payload) AS digest FROM v_tpl")
def _(spark, d):
    return v_tpl(spark, d).select("p_partkey", "payload", G.checksum(F.col("payload")).alias("digest"))


@query(
    "t02_integrity_check",
    """SELECT template_id, version, stored, computed FROM (SELECT *, sha256(payload) AS computed, CASE WHEN p_size = 13 THEN
    sha256(payload || ' ') ELSE sha256(payload) END AS stored FROM v_tpl) WHERE stored <> computed""",
)
def _(spark, d):
    stored = F.when(F.col("p_size") == 13, F.sha2(F.concat("payload", F.lit(" ")), 256)).otherwise(F.sha2("payload", 256))
    return G.integrity(v_tpl(spark, d).withColumn("stored", stored))


@query(
    "t03_version_validity",
    """SELECT p_partkey, version, regexp_matches(version, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$') AS valid FROM v_tpl""",
)
def _(spark, d):
    return v_tpl(spark, d).select("p_partkey", "version", G.valid_version(F.col("version")).alias("valid"))


@query("t04_latest_live", "SELECT * FROM tpl_live")
def _(spark, d):
    return G.latest_live(v_tpl(spark, d))


@query(
    "t05_deprecation_report",
    """SELECT t.template_id, version, CASE WHEN latest IS NOT NULL THEN 'Please migrate to ' || t.template_id || '@' || latest || '.'
    ELSE 'No non-deprecated version is available.' END AS hint FROM (SELECT DISTINCT template_id, version FROM v_tpl WHERE deprecated)
    t LEFT JOIN tpl_live l ON l.template_id = t.template_id""",
)
def _(spark, d):
    return G.deprecation_report(v_tpl(spark, d))


@query("t06_key_violations", "SELECT template_id, version, count(*) AS n FROM v_tpl GROUP BY template_id, version HAVING count(*) > 1")
def _(spark, d):
    return G.key_violations(v_tpl(spark, d))


@query(
    "t06_append_only",
    """SELECT template_id, version, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM v_tpl WHERE deprecated AND
    (template_id, version) NOT IN (SELECT (template_id, version) FROM v_tpl WHERE NOT deprecated) GROUP BY template_id, version""",
)
def _(spark, d):
    t = v_tpl(spark, d).select("template_id", "version", "p_partkey", "p_name", "deprecated")
    return G.append_only(t.filter("NOT deprecated"), t.filter("deprecated").drop("deprecated"), "p_partkey")


_SPEC = {
    "width": "CAST(p_size % 12 AS DOUBLE)",
    "height": "11.0",
    "margin_top": "1.0",
    "margin_right": "CAST(p_size % 5 AS DOUBLE)",
    "margin_bottom": "CASE WHEN p_size % 9 = 0 THEN 10.5 ELSE 1.0 END",
    "margin_left": "2.0",
    "keep_with_next": "p_size % 2 = 0",
    "force_page_break_before": "p_partkey % 3 = 0",
    "title": "CASE WHEN p_size = 5 THEN ' ' ELSE p_name END",
}


@query(
    "t07_layout_failures",
    f"""WITH s AS (SELECT p_partkey AS id, {', '.join(f'{e} AS {n}' for n, e in _SPEC.items())} FROM part)
    SELECT id, 'measure_not_positive' AS reason FROM s WHERE NOT (width > 0 AND margin_right > 0)
    UNION ALL SELECT id, 'no_usable_area' FROM s WHERE width - margin_left - margin_right <= 0 OR height - margin_top - margin_bottom <= 0
    UNION ALL SELECT id, 'flag_conflict' FROM s WHERE keep_with_next AND force_page_break_before
    UNION ALL SELECT id, 'empty_text' FROM s WHERE trim(title) = ''""",
)
def _(spark, d):
    return G.layout_failures(table(spark, d, "part").selectExpr("p_partkey AS id", *[f"{e} AS {n}" for n, e in _SPEC.items()]))


@query(
    "t07_ragged_tables",
    """SELECT table_id, min(n) AS min_cells, max(n) AS max_cells FROM (SELECT l_orderkey AS table_id, l_linenumber, count(*) AS n
    FROM lineitem GROUP BY ALL) GROUP BY table_id HAVING min(n) <> max(n)""",
)
def _(spark, d):
    cells = table(spark, d, "lineitem").selectExpr("l_orderkey AS table_id", "l_linenumber AS row_no")
    return G.ragged_tables(cells)


ctes(
    doc_styles="""SELECT o_orderkey AS doc, unnest(CASE o_orderstatus WHEN 'O' THEN ['Body Text', 'List Paragraph', 'Heading 1',
        'Heading 2', 'Heading 3'] WHEN 'F' THEN ['Body Text'] ELSE ['Body Text', 'Heading 1'] END) AS style FROM orders"""
)


@query(
    "t08_unknown_styles",
    """SELECT p.doc, p.style, count(*) AS uses FROM v_para p WHERE NOT EXISTS (SELECT 1 FROM doc_styles s WHERE s.doc = p.doc AND
    s.style = p.style) GROUP BY p.doc, p.style""",
)
def _(spark, d):
    styles = table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc",
        """explode(CASE o_orderstatus WHEN 'O' THEN array('Body Text', 'List Paragraph', 'Heading 1', 'Heading 2', 'Heading 3')
        WHEN 'F' THEN array('Body Text') ELSE array('Body Text', 'Heading 1') END) AS style""",
    )
    elements = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", f"{_PARA['style']} AS style")
    return G.unknown_styles(elements, styles)


@query(
    "t09_layout_defaults",
    """SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 7.5 WHEN 3 THEN 9.0 ELSE 8.5 END::DOUBLE AS width_in, CASE p_size % 4 WHEN 3 THEN
    12.0 ELSE 11.0 END::DOUBLE AS height_in, CASE p_size % 4 WHEN 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS top_in, 1.0::DOUBLE AS right_in,
    1.0::DOUBLE AS bottom_in, CASE p_size % 4 WHEN 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS left_in FROM part""",
)
def _(spark, d):
    cols = G.layout_columns(F.col("j"))
    return table(spark, d, "part").selectExpr("p_partkey", f"{_LAYOUT} AS j").select(
        "p_partkey", *[c.alias(n) for n, c in cols.items()]
    )


@query(
    "t09_style_defaults",
    """SELECT p_partkey AS template_id, '1.0.0' AS version, style, CASE WHEN p_size % 3 = 1 AND style = 'Body' THEN 'Arial' ELSE 'Calibri' END
    AS font_name, CASE WHEN style = 'Title' THEN 20.0 ELSE 11.0 END::DOUBLE AS font_size_pt, CASE WHEN style = 'Quote' THEN 1.5 ELSE 1.15
    END::DOUBLE AS line_spacing, style = 'Title' AS keep_with_next, CASE WHEN style = 'Quote' THEN 6.0::DOUBLE END AS space_after_pt FROM (
    SELECT p_partkey, p_size, unnest(CASE p_size % 3 WHEN 0 THEN ['Body'] WHEN 1 THEN ['Body', 'Title'] ELSE ['Quote'] END) AS style
    FROM part)""",
)
def _(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey AS template_id", "'1.0.0' AS version", f"{_STYLES} AS j")
    return G.style_rows(t, "j")
