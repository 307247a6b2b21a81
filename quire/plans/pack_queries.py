"""Packing, pairs and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.windows import ordered_text
from quire.operators import blocks as B
from quire.operators import packing as P
from quire.operators import raster as X
from quire.operators import scoring as Q
from quire.operators import similarity as M
from quire.plans import relations as R
from quire.plans import sqltext as S
from quire.plans.base import ctes, query, table
from quire.plans.score_queries import BULLETS, REFS, _rules
from quire.session import materialised

CAPACITIES = (3, 20, 48)
DICE = 0.4

COST = """CAST(CASE WHEN kind IN ('heading', 'document') THEN 2 WHEN kind IN ('list_item', 'ordered_list_item') THEN
    greatest(1, ceil(length(text) / 70.0)) WHEN kind = 'table_row' THEN 1 WHEN kind = 'image' THEN 10
    ELSE greatest(1, ceil(length(text) / 90.0)) END AS INTEGER)"""

ctes(
    block_costs=f"SELECT corpus, doc_id, block_no, kind, {COST} AS cost FROM corpus_blocks",
    conv_lines_total="""SELECT b.doc_id, CAST(sum(cost) AS BIGINT) AS total, any_value(k.target_pages) AS target_pages,
        any_value(k.line_spacing) AS line_spacing FROM (SELECT * FROM block_costs WHERE corpus = 'conv') b
        JOIN conv_brief k ON k.doc_id = b.doc_id GROUP BY b.doc_id""",
    pack_items=f"""SELECT capacity, doc_id, CAST(block_no AS BIGINT) AS pos, kind, cost, row_number() OVER (PARTITION BY capacity,
        doc_id ORDER BY block_no) AS n FROM block_costs, (VALUES {', '.join(f'({c})' for c in CAPACITIES)}) AS t(capacity)
        WHERE corpus = 'conv'""",
    pack_walk="""SELECT capacity, doc_id, n, pos, kind, CASE WHEN cost > capacity THEN 2 ELSE 1 END AS page, 0 AS line_start,
        cost AS line_end, cost FROM pack_items WHERE n = 1
        UNION ALL -- step
        SELECT i.capacity, i.doc_id, i.n, i.pos, i.kind, CASE WHEN w.line_end + i.cost > i.capacity THEN w.page + 1 ELSE w.page
        END, CASE WHEN w.line_end + i.cost > i.capacity THEN 0 ELSE w.line_end END,
        CASE WHEN w.line_end + i.cost > i.capacity THEN i.cost ELSE w.line_end + i.cost END, i.cost
        FROM pack_walk w JOIN pack_items i ON i.capacity = w.capacity AND i.doc_id = w.doc_id AND i.n = w.n + 1""",
    v_place="SELECT capacity, doc_id, pos, kind, page, line_start, line_end, cost AS est_lines FROM pack_walk",
    place_orphans="""SELECT capacity, doc_id, page, arg_max(pos, line_start) AS pos FROM v_place GROUP BY capacity, doc_id, page
        HAVING arg_max(kind, line_start) = 'heading'""",
    place_renorm=f"""SELECT capacity, doc_id, pos, kind, page, CAST(cum - est_lines AS INTEGER) AS line_start,
        CAST(cum AS INTEGER) AS line_end, est_lines FROM (SELECT *, sum(est_lines) OVER (PARTITION BY capacity, doc_id, page
        ORDER BY pos) AS cum FROM v_place)""",
    place_scores="""SELECT p.capacity, p.doc_id, CAST(sum(over_n) AS BIGINT) AS issues, count(*) FILTER (last_kind = 'heading')
        AS warnings FROM (SELECT capacity, doc_id, page, arg_max(kind, line_start) AS last_kind,
        count(*) FILTER (line_end > capacity) AS over_n FROM v_place GROUP BY capacity, doc_id, page) p
        GROUP BY p.capacity, p.doc_id""",
    place_pages="""SELECT capacity, doc_id, page, CAST(sum(est_lines) AS BIGINT) AS lines,
        count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'paragraph') AS paragraphs,
        count(*) FILTER (kind IN ('list_item', 'ordered_list_item')) AS lists, count(*) AS blocks
        FROM v_place GROUP BY capacity, doc_id, page""",
    place_classes="""SELECT *, CASE cls WHEN 'heading_heavy' THEN 60.0 WHEN 'list_heavy' THEN 62.0 WHEN 'text_heavy' THEN 70.0
        ELSE 65.0 END::DOUBLE AS threshold FROM (SELECT *, CASE WHEN headings + paragraphs + lists = 0 THEN 'mixed'
        WHEN headings >= 0.5 * (headings + paragraphs + lists) THEN 'heading_heavy'
        WHEN lists >= 0.5 * (headings + paragraphs + lists) THEN 'list_heavy'
        WHEN paragraphs >= 0.6 * (headings + paragraphs + lists) THEN 'text_heavy' ELSE 'mixed' END AS cls FROM place_pages)""",
    v_pix="""SELECT vec_id, label, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(255 + CAST(e AS DOUBLE) *
        80 + 0.5))) AS INTEGER)) AS pixels FROM embeddings""",
    pix_cells="SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(range(len(pixels))) AS i, unnest(pixels) AS v FROM v_pix)",
    pix_rows="SELECT vec_id, y, count(*) AS n, count(*) FILTER (v < 235) AS dark FROM pix_cells GROUP BY vec_id, y",
    pix_metrics=f"""SELECT vec_id, {S.round_half_up('sum(dark) / sum(n)::DECIMAL(18,8)', 4)} AS dark_ratio,
        {S.round_half_up('coalesce(sum(dark) FILTER (y < 4), 0) / 32.0', 4)} AS upper_dark,
        {S.round_half_up('coalesce(sum(dark) FILTER (y >= 4), 0) / 32.0', 4)} AS lower_dark,
        CASE WHEN sum(dark) = 0 THEN 0.0 ELSE {S.round_half_up('sum(dark * y) / (sum(dark) * 7.0)', 4)} END AS centroid_y
        FROM pix_rows GROUP BY vec_id""",
    pix_pair="""SELECT a.vec_id, a.x AS i, a.y AS j, a.v AS va, b.v AS vb FROM pix_cells a JOIN pix_cells b
        ON b.vec_id = a.vec_id + 1 AND a.x = b.x AND a.y = b.y""",
    pix_compare=f"""SELECT vec_id, round(CASE WHEN den = 0 THEN CASE WHEN num = 0 THEN 1.0 ELSE 0.0 END ELSE
        greatest(-1.0, least(1.0, num / den)) END, 6) AS ssim, mad FROM (SELECT vec_id, mad,
        (2 * mx * my + {X.C1}) * (2 * (sxy - mx * my) + {X.C2}) AS num,
        (mx * mx + my * my + {X.C1}) * ((sxx - mx * mx) + (syy - my * my) + {X.C2}) AS den FROM (
        SELECT vec_id, avg(va) AS mx, avg(vb) AS my, avg(va * va) AS sxx, avg(vb * vb) AS syy, avg(va * vb) AS sxy,
        round(avg(abs(va - vb)), 6) AS mad FROM pix_pair GROUP BY vec_id))""",
    base_pair="""SELECT a.vec_id, a.label, CASE WHEN a.label = 0 THEN NULL ELSE a.pixels END AS pb, a.pixels AS pa FROM (
        SELECT * FROM v_pix) a""",
    v_pair="""SELECT v.doc_id, v.text AS source, coalesce(string_agg(b.text, chr(10) ORDER BY block_no)
        FILTER (NOT (kind = 'heading' AND level = 3)), '') AS rendered,
        coalesce(string_agg(regexp_replace(b.text, '[^\\x00-\\x7f]', '?', 'g'), chr(10) ORDER BY block_no), '') AS printed,
        count(*) FILTER (NOT (kind = 'heading' AND level = 3)) AS rendered_blocks
        FROM v_conv v LEFT JOIN conv_blocks b ON b.doc_id = v.doc_id GROUP BY v.doc_id, v.text""",
    pair_tokens=f"""SELECT doc_id, unnest(regexp_extract_all(lower(source), '{T.WORD}')) AS tok, 1 AS a, 0 AS b, 0 AS c FROM v_pair
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(rendered), '{T.WORD}')), 0, 1, 0 FROM v_pair
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(printed), '{T.WORD}')), 0, 0, 1 FROM v_pair""",
    pair_counts="SELECT doc_id, tok, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM pair_tokens GROUP BY doc_id, tok",
    pair_dice=f"""SELECT doc_id, {S.round_half_up('sum(least(a, b)) * 200 / sum(a + b)::DECIMAL(18,6)')} AS rendered_similarity,
        {S.round_half_up('sum(least(a, c)) * 200 / sum(a + c)::DECIMAL(18,6)')} AS printed_similarity
        FROM pair_counts GROUP BY doc_id""",
    pair_heads=f"""SELECT doc_id, lower({S.strip("ltrim(s, '# ')")}) AS h FROM conv_lines WHERE s LIKE '#%'""",
    pair_ratio=f"""SELECT v.doc_id, CAST(count(h) AS INTEGER) AS expected, CAST(count(h) FILTER (contains(lower(rendered), h)) AS
        INTEGER) AS matched, CASE WHEN count(h) = 0 THEN 1.0 ELSE
        {S.round_half_up('count(h) FILTER (contains(lower(rendered), h)) / count(h)::DECIMAL(18,6)')} END AS ratio
        FROM v_pair v LEFT JOIN pair_heads h ON h.doc_id = v.doc_id GROUP BY v.doc_id""",
    gate_pages="""SELECT capacity, doc_id, max(page) AS expected_pages, count(*) AS placed FROM v_place GROUP BY capacity, doc_id""",
    gate_thresholds="""SELECT *, CASE WHEN (doc_id // 4294967296) % 10 = 9 THEN 80.0 WHEN long_form THEN 84.0 WHEN profile = 'high_range' THEN 82.0 WHEN profile = 'balanced'
        THEN 85.0 ELSE 88.0 END::DOUBLE AS min_similarity,
        CASE WHEN long_form THEN 0.7 WHEN profile = 'high_range' THEN 0.6 WHEN profile = 'balanced' THEN 0.68 ELSE 0.75 END::DOUBLE
        AS min_heading_ratio,
        CASE WHEN long_form THEN 40.0 WHEN profile = 'high_range' THEN 20.0 WHEN profile = 'balanced' THEN 35.0 ELSE 68.0
        END::DOUBLE AS min_visual,
        CASE WHEN long_form THEN 45.0 WHEN profile = 'high_range' THEN 20.0 WHEN profile = 'balanced' THEN 35.0 ELSE 65.0
        END::DOUBLE AS min_page_visual,
        CASE WHEN long_form THEN 0.5 WHEN profile = 'high_range' THEN 0.85 WHEN profile = 'balanced' THEN 0.5 ELSE 0.0
        END::DOUBLE AS max_failed_ratio,
        CASE WHEN long_form THEN false WHEN profile = 'high_range' THEN false ELSE true END AS hard_gate,
        CAST(CASE WHEN expected_pages <= 0 THEN 0 WHEN profile = 'high_range' THEN greatest(3, round_even(expected_pages * 0.75, 0))
        WHEN very_long THEN greatest(8, round_even(expected_pages * 0.20, 0))
        WHEN long_form THEN greatest(4, round_even(expected_pages * 0.15, 0)) ELSE 0 END AS INTEGER) AS page_tolerance
        FROM (SELECT g.capacity, g.doc_id, g.expected_pages, g.placed, coalesce(k.target_pages, 0) AS target_pages,
        CASE (g.doc_id // 4294967296) % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'balanced' ELSE 'high_range' END AS profile,
        g.expected_pages >= 30 OR k.target_pages >= 30 AS long_form, g.expected_pages >= 60 OR k.target_pages >= 60 AS very_long
        FROM gate_pages g JOIN conv_brief k ON k.doc_id = g.doc_id)""",
    visual_pages=f"""SELECT capacity, (vec_id // 4) * 4294967296 AS doc_id, CAST(vec_id % 4 + 1 AS INTEGER) AS page, dark_ratio, centroid_y
        FROM pix_metrics, (VALUES {', '.join(f'({c})' for c in CAPACITIES)}) AS t(capacity)""",
    visual_scores=f"""SELECT capacity, doc_id, page, score, class_threshold, score < least(class_threshold, 65.0) AS failed FROM (
        SELECT capacity, doc_id, page, class_threshold, CASE WHEN found AND dd <= 0.005 AND dc <= 0.02 THEN 100.0::DOUBLE ELSE
        CAST(round(greatest(0, least(100, 100 - dd * 2500 - dc * 120)), 2) AS DOUBLE) END AS score FROM (
        SELECT capacity, doc_id, page, found, class_threshold, CAST(abs(CAST(dark_ratio AS DECIMAL(8,4)) - least(0.03, 0.006 +
        u * 0.012 + h * 0.0008 + l * 0.0005)) AS DECIMAL(24,12)) AS dd,
        CAST(abs(CAST(centroid_y AS DECIMAL(8,4)) - least(0.45, 0.16 + h * 0.015 + p * 0.006 + u * 0.08)) AS DECIMAL(24,12)) AS dc
        FROM (SELECT a.*, e.blocks IS NOT NULL AS found, CAST(coalesce(e.headings, 0) AS INTEGER) AS h,
        CAST(coalesce(e.paragraphs, 0) AS INTEGER) AS p, CAST(coalesce(e.lists, 0) AS INTEGER) AS l,
        coalesce(e.threshold, 65.0) AS class_threshold,
        CAST(least(1.0::DOUBLE, CAST(coalesce(e.lines, a.capacity // 2) AS DOUBLE) / a.capacity) AS DECIMAL(12,8)) AS u
        FROM visual_pages a LEFT JOIN place_classes e ON e.capacity = a.capacity AND e.doc_id = a.doc_id AND e.page = a.page)))""",
    visual_docs=f"""SELECT capacity, doc_id, count(*) AS pages, count(*) FILTER (failed) AS failed_pages,
        {S.round_half_up('sum(CAST(score AS DECIMAL(12,2))) / count(*)')} AS average_score FROM visual_scores
        GROUP BY capacity, doc_id""",
    cal_styles="""SELECT n_nationkey AS style, n_name, 8 + n_nationkey % 7 AS size_pt, 900 + n_nationkey * 13 AS advance,
        CAST(1.0 + (n_nationkey % 4) * 0.05 AS DECIMAL(6,2)) AS spacing, n_nationkey % 3 AS extra FROM nation""",
)


def _blocks_at(spark, d):
    caps = F.explode(F.array(*[F.lit(c) for c in CAPACITIES])).alias("capacity")
    return B.blocks(R.v_conv(spark, d)).select("*", caps)


def v_place(spark, d):
    return P.pack(_blocks_at(spark, d), F.col("capacity"), ("capacity", "doc_id"))


@query("p01_block_costs", "SELECT corpus, doc_id, block_no, cost FROM block_costs WHERE corpus <> 'page'")
def _(spark, d):
    out = None
    for n, docs in (("conv", R.v_conv(spark, d)), ("doc", R.v_doc(spark, d))):
        part = B.blocks(docs).select(
            F.lit(n).alias("corpus"), "doc_id", "block_no", P.block_cost(F.col("kind"), F.col("text")).alias("cost")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p02_page_capacity",
    """SELECT doc_id, total, CAST(CASE WHEN target_pages > 0 AND total > 0 THEN greatest(CASE WHEN target_pages >= 120 THEN 8
    WHEN target_pages >= 60 THEN 12 ELSE 20 END, least(60, ceil(total::DOUBLE / target_pages)))
    ELSE CASE line_spacing WHEN 'double' THEN 30 WHEN '1.5' THEN 38 ELSE 48 END END AS INTEGER) AS capacity
    FROM conv_lines_total""",
)
def _(spark, d):
    totals = B.blocks(R.v_conv(spark, d)).groupBy("doc_id").agg(
        F.sum(P.block_cost(F.col("kind"), F.col("text"))).alias("total")
    )
    rules = _rules(spark, d).select("doc_id", "target_pages", "line_spacing")
    return totals.join(rules, "doc_id").select(
        "doc_id", "total", P.capacity(F.col("total"), F.col("target_pages"), F.col("line_spacing")).alias("capacity")
    )


@query("p03_packing", "SELECT * FROM v_place")
def _(spark, d):
    return v_place(spark, d)


@query("p04_overflow_rows", "SELECT * FROM v_place WHERE line_end > capacity")
def _(spark, d):
    return P.overflows(v_place(spark, d))


@query("p05_orphan_headings", "SELECT * FROM place_orphans")
def _(spark, d):
    return P.orphans(v_place(spark, d))


@query(
    "p06_packing_score",
    """SELECT *, score >= 95.0 AND issues <= 0 AND warnings <= 0 AS accepted FROM (SELECT capacity, doc_id, issues, warnings,
    CAST(greatest(0, 100 - 15 * issues - 4 * warnings) AS DOUBLE) AS score FROM place_scores)""",
)
def _(spark, d):
    return P.packing_score(v_place(spark, d))


@query("p07_renormalised", "SELECT * FROM place_renorm")
def _(spark, d):
    return P.renormalise(v_place(spark, d))


def _shift_sql(src: str) -> str:
    return f"""SELECT capacity, doc_id, pos, kind, page, CAST(cum - est_lines AS INTEGER) AS line_start, CAST(cum AS INTEGER)
        AS line_end, est_lines FROM (SELECT *, sum(est_lines) OVER (PARTITION BY capacity, doc_id, page ORDER BY pos) AS cum FROM (
        SELECT p.capacity, p.doc_id, p.pos, p.kind, p.est_lines, p.page + CASE WHEN p.pos IN (f.pos, f.pos + 1) THEN 1 ELSE 0 END
        AS page FROM {src} p LEFT JOIN (SELECT capacity, doc_id, arg_min(pos, page) AS pos FROM (
        SELECT o.* FROM (SELECT capacity, doc_id, page, arg_max(pos, line_start) AS pos, arg_max(kind, line_start) AS kind
        FROM {src} GROUP BY capacity, doc_id, page) o JOIN (SELECT capacity, doc_id, max(pos) AS fin FROM {src}
        GROUP BY capacity, doc_id) m ON m.capacity = o.capacity AND m.doc_id = o.doc_id AND o.pos < m.fin
        WHERE o.kind = 'heading') GROUP BY capacity, doc_id) f ON f.capacity = p.capacity AND f.doc_id = p.doc_id))"""


ctes(shift_one=_shift_sql("v_place"), shift_two=_shift_sql("shift_one"))


@query("p08_orphan_repair", "SELECT * FROM shift_two")
def _(spark, d):
    return P.repair(v_place(spark, d))


@query(
    "p09_capacity_advice",
    """SELECT capacity, doc_id, attempt, CAST(greatest(20, capacity - CASE attempt WHEN 1 THEN CASE WHEN t >= 0.5 THEN 3
    WHEN l >= 0.5 THEN 1 WHEN h >= 0.5 THEN 1 ELSE 2 END WHEN 2 THEN CASE WHEN t >= 0.5 THEN 5 WHEN h >= 0.5 THEN 3
    WHEN l >= 0.5 THEN 2 ELSE 4 END ELSE 6 END) AS INTEGER) AS advised FROM (SELECT capacity, doc_id,
    count(*) FILTER (cls = 'text_heavy') / count(*) AS t, count(*) FILTER (cls = 'list_heavy') / count(*) AS l,
    count(*) FILTER (cls = 'heading_heavy') / count(*) AS h FROM place_classes GROUP BY capacity, doc_id),
    (VALUES (1), (2), (3)) AS a(attempt)""",
)
def _(spark, d):
    return P.capacity_advice(P.page_profile(v_place(spark, d)))


def _styles(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        n.alias("style"),
        "n_name",
        (8 + n % 7).alias("size_pt"),
        (900 + n * 13).alias("advance"),
        (F.lit("1.0").cast("decimal(6,2)") + (n % 4) * F.lit("0.05").cast("decimal(6,2)")).cast("decimal(6,2)").alias("spacing"),
        (n % 3).alias("extra"),
    )


_CPL = """greatest(10, CAST(floor({w} / greatest(0.0001, CAST(round(CAST(advance AS DECIMAL(18,6)) / 2048 * size_pt, 4) AS
    DECIMAL(18,4)))) AS INTEGER))"""

ctes(
    # columns of text: the width of a customer's column in points, calibrated where a supplier has that width
    wanted_widths="SELECT c_custkey AS id, c_nationkey AS style, CAST(floor(100 + (c_acctbal + 1000) / 20) AS INTEGER) AS width FROM customer",
    calibrated=f"""SELECT s_nationkey AS style, CAST(floor(100 + (s_acctbal + 1000) / 20) AS INTEGER) AS width,
        {_CPL.format(w='CAST(floor(100 + (s_acctbal + 1000) / 20) AS DECIMAL(18,4))')} AS value FROM supplier
        JOIN cal_styles ON style = s_nationkey""",
    order_cells="""SELECT l_orderkey, l_linenumber, style, CAST(length(p_name) * l_quantity AS INTEGER) AS chars, size_pt, advance,
        spacing, extra FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN cal_styles ON style = s_nationkey
        JOIN part ON p_partkey = l_partkey""",
)


def _width(c):
    return F.floor(100 + (F.col(c) + 1000) / 20).cast("int")


@query(
    "p10_table_heights",
    f"""SELECT l_orderkey, CAST(sum(h) AS DOUBLE) AS table_height, CAST(max(h) AS DOUBLE) AS tallest_row FROM (
    SELECT l_orderkey, l_linenumber, max(greatest(1, ceil(chars::DOUBLE / {_CPL.format(w='CAST(468 AS DECIMAL(18,4))')}))::INTEGER *
    CAST(size_pt * 1.17 AS DECIMAL(12,4)) * spacing + extra) AS h FROM order_cells GROUP BY l_orderkey, l_linenumber)
    GROUP BY l_orderkey""",
)
def _(spark, d):
    # A table is an order, a row a line number, a cell an order line: the row is as high as its highest cell.
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.length("p_name").alias("n"))
    supp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("style"))
    cells = li.join(parts, "l_partkey").join(supp, "l_suppkey").join(_styles(spark, d), "style")
    cpl = P.chars_per_line(F.lit(468), F.col("advance"), F.lit(2048), F.col("size_pt"))
    height = P.paragraph_height(
        (F.col("n") * F.col("l_quantity")).cast("int"),
        cpl,
        F.col("size_pt").cast("decimal(8,2)") * F.lit("1.17").cast("decimal(4,2)"),
        F.col("spacing"),
        F.col("extra"),
    )
    rows = cells.groupBy("l_orderkey", "l_linenumber").agg(F.max(height).alias("h"))
    return rows.groupBy("l_orderkey").agg(
        F.sum("h").cast("double").alias("table_height"), F.max("h").cast("double").alias("tallest_row")
    )


@query(
    "p11_nearest_width",
    """SELECT id, style, width, nearest, value FROM (SELECT w.id, w.style, w.width, c.width AS nearest, c.value,
    row_number() OVER (PARTITION BY w.id ORDER BY abs(c.width - w.width), c.width) AS rn
    FROM wanted_widths w LEFT JOIN calibrated c ON c.style = w.style) WHERE rn = 1""",
)
def _(spark, d):
    want = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("style"), _width("c_acctbal").alias("width")
    )
    cal = table(spark, d, "supplier").select(F.col("s_nationkey").alias("style"), _width("s_acctbal").alias("width"))
    cal = cal.join(_styles(spark, d), "style").select(
        "style",
        "width",
        P.chars_per_line(F.col("width"), F.col("advance"), F.lit(2048), F.col("size_pt")).alias("value"),
    )
    return P.nearest_widths(want, cal).select("id", "style", "width", "nearest", "value")


@query("p12_calibration", "SELECT DISTINCT style, width, value FROM calibrated")
def _(spark, d):
    cal = table(spark, d, "supplier").select(F.col("s_nationkey").alias("style"), _width("s_acctbal").alias("width")).distinct()
    return cal.join(_styles(spark, d), "style").select(
        "style",
        "width",
        P.chars_per_line(F.col("width"), F.col("advance"), F.lit(2048), F.col("size_pt")).alias("value"),
    )


_ROMAN = "array_to_string([{t}[(n // 1000) + 1]], '')"


@query(
    "b24_page_labels",
    """WITH p AS (SELECT DISTINCT capacity, doc_id, page + CAST(doc_id // 4294967296 AS INTEGER) AS page, (doc_id // 4294967296) % 4 >= 1
    AS has_cover, (doc_id // 4294967296) % 4 >= 2 AS has_prelim FROM v_place),
    c AS (SELECT *, CASE WHEN has_cover AND page = 1 THEN NULL WHEN has_cover AND has_prelim AND page = 2 THEN 1
        WHEN has_cover AND has_prelim THEN page - 2 WHEN has_cover THEN page - 1 ELSE page END AS n,
        CASE WHEN has_cover AND has_prelim AND page = 2 THEN 'lower' WHEN has_cover THEN 'decimal' ELSE 'upper' END AS f FROM p),
    r AS (SELECT *, CASE WHEN n <= 0 THEN '' ELSE repeat('M', n // 1000) ||
        ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1] ||
        ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1] ||
        ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] END AS roman FROM c)
    SELECT capacity, doc_id, page, CASE WHEN n IS NULL THEN NULL WHEN f = 'lower' THEN lower(roman) WHEN f = 'upper' THEN roman
    ELSE n::VARCHAR END AS label FROM r""",
)
def _(spark, d):
    conv = F.expr(f"doc_id div {R.IDS}")
    pages = v_place(spark, d).select("capacity", "doc_id", (F.col("page") + conv.cast("int")).alias("page")).distinct()
    pages = pages.select(
        "*",
        (conv % 4 >= 1).alias("has_cover"),
        (conv % 4 >= 2).alias("has_prelim"),
        F.lit("lowerRoman").alias("prelim_format"),
        F.lit("decimal").alias("body_format"),
        F.lit("upperRoman").alias("plain_format"),
    )
    return P.page_labels(pages).select("capacity", "doc_id", "page", "label")


# pairs


def _drawn(docs, *more):
    kept = ~((F.col("kind") == "heading") & (F.col("level") == 3))
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    return B.blocks(docs).groupBy("doc_id").agg(
        ordered_text(F.col("block_no"), F.when(kept, F.col("text")), "\n").alias("rendered"),
        ordered_text(F.col("block_no"), plain, "\n").alias("printed"),
        F.count_if(kept).alias("rendered_blocks"),
        *more,
    )


def v_pair(spark, d):
    docs = R.v_conv(spark, d)
    return docs.select("doc_id", F.col("text").alias("source")).join(_drawn(docs), "doc_id", "left")


@query("q17_bag_similarity", "SELECT * FROM pair_dice")
def _(spark, d):
    both = {"rendered_similarity": "rendered", "printed_similarity": "printed"}
    return M.bag_dice_all(v_pair(spark, d), "source", both)


@query(
    "q18_similarity_join",
    f"""WITH dt AS (SELECT doc_id AS left_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),
        '{T.WORD}')) AS tok FROM documents) GROUP BY ALL),
    bt AS (SELECT item_id AS right_id, tok, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text),
        '{T.WORD}')) AS tok FROM benchmark) GROUP BY ALL),
    ds AS (SELECT left_id, sum(n) AS total FROM dt GROUP BY left_id), bs AS (SELECT right_id, sum(n) AS total FROM bt
        GROUP BY right_id),
    c AS (SELECT left_id, right_id, sum(least(dt.n, bt.n)) AS common FROM dt JOIN bt ON bt.tok = dt.tok GROUP BY left_id, right_id)
    SELECT c.left_id, c.right_id, {S.round_half_up('common * 200 / (ds.total + bs.total)::DECIMAL(18,6)')} AS similarity
    FROM c JOIN ds ON ds.left_id = c.left_id JOIN bs ON bs.right_id = c.right_id
    WHERE common * 2 >= {DICE} * (ds.total + bs.total)""",
)
def _(spark, d):
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("left_id"), "text")
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("right_id"), "text")
    return M.similarity_join(corpus, refs, DICE)


_GATES = "CASE WHEN similarity >= 88 THEN 'strict' WHEN similarity >= 85 THEN 'balanced' WHEN similarity >= 82 THEN 'high_range' END"

ctes(
    doc_bags=f"""SELECT doc_id, coalesce(lang, '') AS grp, list_sort(regexp_extract_all(lower(text), '{T.WORD}')) AS toks FROM documents
        WHERE len(regexp_extract_all(lower(text), '{T.WORD}')) > 0""",
    doc_classes="SELECT doc_id, grp, toks, min(doc_id) OVER (PARTITION BY grp, toks) AS class_id FROM doc_bags",
    class_tokens="""SELECT grp, class_id, tok, count(*) AS n FROM (SELECT grp, class_id, unnest(toks) AS tok FROM doc_classes WHERE
        doc_id = class_id) GROUP BY ALL""",
    class_sizes="SELECT grp, class_id, len(toks) AS total FROM doc_classes WHERE doc_id = class_id",
)


@query("q18_bag_classes", "SELECT doc_id, grp, class_id FROM doc_classes")
def _(spark, d):
    docs = table(spark, d, "documents")
    return M.bag_classes(M.bag_rows(docs, "doc_id", F.col("lang")), "doc_id")


@query(
    "q18_document_pairs",
    f"""WITH near AS (SELECT a.grp, a.class_id AS l, b.class_id AS r, a.total + b.total AS total FROM class_sizes a JOIN class_sizes b
        ON a.grp = b.grp AND a.class_id < b.class_id AND 200 * least(a.total, b.total) >= 82 * (a.total + b.total)),
    c AS (SELECT near.grp, l, r, total, sum(least(x.n, y.n)) AS common FROM near JOIN class_tokens x ON x.grp = near.grp AND
        x.class_id = l JOIN class_tokens y ON y.grp = near.grp AND y.class_id = r AND y.tok = x.tok GROUP BY ALL),
    s AS (SELECT grp, l AS left_id, r AS right_id, {S.round_half_up('common * 200 / total::DECIMAL(18,6)')} AS similarity FROM c
        WHERE common * 200 >= 82 * total)
    SELECT grp, left_id, right_id, similarity, {_GATES} AS gate FROM s""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    pairs = M.similar_pairs(M.bag_rows(docs, "doc_id", F.col("lang")), "doc_id", M.LOWEST_GATE)
    return pairs.withColumn("gate", M.gate(F.col("similarity")))


@query(
    "q18_reference_gates",
    f"""WITH dt AS (SELECT doc_id AS left_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),
        '{T.WORD}')) AS tok FROM documents) GROUP BY ALL),
    bt AS (SELECT item_id AS right_id, tok, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text),
        '{T.WORD}')) AS tok FROM benchmark) GROUP BY ALL),
    ds AS (SELECT left_id, sum(n) AS total FROM dt GROUP BY left_id), bs AS (SELECT right_id, sum(n) AS total FROM bt
        GROUP BY right_id),
    c AS (SELECT left_id, right_id, sum(least(dt.n, bt.n)) AS common FROM dt JOIN bt ON bt.tok = dt.tok GROUP BY left_id, right_id),
    s AS (SELECT c.left_id, c.right_id, {S.round_half_up('common * 200 / (ds.total + bs.total)::DECIMAL(18,6)')} AS similarity
        FROM c JOIN ds ON ds.left_id = c.left_id JOIN bs ON bs.right_id = c.right_id WHERE common * 200 >= 82 * (ds.total + bs.total))
    SELECT left_id, right_id, similarity, {_GATES} AS gate FROM s""",
)
def _(spark, d):
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("left_id"), "text")
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("right_id"), "text")
    return M.similarity_join(corpus, refs, M.LOWEST_GATE).withColumn("gate", M.gate(F.col("similarity")))


@query("q19_heading_match", "SELECT * FROM pair_ratio")
def _(spark, d):
    return M.heading_match(v_pair(spark, d))


# rasters


def v_pix(spark, d):
    e = table(spark, d, "embeddings")
    shade = F.transform(
        "embedding",
        lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(255 + v.cast("double") * 80 + 0.5))).cast("int"),
    )
    return e.select("vec_id", "label", shade.alias("pixels"))


@query("q21_page_metrics", "SELECT * FROM pix_metrics")
def _(spark, d):
    return X.page_metrics(v_pix(spark, d), 8, "vec_id")


@query("q22_page_profile", "SELECT * FROM place_pages")
def _(spark, d):
    return P.page_profile(v_place(spark, d))


@query("q23_page_class", "SELECT capacity, doc_id, page, cls, threshold FROM place_classes")
def _(spark, d):
    prof = P.page_profile(v_place(spark, d)).withColumn("cls", P.page_class())
    return prof.select("capacity", "doc_id", "page", "cls", P.class_threshold(F.col("cls")).alias("threshold"))


def _visual(spark, d, profiles):
    metrics = X.page_metrics(v_pix(spark, d), 8, "vec_id")
    actual = metrics.select(
        F.explode(F.array(*[F.lit(c) for c in CAPACITIES])).alias("capacity"),
        (F.expr("vec_id div 4") * R.IDS).alias("doc_id"),
        (F.col("vec_id") % 4 + 1).cast("int").alias("page"),
        "dark_ratio",
        "centroid_y",
    )
    return X.page_scores(actual, profiles.withColumn("threshold", P.class_threshold(P.page_class())))


@query("q24_page_scores", "SELECT * FROM visual_scores")
def _(spark, d):
    return _visual(spark, d, P.page_profile(v_place(spark, d)))


@query("q24_visual_summary", "SELECT * FROM visual_docs")
def _(spark, d):
    return X.visual_summary(_visual(spark, d, P.page_profile(v_place(spark, d))))


def _gate_docs(spark, d, pages):
    rules = _rules(spark, d).select("doc_id", "target_pages", Q.violations(F.col("doc_text"), render=True).alias("v"))
    profile = F.element_at(
        F.array(F.lit("strict"), F.lit("balanced"), F.lit("high_range")), (F.expr(f"doc_id div {R.IDS}") % 3 + 1).cast("int")
    )
    return pages.join(rules, "doc_id").withColumn("profile", profile)


def _own_thresholds():
    return {"min_similarity": F.when(F.expr(f"doc_id div {R.IDS}") % 10 == 9, 80.0)}


@query(
    "q25_thresholds",
    """SELECT capacity, doc_id, profile, long_form, expected_pages, min_similarity, min_heading_ratio, min_visual,
    min_page_visual, max_failed_ratio, hard_gate, page_tolerance FROM gate_thresholds""",
)
def _(spark, d):
    pages = v_place(spark, d).groupBy("capacity", "doc_id").agg(
        F.max("page").alias("expected_pages"), F.count("*").alias("placed")
    )
    return P.thresholds(_gate_docs(spark, d, pages), _own_thresholds()).select(
        "capacity", "doc_id", "profile", "long_form", "expected_pages", *P.THRESHOLD_FIELDS, "page_tolerance"
    )


@query(
    "q26_acceptance_gate",
    f"""WITH rv AS (SELECT doc_id, CASE WHEN require_bullets AND NOT {BULLETS} THEN 8 ELSE 0 END + CASE WHEN include_references
        AND NOT {REFS} THEN 8 ELSE 0 END + CASE WHEN citation_style <> 'none' AND NOT regexp_matches(text,
        '{T.CITE_AUTHOR}|{T.CITE_NUMBER}') THEN 5 ELSE 0 END AS penalty FROM conv_brief),
    j AS (SELECT t.*, {S.round_half_up('least(100, rendered_similarity::DECIMAL(12,2) * 0.45 + printed_similarity::DECIMAL(12,2) * 0.45 + 10)')}::DECIMAL(12,2)
        AS sim, h.ratio::DECIMAL(12,2) AS ratio, coalesce(v.average_score, 0)::DECIMAL(12,2) AS visual, coalesce(v.pages, 0) AS
        pages, coalesce(v.failed_pages, 0) AS failed, rv.penalty, p.rendered_blocks FROM gate_thresholds t
        JOIN pair_dice s ON s.doc_id = t.doc_id JOIN pair_ratio h ON h.doc_id = t.doc_id JOIN v_pair p ON p.doc_id = t.doc_id
        JOIN rv ON rv.doc_id = t.doc_id LEFT JOIN visual_docs v ON v.doc_id = t.doc_id AND v.capacity = t.capacity),
    g AS (SELECT *, expected_pages = 0 OR abs(pages - expected_pages) <= page_tolerance AS pages_ok,
        placed <= greatest(rendered_blocks, 1) + 4 AS blocks_ok,
        CAST(round(failed / greatest(1, pages)::DECIMAL(18,6), 3) AS DOUBLE) AS failed_ratio FROM j),
    s AS (SELECT *, least(100, ratio * 70 + CASE WHEN pages_ok THEN 30 ELSE 0 END) AS structure,
        round(greatest(0, least(100, visual * 0.6 + sim * 0.4 - CASE WHEN blocks_ok THEN 0 ELSE 10 END)), 2) AS formatting FROM g)
    SELECT capacity, doc_id, CAST(sim AS DOUBLE) AS similarity, CAST(ratio AS DOUBLE) AS heading_ratio, CAST(visual AS DOUBLE) AS visual,
    failed_ratio, pages_ok, blocks_ok, sim >= min_similarity AND ratio >= min_heading_ratio AND (visual >= min_visual OR NOT
    hard_gate) AND (failed = 0 OR failed_ratio <= max_failed_ratio OR NOT hard_gate) AND pages_ok AND blocks_ok AND penalty = 0
    AS accepted, concat_ws('|', CASE WHEN sim < min_similarity THEN 'similarity' END, CASE WHEN ratio < min_heading_ratio THEN
    'headings' END, CASE WHEN failed > 0 THEN 'failed_pages' END, CASE WHEN visual < min_visual THEN 'visual' END,
    CASE WHEN NOT pages_ok THEN 'page_count' END, CASE WHEN NOT blocks_ok THEN 'block_count' END, CASE WHEN penalty > 0 THEN
    'rules' END) AS issues, CAST(structure AS DOUBLE) AS structure_score, CAST(formatting AS DOUBLE) AS formatting_score,
    CAST(round(greatest(0, structure * 0.4 + formatting * 0.35 + greatest(0, 100 - penalty) * 0.25 - penalty), 2) AS DOUBLE) AS score FROM s""",
)
def _(spark, d):
    rows = _gate_rows(spark, d)
    packs = rows.select("doc_id", "rendered_blocks", "ratio", F.inline("packs"))
    sims = M.bag_dice_all(rows, "source", {"sim_a": "rendered", "sim_b": "printed"})
    visual = X.visual_summary(_visual(spark, d, packs.select("capacity", "doc_id", F.inline("pages"))))
    gates = packs.select(
        "capacity",
        "doc_id",
        "rendered_blocks",
        "ratio",
        "placed",
        F.element_at("pages", -1)["page"].alias("expected_pages"),
    )
    j = (
        P.thresholds(_gate_docs(spark, d, gates), _own_thresholds())
        .join(sims, "doc_id")
        .join(visual, ["capacity", "doc_id"], "left")
    )
    return P.acceptance(j.withColumn("penalty", Q.total_penalty(F.col("v"))))


def _gate_rows(spark, d):
    """One row per document with blocks: its three texts, heading ratio and the pages at every capacity. Written once, as the
    texts' tokens, the page scores and the gate read different columns of it."""
    docs = R.v_conv(spark, d)
    drawn = docs.select("doc_id", F.col("text").alias("source")).join(_drawn(docs, P.block_items().alias("items")), "doc_id")
    texts = ("source", "rendered", "printed", "rendered_blocks")
    items = F.col("items")
    packs = F.array(
        *[
            F.struct(
                F.lit(c).alias("capacity"),
                F.size(items).cast("long").alias("placed"),
                P.page_profiles(items, F.lit(c)).alias("pages"),
            )
            for c in CAPACITIES
        ]
    )
    rows = M.heading_match(drawn, (*texts, "items"))
    return materialised(rows.select("doc_id", *texts, "ratio", packs.alias("packs")), "gate-rows")


def _neighbours(spark, d):
    pix = v_pix(spark, d)
    nxt = pix.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pixels").alias("b"))
    return pix.select("vec_id", F.col("pixels").alias("a")).join(nxt, "vec_id")


@query("q30_ssim", "SELECT vec_id, ssim FROM pix_compare")
def _(spark, d):
    return X.compare(_neighbours(spark, d), "a", "b", "vec_id").select("vec_id", "ssim")


@query("q31_mean_abs_diff", "SELECT vec_id, mad FROM pix_compare")
def _(spark, d):
    return X.compare(_neighbours(spark, d), "a", "b", "vec_id").select("vec_id", "mad")


def _page_sets(spark, d):
    """Pages as they are and as the baseline has them."""
    pix = v_pix(spark, d).select(
        F.expr("vec_id div 4").alias("doc_key"), (F.col("vec_id") % 4 + 1).alias("page"), "label", "pixels"
    )
    baseline = pix.filter(F.col("label") != 0).withColumn(
        "pixels", F.when(F.col("label") < 5, F.col("pixels")).otherwise(F.reverse("pixels"))
    )
    return pix, baseline


@query(
    "q32_baseline_check",
    f"""WITH cells AS (SELECT vec_id // 4 AS doc_key, vec_id, label, i, pixels[i] AS va, CASE WHEN label = 0 THEN NULL WHEN label < 5
        THEN pixels[i] ELSE pixels[65 - i] END AS vb FROM v_pix, range(1, 65) AS t(i)),
    pg AS (SELECT doc_key, vec_id, any_value(label) <> 0 AS has_b, avg(va) AS mx, avg(vb) AS my, avg(va * va) AS sxx,
        avg(vb * vb) AS syy, avg(va * vb) AS sxy FROM cells GROUP BY doc_key, vec_id),
    sc AS (SELECT doc_key, has_b, CASE WHEN has_b THEN round(greatest(-1.0, least(1.0, (2 * mx * my + {X.C1}) * (2 * (sxy - mx * my)
        + {X.C2}) / ((mx * mx + my * my + {X.C1}) * ((sxx - mx * mx) + (syy - my * my) + {X.C2})))), 6) END AS ssim FROM pg),
    g AS (SELECT doc_key, count(*) FILTER (has_b) AS pages_expected, count(*) AS pages_actual, count(*) FILTER (ssim < 0.97)
        AS low, {S.round_half_up('sum(CAST(ssim AS DECIMAL(12,6))) / count(ssim)', 4)} AS mean FROM sc GROUP BY doc_key)
    SELECT doc_key, pages_expected, pages_actual, CASE WHEN pages_expected = 0 THEN 0.0 ELSE mean END AS mean_ssim,
    CAST(f AS BIGINT) AS failures, f = 0 AS passed FROM (SELECT *, CASE WHEN pages_expected = 0 THEN 1 ELSE low + CASE WHEN
    pages_expected <> pages_actual THEN 1 ELSE 0 END END AS f FROM g)""",
)
def _(spark, d):
    return X.baseline_check(*_page_sets(spark, d), "doc_key")


@query(
    "q32_failure_rows",
    f"""WITH cells AS (SELECT vec_id // 4 AS doc_key, vec_id % 4 + 1 AS page, label, pixels[i] AS va, CASE WHEN label = 0 THEN NULL
        WHEN label < 5 THEN pixels[i] ELSE pixels[65 - i] END AS vb FROM v_pix, range(1, 65) AS t(i)),
    pg AS (SELECT doc_key, page, any_value(label) <> 0 AS has_b, avg(va) AS mx, avg(vb) AS my, avg(va * va) AS sxx, avg(vb * vb) AS syy,
        avg(va * vb) AS sxy FROM cells GROUP BY doc_key, page),
    sc AS (SELECT *, round(greatest(-1.0, least(1.0, (2 * mx * my + {X.C1}) * (2 * (sxy - mx * my) + {X.C2}) / ((mx * mx + my * my
        + {X.C1}) * ((sxx - mx * mx) + (syy - my * my) + {X.C2})))), 6) AS ssim FROM pg)
    SELECT doc_key, page, ssim, 'ssim_below_threshold threshold=0.97' AS reason FROM sc WHERE has_b AND ssim < 0.97
    UNION ALL SELECT doc_key, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CASE WHEN count(*) FILTER (has_b) = 0 THEN 'baseline_missing' ELSE
    'page_count_mismatch expected=' || count(*) FILTER (has_b) || ' actual=' || count(*) END FROM sc GROUP BY doc_key
    HAVING count(*) FILTER (has_b) <> count(*)""",
)
def _(spark, d):
    return X.baseline_failures(*_page_sets(spark, d), "doc_key")
