"""Lines, blocks, sections and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.plans import relations as R
from quire.plans import sqltext as S
from quire.plans.base import ctes, query, table

ctes(
    conv_lines=S.lines_of("v_conv"),
    doc_lines=S.lines_of("v_doc"),
    page_text_lines=S.lines_of("v_page_text"),
    conv_kinds=f"SELECT doc_id, pos, raw, s, {S.kind('s')} AS kind FROM conv_lines",
    doc_kinds=f"SELECT doc_id, pos, raw, s, {S.kind('s')} AS kind FROM doc_lines",
    page_kinds=f"SELECT doc_id, pos, raw, s, {S.kind('s')} AS kind FROM page_text_lines",
    corpus_kinds="""SELECT 'conv' AS corpus, * FROM conv_kinds UNION ALL SELECT 'doc', * FROM doc_kinds
        UNION ALL SELECT 'page', * FROM page_kinds""",
    corpus_body=f"""SELECT corpus, doc_id, pos, s, kind, {S.body('kind', 's')} AS body,
        CASE WHEN kind = 'heading' THEN CAST(length(regexp_extract(s, '^#{{1,3}}', 0)) AS INTEGER) END AS level
        FROM corpus_kinds""",
    corpus_runs="""SELECT *, sum(st) OVER (PARTITION BY corpus, doc_id ORDER BY pos) AS block_no FROM (
        SELECT *, CASE WHEN kind <> 'blank' AND NOT (kind = 'paragraph' AND coalesce(lag(kind) OVER (PARTITION BY corpus,
        doc_id ORDER BY pos), '') = 'paragraph') THEN 1 ELSE 0 END AS st FROM corpus_body)""",
    corpus_blocks="""SELECT corpus, doc_id, CAST(block_no AS BIGINT) AS block_no, min(kind) AS kind, min(level) AS level,
        string_agg(body, ' ' ORDER BY pos) AS text FROM corpus_runs WHERE kind <> 'blank' GROUP BY corpus, doc_id, block_no""",
    conv_blocks="SELECT doc_id, block_no, kind, level, text FROM corpus_blocks WHERE corpus = 'conv'",
    doc_blocks="SELECT doc_id, block_no, kind, level, text FROM corpus_blocks WHERE corpus = 'doc'",
    page_blocks="SELECT doc_id, block_no, kind, level, text FROM corpus_blocks WHERE corpus = 'page'",
    conv_parents="""SELECT doc_id, block_no, kind, level, text, CAST(coalesce(CASE
        WHEN kind = 'heading' AND level = 1 THEN 0
        WHEN kind = 'heading' AND level = 2 THEN p2
        WHEN kind = 'heading' THEN p3 ELSE p4 END, 0) AS BIGINT) AS parent_no FROM (SELECT *,
        last_value(CASE WHEN kind = 'heading' AND level < 2 THEN block_no END IGNORE NULLS) OVER w AS p2,
        last_value(CASE WHEN kind = 'heading' AND level < 3 THEN block_no END IGNORE NULLS) OVER w AS p3,
        last_value(CASE WHEN kind = 'heading' THEN block_no END IGNORE NULLS) OVER w AS p4 FROM conv_blocks
        WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    conv_sections=f"""SELECT doc_id, section, {S.strip("coalesce(string_agg(line, chr(10) ORDER BY pos), '')")} AS body FROM (
        SELECT doc_id, pos, CASE WHEN head THEN NULL ELSE raw END AS line,
        coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '_preamble') AS section FROM (
        SELECT doc_id, pos, raw, kind = 'heading' AS head, CASE WHEN kind = 'heading' THEN
        {S.canon(f"regexp_replace(s, '{T.HEADING_MARK}', '')")} END AS title FROM conv_kinds
        UNION ALL SELECT doc_id, -1, NULL, false, NULL FROM v_conv)) GROUP BY doc_id, section""",
    conv_headed=f"""SELECT doc_id, CAST(sec_no AS BIGINT) AS sec_no,
        {S.canon(f"regexp_replace(heading, '{T.HEADING_MARK}', '')")} AS title, heading, {S.strip('body')} AS body FROM (
        SELECT doc_id, sec_no, max(CASE WHEN kind = 'heading' THEN s END) AS heading,
        coalesce(string_agg(CASE WHEN kind <> 'heading' THEN raw END, chr(10) ORDER BY pos), '') AS body FROM (
        SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec_no
        FROM conv_kinds) GROUP BY doc_id, sec_no)""",
    clean_plan=f"""SELECT doc_id, pos, title, mode FROM (SELECT doc_id, pos,
        {S.canon(f"substr({S.strip('title')}, 1, 200)")} AS title, CASE WHEN {S.strip('mode')} IN ('auto_generate',
        'user_provides', 'skip') THEN {S.strip('mode')} ELSE 'auto_generate' END AS mode FROM v_plan) WHERE title <> ''""",
    conv_h123="""SELECT doc_id, block_no AS pos, level, text AS title FROM conv_blocks WHERE kind = 'heading'""",
    page_h123="""SELECT doc_id, block_no AS pos, CASE WHEN kind = 'heading' THEN 1 ELSE 2 END AS level, text AS title
        FROM page_blocks WHERE kind IN ('heading', 'list_item')""",
)


def _three(spark, d):
    for name, docs in (("conv", R.v_conv(spark, d)), ("doc", R.v_doc(spark, d)), ("page", R.v_page_text(spark, d))):
        yield name, docs


def _union(parts):
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


@query("b01_lines", "SELECT corpus, doc_id, CAST(pos AS INTEGER) AS pos, raw FROM corpus_raw")
def _(spark, d):
    return _union(
        B.lines(docs).select(F.lit(n).alias("corpus"), "doc_id", "pos", "raw")
        for n, docs in _three(spark, d)
        if n != "page"
    )


ctes(corpus_raw="SELECT corpus, doc_id, pos, raw FROM corpus_kinds WHERE corpus <> 'page'")


@query(
    "b02_line_kinds",
    "SELECT corpus, doc_id, CAST(pos AS INTEGER) AS pos, kind, level, body FROM corpus_body",
)
def _(spark, d):
    return _union(
        B.classified(docs).select(F.lit(n).alias("corpus"), "doc_id", "pos", "kind", "level", "body")
        for n, docs in _three(spark, d)
    )


@query("b03_merged_blocks", "SELECT * FROM corpus_blocks")
def _(spark, d):
    return _union(
        B.blocks(docs).select(F.lit(n).alias("corpus"), "doc_id", "block_no", "kind", "level", "text")
        for n, docs in _three(spark, d)
    )


@query(
    "b04_block_ids",
    """SELECT doc_id, CASE WHEN block_no = 0 THEN 'root' ELSE 'b' || block_no END AS block_id, block_no, kind, level, text FROM (
    SELECT doc_id, CAST(0 AS BIGINT) AS block_no, 'document' AS kind, 0 AS level, title AS text FROM v_conv
    UNION ALL SELECT * FROM conv_blocks)""",
)
def _(spark, d):
    docs = R.v_conv(spark, d)
    return B.with_root(B.blocks(docs), docs, F.col("title"))


@query("b05_block_parents", "SELECT doc_id, block_no, kind, level, parent_no FROM conv_parents")
def _(spark, d):
    return B.with_parents(B.blocks(R.v_conv(spark, d))).drop("text")


@query(
    "b06_children",
    """SELECT doc_id, parent_no, string_agg('b' || block_no, ',' ORDER BY block_no) AS children FROM conv_parents
    GROUP BY doc_id, parent_no""",
)
def _(spark, d):
    kids = B.children(B.with_parents(B.blocks(R.v_conv(spark, d))))
    ids = F.transform("children", lambda n: F.concat(F.lit("b"), n))
    return kids.withColumn("children", F.array_join(ids, ","))


@query(
    "b07_block_stats",
    """SELECT corpus, doc_id, count(*) + 1 AS total_blocks, count(*) FILTER (kind = 'heading') AS headings,
    count(*) FILTER (kind = 'paragraph') AS paragraphs,
    count(*) FILTER (kind IN ('list_item', 'ordered_list_item')) AS list_items,
    count(*) FILTER (kind = 'table_row') AS table_rows, count(*) FILTER (kind = 'image') AS images
    FROM corpus_blocks GROUP BY corpus, doc_id""",
)
def _(spark, d):
    return _union(B.block_stats(docs).withColumn("corpus", F.lit(n)) for n, docs in _three(spark, d))


@query("b08_section_bodies", "SELECT * FROM conv_sections")
def _(spark, d):
    return B.section_bodies(R.v_conv(spark, d))


@query("b09_headed_sections", "SELECT * FROM conv_headed")
def _(spark, d):
    return B.headed_sections(R.v_conv(spark, d))


@query(
    "b10_section_slices",
    f"""WITH n AS (SELECT * , sum(head) OVER (PARTITION BY corpus, doc_id ORDER BY pos) AS sec_no,
        max(head) OVER (PARTITION BY corpus, doc_id) AS any_head FROM (
        SELECT *, CASE WHEN regexp_matches(raw, '{T.HEADING}') THEN 1 ELSE 0 END AS head FROM corpus_kinds
        WHERE corpus <> 'page'))
    SELECT corpus, doc_id, CAST(sec_no AS BIGINT) AS sec_no,
        coalesce({S.strip(f"regexp_replace(heading, '{T.HEADING_MARK}', '')")}, 'Document') AS name,
        {S.strip('content')} AS content FROM (
        SELECT corpus, doc_id, sec_no, max(CASE WHEN head = 1 THEN s END) AS heading,
        string_agg(raw, chr(10) ORDER BY pos) AS content FROM n WHERE sec_no > 0 OR any_head = 0
        GROUP BY corpus, doc_id, sec_no)""",
)
def _(spark, d):
    return _union(
        B.section_slices(docs).withColumn("corpus", F.lit(n)) for n, docs in _three(spark, d) if n != "page"
    )


@query(
    "b11_apply_plan",
    f"""WITH firsts AS (SELECT doc_id, title, arg_min(body, sec_no) AS body FROM conv_headed WHERE sec_no > 0
        GROUP BY doc_id, title),
    parts AS (SELECT doc_id, -1 AS pos, body AS part FROM conv_headed WHERE sec_no = 0 AND body <> ''
        UNION ALL SELECT p.doc_id, p.pos, '## ' || p.title || chr(10) || CASE WHEN mode = 'user_provides'
        THEN '{B.USER_TEXT}' WHEN coalesce(f.body, '') <> '' THEN f.body ELSE '{B.FILLER_TEXT}' END
        FROM clean_plan p LEFT JOIN firsts f ON f.doc_id = p.doc_id AND f.title = p.title WHERE mode <> 'skip')
    SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY pos) AS text FROM parts GROUP BY doc_id""",
)
def _(spark, d):
    return B.apply_plan(R.v_conv(spark, d), B.normalise_plan(R.v_plan(spark, d)))


@query("b12_normalise_plan", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, title, mode FROM clean_plan")
def _(spark, d):
    return B.normalise_plan(R.v_plan(spark, d))


@query(
    "b13_required_sections",
    """SELECT doc_id, coalesce(string_agg(CASE WHEN mode = 'auto_generate' THEN title END, '|' ORDER BY pos),
    'introduction|body|conclusion') AS required FROM clean_plan GROUP BY doc_id""",
)
def _(spark, d):
    req = B.required_sections(B.normalise_plan(R.v_plan(spark, d)))
    return req.withColumn("required", F.array_join("required", "|"))


@query(
    "b14_flat_blocks",
    f"""WITH k AS (SELECT doc_id, pos, s, {S.rstrip('raw')} AS r FROM conv_lines),
    c AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN r LIKE '# %' THEN 'h1' WHEN r LIKE '## %' THEN 'h2'
        WHEN r LIKE '### %' THEN 'h3' WHEN regexp_matches(r, '{T.BULLET_MARK}') THEN 'li'
        WHEN regexp_matches(r, '{T.ORDERED_MARK}') THEN 'oli' ELSE 'p' END AS kind FROM k),
    b AS (SELECT *, {S.strip(f'''CASE WHEN kind IN ('h1', 'h2', 'h3') THEN regexp_replace(r, '^#{{1,3}} ', '')
        WHEN kind = 'li' THEN regexp_replace(r, '{T.BULLET_MARK}', '')
        WHEN kind = 'oli' THEN regexp_replace(r, '{T.ORDERED_MARK}', '') ELSE s END''')} AS body,
        CASE WHEN kind <> 'blank' AND NOT (kind = 'p' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos), '')
        = 'p') THEN 1 ELSE 0 END AS st FROM c),
    n AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos) AS block_no FROM b)
    SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, min(kind) AS kind, string_agg(body, ' ' ORDER BY pos) AS text
    FROM n WHERE kind <> 'blank' GROUP BY doc_id, block_no""",
)
def _(spark, d):
    return B.flat_blocks(R.v_conv(spark, d))


def _numbers_sql(src: str) -> str:
    own = f"NOT regexp_matches({S.strip('title')}, '{T.NUMBERED_TITLE}')"
    return f"""SELECT doc_id, pos, level, CASE WHEN own THEN concat_ws('.', nullif(n1, 0), CASE WHEN level > 1 THEN
        nullif(n2, 0) END, CASE WHEN level > 2 THEN nullif(n3, 0) END) || ' ' || {S.strip('title')} ELSE {S.strip('title')}
        END AS numbered FROM (SELECT *, CAST(sum(CASE WHEN own AND level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,
        n1, n2 ORDER BY pos) AS BIGINT) AS n3 FROM (SELECT *, CAST(sum(CASE WHEN own AND level = 2 THEN 1 ELSE 0 END) OVER
        (PARTITION BY doc_id, n1 ORDER BY pos) AS BIGINT) AS n2 FROM (SELECT *, CAST(sum(CASE WHEN own AND level = 1 THEN 1
        ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS n1 FROM (SELECT *, {own} AS own FROM {src}))))"""


@query(
    "b15_heading_numbers",
    f"""SELECT 'conv' AS corpus, * FROM ({_numbers_sql('conv_h123')}) UNION ALL
    SELECT 'page', * FROM ({_numbers_sql('page_h123')})""",
)
def _(spark, d):
    conv = B.blocks(R.v_conv(spark, d)).filter(F.col("kind") == "heading")
    page = B.blocks(R.v_page_text(spark, d)).filter(F.col("kind").isin("heading", "list_item"))
    page = page.withColumn("level", F.when(F.col("kind") == "heading", 1).otherwise(2))
    return _union(
        B.heading_numbers(
            b.select("doc_id", F.col("block_no").alias("pos"), "level", F.col("text").alias("title"))
        ).withColumn("corpus", F.lit(n))
        for n, b in (("conv", conv), ("page", page))
    )


@query(
    "b16_structured_text",
    f"""WITH k AS (SELECT doc_id, pos, s, CASE WHEN s = '' THEN 'blank'
        WHEN regexp_matches(s, '^#{{1,3}}{T.WS}+') OR (length(s) < 80 AND s LIKE '%:') THEN 'heading'
        WHEN regexp_matches(s, '{T.BULLET_MARK}') THEN 'bullet' ELSE 'paragraph' END AS kind FROM doc_lines),
    b AS (SELECT *, CASE kind WHEN 'heading' THEN CASE WHEN s LIKE '#%' THEN rtrim(s, ':') ELSE '### ' || rtrim(s, ':') END
        WHEN 'bullet' THEN '- ' || regexp_replace(s, '{T.BULLET_MARK}', '') ELSE s END AS body,
        CASE WHEN kind <> 'blank' AND NOT (kind = 'paragraph' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos),
        '') = 'paragraph') THEN 1 ELSE 0 END AS st FROM k),
    n AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos) AS block_no FROM b),
    m AS (SELECT doc_id, block_no, min(kind) AS kind, string_agg(body, ' ' ORDER BY pos) AS text FROM n
        WHERE kind <> 'blank' GROUP BY doc_id, block_no),
    p AS (SELECT doc_id, string_agg(CASE WHEN kind = 'bullet' THEN text ELSE text || chr(10) END, chr(10) ORDER BY block_no)
        AS body FROM m GROUP BY doc_id)
    SELECT d.doc_id, '# ' || title || chr(10) || chr(10) || '## Formatting Notes' || chr(10) || 'Language ' || lang || chr(10)
        || chr(10) || '## Introduction' || chr(10) || '{B.OPENING}' || chr(10) || chr(10) || '## Body' || chr(10) ||
        coalesce(body || chr(10), '') || '## Conclusion' || chr(10) || '{B.CLOSING}' AS text
    FROM (SELECT doc_id, 'Document ' || doc_id AS title, lang FROM documents) d LEFT JOIN p ON p.doc_id = d.doc_id""",
)
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("title", F.concat(F.lit("Document "), "doc_id"))
    return B.structured(docs, notes=F.concat(F.lit("Language "), "lang"))


@query(
    "b17_chunks",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(total AS INTEGER) AS total,
    substr(text, (i - 1) * 8000 + 1, 8000) AS chunk FROM (
    SELECT doc_id, text, total, unnest(range(1, total + 1)) AS i FROM (
    SELECT doc_id, text, CAST(ceil(length(text) / 8000.0) AS BIGINT) AS total FROM v_doc))""",
)
def _(spark, d):
    return B.chunks(R.v_doc(spark, d))


@query(
    "b18_word_split",
    f"""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE {S.rstrip('substr(text, 1, cut)')} END AS head,
    CASE WHEN length(text) <= 500 THEN '' ELSE {S.lstrip('substr(text, cut + 1)')} END AS tail FROM (
    SELECT *, CASE WHEN b = 0 OR 500 - b <= 0 THEN 500 ELSE 500 - b END AS cut FROM (
    SELECT doc_id, text, instr(reverse(substr(text, 1, 500)), ' ') AS b FROM v_doc))""",
)
def _(spark, d):
    return R.v_doc(spark, d).select("doc_id", T.split_at_word(F.col("text"), 500).alias("x")).select("doc_id", "x.*")


@query(
    "b19_truncated",
    f"""SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat ELSE {S.rstrip('substr(flat, 1, 157)')} || '...' END AS preview,
    CASE WHEN length(text) <= 300 THEN text ELSE {S.rstrip('substr(text, 1, 299)')} || '…' END AS truncated
    FROM (SELECT doc_id, text, {S.collapse('text')} AS flat FROM v_doc)""",
)
def _(spark, d):
    return R.v_doc(spark, d).select(
        "doc_id", T.preview(F.col("text")).alias("preview"), T.truncate_ellipsis(F.col("text"), 300).alias("truncated")
    )


@query(
    "b20_cover_summary",
    f"""WITH r AS (SELECT doc_id, pos, {S.strip('text')} AS s FROM v_cover),
    k AS (SELECT *, lower(s) AS low FROM r WHERE s <> ''),
    c AS (SELECT *, CASE WHEN low LIKE '%project report titled%' OR low LIKE '%bonafide certificate%' OR
        low LIKE 'declaration%' OR low LIKE 'acknowledgement%' THEN 'stop'
        WHEN regexp_matches(s, '{B.MONTH_YEAR}') THEN 'date' END AS mark FROM k),
    f AS (SELECT *, sum(CASE WHEN mark = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS stops,
        coalesce(sum(CASE WHEN mark = 'date' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dates FROM c)
    SELECT doc_id, string_agg(s, chr(10) ORDER BY pos) AS summary FROM f WHERE stops = 0 AND dates = 0 GROUP BY doc_id""",
)
def _(spark, d):
    return B.cover_summary(R.v_cover(spark, d))


@query(
    "b21_certified_title",
    f"""SELECT doc_id, arg_min(title, pos) AS title FROM (SELECT doc_id, pos,
    trim(regexp_replace(replace(regexp_extract(text, '{B.CERTIFIED_TITLE}', 1), '–', ' '), '{T.WS}+', ' ', 'g'),
    ' ' || chr(9) || '''"-–—') AS title FROM v_cover) WHERE title <> '' GROUP BY doc_id""",
)
def _(spark, d):
    return B.certified_title(R.v_cover(spark, d))


@query(
    "b22_safe_names",
    f"""SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_.\\-]', '_', 'g'), 1, 120) AS safe,
    CASE WHEN name <> '' THEN substr(regexp_replace(name, '[^A-Za-z0-9_.\\-]', '_', 'g'), 1, 120) END AS file_name FROM (
    SELECT page_id, url, string_split(path, '/')[-1] AS name FROM (
    SELECT page_id, url, rtrim(string_split({S.strip('url')}, '?')[1], '/') AS path FROM pages))""",
)
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", T.safe_name(F.col("url")).alias("safe"), T.url_file_name(F.col("url")).alias("file_name")
    )


@query(
    "b23_escaped",
    """SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages
    UNION ALL SELECT -1 - doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') FROM documents""",
)
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", T.escape_markup(F.col("html")).alias("escaped"))
    docs = table(spark, d, "documents").select(
        (-1 - F.col("doc_id")).alias("page_id"), T.escape_markup(F.col("text")).alias("escaped")
    )
    return pages.unionByName(docs)
