"""Ingest, multi-part documents, stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.sources import ingest as I
from quire.sources import parts as M
from quire.sources import stores as D
from quire.functions import text as T
from quire.plans import sqltext as S
from quire.plans.base import ctes, query, table

CLIP = 20_000
_ROLE = "CASE WHEN {id} % 5 = 0 THEN ' Reference ' WHEN {id} % 5 = 1 THEN '' ELSE 'content' END"
_EVENT_NAME = """CASE event_type WHEN 'view' THEN 'event_' || CAST(event_id AS STRING) || '.JSON' WHEN 'click' THEN 'event_' ||
    CAST(event_id AS STRING) || '.bin' WHEN 'signup' THEN 'event_' || CAST(event_id AS STRING) || '.png' WHEN 'purchase' THEN
    '' ELSE 'event' END"""
_EVENT_MIME = "CASE event_type WHEN 'purchase' THEN 'Application/JSON' WHEN 'error' THEN 'application/json' ELSE '' END"
_EVENT_TEXT = "CASE WHEN event_type = 'error' THEN props || '}}' ELSE props END".replace("}}", "}")


def v_file(spark, d):
    """job_id, pos, filename, mime, role, payload: every document, page, conversation turn and event as an upload."""
    plain = F.encode("text", "UTF-8")
    latin = (F.col("lang") == "fr") & ~F.col("text").rlike(r"[^\x00-\x{ff}]")
    docs = table(spark, d, "documents").select(
        F.expr("doc_id div 16").alias("job_id"),
        (F.col("doc_id") * 4).alias("pos"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("mime"),
        F.expr(_ROLE.format(id="doc_id")).alias("role"),
        F.when(latin, F.encode("text", "ISO-8859-1")).when(F.col("lang") == "de", F.encode("text", "UTF-16")).otherwise(plain).alias("raw"),
        F.col("doc_id").alias("id"),
    )
    pages = table(spark, d, "pages").select(
        F.expr("page_id div 16").alias("job_id"),
        (F.col("page_id") * 4 + 1).alias("pos"),
        F.concat(F.lit("page_"), "page_id", F.lit(".html")).alias("filename"),
        F.lit("").alias("mime"),
        F.expr(_ROLE.format(id="page_id")).alias("role"),
        F.encode("html", "UTF-8").alias("raw"),
        F.col("page_id").alias("id"),
    )
    conv_id = "(conv_id * 4294967296 + turn)"
    convs = table(spark, d, "conversations").select(
        F.expr("conv_id div 4").alias("job_id"),
        F.expr(f"{conv_id} * 4 + 2").alias("pos"),
        F.concat(F.lit("turn_"), F.expr(conv_id), F.lit(".md")).alias("filename"),
        F.lit("application/x-unknown").alias("mime"),
        F.expr(_ROLE.format(id=conv_id)).alias("role"),
        plain.alias("raw"),
        F.expr(conv_id).alias("id"),
    )
    events = table(spark, d, "events").select(
        F.expr("event_id div 64").alias("job_id"),
        (F.col("event_id") * 4 + 3).alias("pos"),
        F.expr(_EVENT_NAME).alias("filename"),
        F.expr(_EVENT_MIME).alias("mime"),
        F.expr(_ROLE.format(id="event_id")).alias("role"),
        F.encode(F.expr(_EVENT_TEXT), "UTF-8").alias("raw"),
        F.col("event_id").alias("id"),
    )
    every = docs.unionByName(pages).unionByName(convs).unionByName(events)
    payload = F.when(F.col("id") % 97 == 0, "@@@").otherwise(F.base64("raw"))
    return every.select("job_id", "pos", "filename", "mime", "role", payload.alias("payload"))


def _ingested(spark, d):
    return I.ingest(v_file(spark, d))


_BLOCK = f"chr(10) || chr(10) || '### Source File: ' || filename || chr(10) || {S.strip('coalesce(text, chr(32))')} || chr(10)"

ctes(
    v_file=f"""SELECT doc_id // 16 AS job_id, doc_id * 4 AS pos, 'doc_' || doc_id || '.txt' AS filename, 'text/plain' AS mime,
        {_ROLE.format(id='doc_id')} AS role, doc_id AS id, text AS plain, CASE WHEN lang = 'fr' AND NOT regexp_matches(text,
        '[^\\x00-\\x{{ff}}]') THEN length(text) WHEN lang = 'de' THEN 2 + 2 * length(text) ELSE strlen(text) END AS size FROM documents
        UNION ALL SELECT page_id // 16, page_id * 4 + 1, 'page_' || page_id || '.html', '', {_ROLE.format(id='page_id')}, page_id,
        html, strlen(html) FROM pages
        UNION ALL SELECT conv_id // 4, (conv_id * 4294967296 + turn) * 4 + 2, 'turn_' || (conv_id * 4294967296 + turn) || '.md',
        'application/x-unknown', {_ROLE.format(id='(conv_id * 4294967296 + turn)')}, conv_id * 4294967296 + turn, text, strlen(text)
        FROM conversations
        UNION ALL SELECT event_id // 64, event_id * 4 + 3, {_EVENT_NAME}, {_EVENT_MIME}, {_ROLE.format(id='event_id')}, event_id,
        {_EVENT_TEXT}, strlen({_EVENT_TEXT}) FROM events""",
    routed="""SELECT job_id, pos, CASE WHEN filename = '' THEN 'unnamed' ELSE filename END AS filename,
        CASE WHEN mime = '' THEN 'application/octet-stream' ELSE mime END AS mime,
        lower(trim(CASE WHEN role = '' THEN 'content' ELSE role END)) AS role, id % 97 = 0 AS bad, size, plain,
        CASE WHEN lower(mime) LIKE 'text/%' OR regexp_matches(lower(filename), '\\.(txt|md|csv|html|htm|xml|yaml|yml)$') THEN 'text'
        WHEN lower(mime) = 'application/json' OR lower(filename) LIKE '%_.json' THEN 'json' WHEN lower(filename) LIKE '%_.png'
        THEN 'image' ELSE 'fallback' END AS route FROM v_file""",
    ingested=f"""SELECT job_id, pos, filename, mime, role, CASE WHEN bad THEN 'failed' ELSE 'processed' END AS status,
        CASE WHEN bad THEN 'Invalid base64 file payload' END AS error, CASE WHEN NOT bad THEN CAST(size AS INTEGER) END AS bytes,
        route, CASE WHEN bad THEN NULL WHEN route = 'text' THEN plain WHEN route = 'json' THEN CASE WHEN plain LIKE '%}}}}' THEN plain
        ELSE replace(plain, ': ', ':') END WHEN route = 'fallback' THEN {S.strip('plain')} END AS text FROM routed""",
    role_texts=f"""SELECT job_id, role, substr({S.strip('t')}, 1, {CLIP}) AS text FROM (SELECT job_id,
        CASE WHEN role = 'reference' THEN 'reference' ELSE 'content' END AS role, string_agg({_BLOCK}, chr(10) ORDER BY pos) AS t
        FROM ingested WHERE status = 'processed' GROUP BY ALL)""",
    v_cells="""SELECT l_orderkey // 8 AS book, l_returnflag AS sheet, l_orderkey AS "row", l_linenumber, l_partkey, l_suppkey,
        l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN 's' WHEN 1 THEN 'n' WHEN 2 THEN 'b' ELSE 'inlineStr' END AS t,
        CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_discount = 0.0 THEN CAST(l_partkey + 1000000000 AS VARCHAR) WHEN l_discount =
        0.01 THEN 'x' || l_partkey ELSE ' ' || l_partkey || ' ' END WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
        WHEN 2 THEN CASE WHEN l_linestatus = 'O' THEN '1' ELSE '0' END ELSE CASE WHEN l_tax = 0.0 THEN '  ' ELSE ' ' ||
        l_returnflag || l_suppkey END END AS v FROM lineitem""",
    cell_values="""SELECT c.*, CASE t WHEN 's' THEN coalesce(p_name, trim(v)) WHEN 'b' THEN CASE WHEN v = '1' THEN 'TRUE' ELSE 'FALSE'
        END ELSE trim(v) END AS value FROM v_cells c LEFT JOIN part ON t = 's' AND TRY_CAST(trim(v) AS BIGINT) = p_partkey""",
    cell_rows="""SELECT book, sheet, "row", coalesce(array_to_string(list(value ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_extendedprice, value) FILTER (value <> ''), chr(9)), '') AS line FROM cell_values GROUP BY book, sheet, "row\"""",
    sheet_texts="""SELECT book, sheet, '### Sheet: ' || sheet || chr(10) || string_agg(line, chr(10) ORDER BY "row") AS text
        FROM cell_rows WHERE line <> '' GROUP BY book, sheet""",
)


@query("s01_file_ingest", "SELECT job_id, pos, filename, mime, role, status, error, bytes, route FROM ingested")
def _(spark, d):
    return _ingested(spark, d).drop("text")


@query("s02_payload_decode", "SELECT job_id, pos, id % 97 <> 0 AS decoded, CASE WHEN id % 97 <> 0 THEN CAST(size AS INTEGER) END AS bytes FROM v_file")
def _(spark, d):
    raw = I.decode_payload(F.col("payload"))
    return v_file(spark, d).select("job_id", "pos", raw.isNotNull().alias("decoded"), F.octet_length(raw).alias("bytes"))


@query("s03_bytes_to_text", "SELECT pos, plain AS text FROM v_file WHERE id % 97 <> 0")
def _(spark, d):
    raw = v_file(spark, d).select("pos", I.decode_payload(F.col("payload")).alias("raw")).filter(F.col("raw").isNotNull())
    return raw.select("pos", I.bytes_to_text(F.col("raw")).alias("text"))


@query("s04_type_router", "SELECT pos, route FROM routed")
def _(spark, d):
    return v_file(spark, d).select("pos", I.route(F.col("filename"), F.col("mime")).alias("route"))


@query("s05_json_normalised", "SELECT pos, text FROM ingested WHERE route = 'json' AND status = 'processed'")
def _(spark, d):
    return _ingested(spark, d).filter("route = 'json' AND status = 'processed'").select("pos", "text")


@query("s06_role_texts", "SELECT * FROM role_texts")
def _(spark, d):
    return I.role_texts(_ingested(spark, d), CLIP, v_file(spark, d))


@query(
    "s07_ingest_summary",
    """SELECT job_id, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed,
    CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM ingested GROUP BY job_id""",
)
def _(spark, d):
    return I.summary(_ingested(spark, d))


@query("s07_file_entries", "SELECT job_id, pos, filename, mime, role, status, bytes, error FROM ingested")
def _(spark, d):
    return I.file_entries(_ingested(spark, d))


def _cells(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey div 8 AS book",
        "l_returnflag AS sheet",
        "l_orderkey AS row",
        "named_struct('a', l_linenumber, 'b', l_partkey, 'c', l_suppkey, 'd', l_extendedprice) AS col",
        "CASE l_linenumber % 4 WHEN 0 THEN 's' WHEN 1 THEN 'n' WHEN 2 THEN 'b' ELSE 'inlineStr' END AS t",
        """CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_discount = 0.0 THEN CAST(l_partkey + 1000000000 AS STRING) WHEN l_discount =
        0.01 THEN 'x' || l_partkey ELSE ' ' || l_partkey || ' ' END WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING)
        WHEN 2 THEN CASE WHEN l_linestatus = 'O' THEN '1' ELSE '0' END ELSE CASE WHEN l_tax = 0.0 THEN '  ' ELSE ' ' ||
        l_returnflag || l_suppkey END END AS v""",
    )


def _sheets(spark, d):
    words = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    return M.resolve_cells(_cells(spark, d), words)


@query("s08_sheet_texts", "SELECT * FROM sheet_texts")
def _(spark, d):
    return M.sheet_texts(_sheets(spark, d))


@query(
    "s08_sheet_parts",
    """SELECT book, sheet, part, CASE WHEN part = min(part) OVER (PARTITION BY book, sheet) THEN '### Sheet: ' || sheet || chr(10)
    ELSE '' END || body AS text FROM (SELECT book, sheet, "row" // 3 AS part, string_agg(line, chr(10) ORDER BY "row") AS body
    FROM cell_rows WHERE line <> '' GROUP BY book, sheet, part)""",
)
def _(spark, d):
    return M.sheet_texts(_sheets(spark, d), rows_per_part=3)


@query(
    "s08_book_texts",
    """SELECT book, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY CASE sheet WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END),
    '[XLSX parsed, but no extractable text was found.]') AS text FROM (SELECT DISTINCT (o_orderkey + 4) // 8 AS book FROM orders)
    LEFT JOIN sheet_texts USING (book) GROUP BY book""",
)
def _(spark, d):
    order = "posexplode(array('R', 'A', 'N')) AS (pos, sheet)"
    books = table(spark, d, "orders").selectExpr("(o_orderkey + 4) div 8 AS book").distinct().selectExpr("book", order)
    return M.book_texts(books, M.sheet_texts(_sheets(spark, d)))


@query(
    "s09_slide_texts",
    """SELECT deck, string_agg('### Slide ' || n || chr(10) || body, chr(10) || chr(10) ORDER BY n) AS text FROM (
    SELECT l_orderkey // 4 AS deck, l_linenumber * 3 AS n, array_to_string(list('Part ' || l_partkey ORDER BY l_orderkey, l_partkey,
    l_suppkey, l_extendedprice), chr(10)) AS body FROM lineitem WHERE l_tax > 0.0 AND l_linenumber < 7 GROUP BY deck, n) GROUP BY deck""",
)
def _(spark, d):
    paras = table(spark, d, "lineitem").selectExpr(
        "l_orderkey div 4 AS deck",
        "CASE WHEN l_linenumber = 7 THEN 'ppt/slides/notes.xml' ELSE 'ppt/slides/slide' || (l_linenumber * 3) || '.xml' END AS name",
        "named_struct('o', l_orderkey, 'a', l_partkey, 'b', l_suppkey, 'c', l_extendedprice) AS pos",
        "CASE WHEN l_tax = 0.0 THEN '  ' ELSE ' Part ' || l_partkey END AS text",
    )
    return M.slide_texts(paras)


@query(
    "s10_document_texts",
    """SELECT doc, string_agg(body, chr(10) || chr(10) ORDER BY rank * 1000000000 + pos) AS text FROM (
    SELECT o_custkey AS doc, o_orderkey AS pos, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 0
    WHEN '4' THEN 1 END AS rank, CASE WHEN o_orderstatus = 'P' THEN 'Order ' || o_orderkey || chr(10) || 'closing' ELSE 'Order ' ||
    o_orderkey END AS body FROM orders) WHERE rank IS NOT NULL GROUP BY doc""",
)
def _(spark, d):
    parts = table(spark, d, "orders").selectExpr(
        "o_custkey AS doc",
        "o_orderkey AS pos",
        """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'word/header1.xml' WHEN '2' THEN 'word/footnotes.xml' WHEN '3' THEN
        'word/document.xml' WHEN '4' THEN 'word/footer12.xml' ELSE 'word/settings.xml' END AS name""",
        """'<w:document xmlns:w="u"><w:p><w:r><w:t xml:space="preserve"> Ord</w:t></w:r><w:r><w:t>er ' || o_orderkey ||
        '</w:t></w:r></w:p><w:p><w:tab/></w:p>' || CASE WHEN o_orderstatus = 'P' THEN '<w:p><w:r><w:t>closing</w:t></w:r></w:p>'
        ELSE '' END || '</w:document>' AS xml""",
    )
    return M.document_texts(parts)


@query(
    "s11_merged_content",
    f"""SELECT job_id, content, CASE WHEN {S.strip('content')} = '' THEN 'empty' WHEN length(content) > 15000 THEN 'too_large' END AS reject
    FROM (SELECT coalesce(p.job_id, r.job_id) AS job_id, CASE WHEN coalesce(r.text, '') <> '' THEN coalesce(typed, '') || chr(10) ||
    chr(10) || r.text ELSE coalesce(typed, '') END AS content FROM (SELECT p_partkey AS job_id, CASE WHEN p_size > 25 THEN p_name
    ELSE '' END AS typed FROM part) p FULL JOIN (SELECT * FROM role_texts WHERE role = 'content') r ON r.job_id = p.job_id)""",
)
def _(spark, d):
    typed = table(spark, d, "part").selectExpr("p_partkey AS job_id", "CASE WHEN p_size > 25 THEN p_name ELSE '' END AS typed")
    texts = I.role_texts(_ingested(spark, d), CLIP, v_file(spark, d))
    return I.merge_content(typed, texts, 15_000)


@query(
    "t10_content_hashes",
    "SELECT page_id, strlen(html) AS size, sha256(html) AS digest FROM pages",
)
def _(spark, d):
    raw = F.encode("html", "UTF-8")
    return table(spark, d, "pages").select(
        "page_id", F.octet_length(raw).cast("bigint").alias("size"), F.sha2(raw, 256).alias("digest")
    )


@query(
    "s12_user_history",
    "SELECT event_id AS report_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events WHERE user_id = 7",
)
def _(spark, d):
    reports = table(spark, d, "events").select(F.col("event_id").alias("report_id"), "user_id", F.col("ts").alias("created_at"))
    return D.user_history(reports, 7).select(
        "report_id", "user_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created")
    )


def _templates(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_brand AS template_id", "p_size % 3 || '.' || p_partkey % 20 || '.' || p_partkey % 7 AS version", "p_partkey"
    )


@query(
    "s13_list_versions",
    """SELECT p_brand AS template_id, p_size % 3 || '.' || p_partkey % 20 || '.' || p_partkey % 7 AS version, p_partkey FROM part
    WHERE p_brand = 'Brand#2'""",
)
def _(spark, d):
    return D.list_versions(_templates(spark, d), "Brand#2")


@query(
    "s13_version_exists",
    """SELECT count(*) > 0 AS present FROM part WHERE p_brand = 'Brand#2' AND p_size % 3 || '.' || p_partkey % 20 || '.' ||
    p_partkey % 7 = '2.0.0'""",
)
def _(spark, d):
    return D.exists(_templates(spark, d), "Brand#2", "2.0.0")


@query(
    "s14_rules_records",
    """SELECT c_name AS document_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'generic' ELSE c_mktsegment END AS document_type,
    '' AS notes, 'active' AS status, c_custkey, true AS has_id FROM customer""",
)
def _(spark, d):
    rules = table(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    rec = D.rules_records(rules, F.col("c_name"), kind, F.lit(None).cast("string"))
    return rec.select(
        "document_name", "document_type", "notes", "status", "rules.c_custkey", (F.length("rules_id") == 36).alias("has_id")
    )


@query(
    "s15_absent_users",
    """SELECT u.user_id, email, CASE WHEN u.user_id % 4 = 0 THEN 'User ' || u.user_id ELSE split_part(email, '@', 1) END AS name FROM (
    SELECT DISTINCT user_id, 'user' || user_id || '@example.com' AS email FROM events) u
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(spark, d):
    existing = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    incoming = table(spark, d, "events").select("user_id").distinct().selectExpr(
        "user_id",
        "'user' || user_id || '@example.com' AS email",
        "CASE WHEN user_id % 4 = 0 THEN 'User ' || user_id ELSE '' END AS name",
    )
    return D.absent_users(existing, incoming)
