"""Input relations derived from the given tables, as Spark DataFrames and as the same SQL for the checks.

Every relation covers whole tables. Groups that are gathered into one text cell are bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.windows import ordered_text
from quire.plans import sqltext as S
from quire.plans.base import ctes, table

SEGMENT = 64  # parameter of the relation: turns per conversation document, so one of any length becomes bounded documents
#: Ids per conversation. More segments would need turns beyond 2 ** 38; an id beyond 64 bits is an error, so ids never meet.
IDS = 1 << 32


def v_conv(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, title, text: markdown-like text of a conversation segment."""
    c = table(spark, d, "conversations")
    name = (
        F.when(F.col("role") == "user", "Introduction").when(F.col("role") == "assistant", "Body").otherwise("Conclusion")
    )
    block = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), name, F.lit("\n"), "text")
    rows = c.select(
        "conv_id", F.expr(f"conv_id * {IDS} + turn div {SEGMENT}").alias("doc_id"), "turn", block.alias("block")
    )
    return (
        rows.groupBy("doc_id")
        .agg(
            F.any_value("conv_id").alias("conv_id"),
            ordered_text(F.col("turn"), F.col("block"), "\n\n").alias("body"),
        )
        .select(
            "doc_id",
            F.concat(F.lit("Conversation "), "conv_id").alias("title"),
            F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), "body").alias("text"),
        )
    )


def v_doc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("Document "), "doc_id").alias("title"), "text"
    )


# The page elements that carry text lines.
PAGE_ITEM = r"(?s)<h1[^>]*>.*?</h1>|<li[^>]*>.*?</li>|<p[^>]*>.*?</p>"
PAGE_INLINE = r"</?(?:a|b|i|em|strong|span)(?: [^>]*)?>"


def v_page_text(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, title, text: heading, list and paragraph lines of a page, one element per line."""
    p = table(spark, d, "pages")
    items = F.regexp_extract_all(F.regexp_replace("html", PAGE_INLINE, ""), F.lit(PAGE_ITEM), F.lit(0))

    def line(item):
        mark = F.when(item.startswith("<h1"), "# ").when(item.startswith("<li"), "- ").otherwise("")
        return F.concat(mark, T.collapse(F.regexp_replace(item, "<[^>]*>", "")))

    return p.select(
        F.col("page_id").alias("doc_id"), F.col("url").alias("title"), F.array_join(F.transform(items, line), "\n").alias("text")
    )


def v_plan(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, title, mode: an unclean section plan per conversation document."""
    return v_conv(spark, d).select("doc_id").selectExpr(
        "doc_id",
        """posexplode(array('  introduction ', 'Body', '', 'conclusion', 'appendix  notes')) AS (pos, title)""",
    ).withColumn(
        "mode",
        F.element_at(
            F.array(F.lit("auto_generate"), F.lit(" user_provides "), F.lit("skip"), F.lit("draft")),
            ((F.expr(f"doc_id div {IDS}") + F.col("pos")) % 4 + 1).cast("int"),
        ),
    )


def v_cover(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, text: cover-page paragraphs; a document is a customer, a paragraph an order."""
    o = table(spark, d, "orders")
    pr = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(
            pr == "1",
            F.concat(
                F.lit("Certified that the project report titled \""),
                "o_orderstatus",
                F.lit(" – order  "),
                F.col("o_orderkey"),
                F.lit("\" is  the bonafide work of customer "),
                F.col("o_custkey"),
            ),
        )
        .when((pr == "2") & (F.col("o_orderstatus") == "P"), F.concat(F.lit("Declaration by customer "), F.col("o_custkey")))
        .when(pr == "3", F.date_format("o_orderdate", "MMMM yyyy"))
        .when((pr == "4") & (F.col("o_orderstatus") == "P"), F.lit("  "))
        .otherwise(F.concat(F.lit("  Order "), F.col("o_orderkey"), F.lit(" ")))
    )
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), text.alias("text"))


# Instruction phrases of the rule vocabulary.
PHRASES = [
    "# 1 Report outline",
    "2.1 Methodology and results",
    "- The report must use double spacing throughout.",
    "Use APA citation style.",
    "Prefer MLA references where possible.",
    "Text should be left align in tables.",
    "Always justify the body paragraphs.",
    "Use bullet points for key findings.",
    "No bullet lists in the introduction.",
    "Keep to about 12 pages in a formal tone.",
    "This is a long report with a table and a figure.",
    "Single spacing is required for quotes.",
    "Times New Roman with extra paragraph spacing.",
    "### Discussion and conclusion",
    "Center the title; IEEE markers recommended.",
    "\tUse numbered headings and 1.5 spacing - ",
]


def v_brief(spark: SparkSession, d: str) -> DataFrame:
    """brief_id, text: free-text formatting rules, phrase j kept when (orderkey * (j + 3) + j) % 5 = 0."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    kept = F.array_compact(
        F.array(*[F.when((key * (j + 3) + j) % 5 == 0, F.lit(p)) for j, p in enumerate(PHRASES)])
    )
    return o.select(key.alias("brief_id"), F.array_join(kept, "\n").alias("text"))


def _phrase_sql() -> str:
    items = ", ".join(
        "CASE WHEN (o_orderkey * {a} + {j}) % 5 = 0 THEN '{p}' END".format(a=j + 3, j=j, p=p.replace("'", "''"))
        for j, p in enumerate(PHRASES)
    )
    return (
        "SELECT o_orderkey AS brief_id, array_to_string(list_filter([" + items + "], lambda x: x IS NOT NULL), chr(10)) "
        "AS text FROM orders"
    )


ctes(
    v_conv="""SELECT conv_id * 4294967296 + turn // 64 AS doc_id, 'Conversation ' || conv_id AS title,
        '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg(repeat('#', CAST(turn % 3 + 1 AS INTEGER)) || ' ' ||
        CASE role WHEN 'user' THEN 'Introduction' WHEN 'assistant' THEN 'Body' ELSE 'Conclusion' END || chr(10) || text,
        chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id, turn // 64""",
    v_doc="SELECT doc_id, 'Document ' || doc_id AS title, text FROM documents",
    v_page_items=f"""SELECT page_id AS doc_id, url AS title, unnest(range(len(items))) AS pos, unnest(items) AS item FROM (
        SELECT page_id, url, regexp_extract_all(regexp_replace(html, '{PAGE_INLINE}', '', 'g'), '{PAGE_ITEM}') AS items
        FROM pages)""",
    v_page_lines=f"""SELECT doc_id, title, pos, CASE WHEN item LIKE '<h1%' THEN '# ' WHEN item LIKE '<li%' THEN '- ' ELSE ''
        END || {S.collapse("regexp_replace(item, '<[^>]*>', '', 'g')")} AS line FROM v_page_items""",
    v_page_text="""SELECT p.page_id AS doc_id, p.url AS title, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS text
        FROM pages p LEFT JOIN v_page_lines l ON l.doc_id = p.page_id GROUP BY p.page_id, p.url""",
    v_plan="""SELECT doc_id, pos, title, ['auto_generate', ' user_provides ', 'skip', 'draft'][(doc_id // 4294967296 + pos) % 4 + 1]
        AS mode FROM v_conv_ids, (VALUES (0, '  introduction '), (1, 'Body'), (2, ''), (3, 'conclusion'),
        (4, 'appendix  notes')) AS t(pos, title)""",
    v_conv_ids="SELECT doc_id FROM v_conv",
    v_cover="""SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE
        WHEN o_orderpriority LIKE '1%' THEN 'Certified that the project report titled "' || o_orderstatus || ' – order  ' ||
            o_orderkey || '" is  the bonafide work of customer ' || o_custkey
        WHEN o_orderpriority LIKE '2%' AND o_orderstatus = 'P' THEN 'Declaration by customer ' || o_custkey
        WHEN o_orderpriority LIKE '3%' THEN strftime(o_orderdate, '%B %Y')
        WHEN o_orderpriority LIKE '4%' AND o_orderstatus = 'P' THEN '  '
        ELSE '  Order ' || o_orderkey || ' ' END AS text FROM orders""",
    v_brief=_phrase_sql(),
)
