"""Text of multi-part documents: sheet cells, slides, document parts. Inputs are rows, archives are opened elsewhere.

Rows are joined in two steps (cells to rows, rows to sheets), so a step gathers one row or one sheet of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.windows import ordered_text

TRUE_CELLS = ["1", "true", "TRUE"]


def resolve_cells(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """cells: book, sheet, row, col, t, v. Adds ``value``: shared strings looked up (an unknown index keeps the raw text),
    booleans spelled out, everything trimmed. dictionary: idx, text."""
    raw = T.strip(F.coalesce("v", F.lit("")))
    keyed = cells.withColumn("_raw", raw).withColumn(
        "idx", F.when(F.col("t") == "s", F.col("_raw").try_cast("bigint"))
    )
    found = keyed.join(dictionary.select("idx", F.col("text").alias("_text")), "idx", "left")
    value = (
        F.when(F.col("t") == "s", F.coalesce("_text", "_raw"))
        .when(F.col("t") == "b", F.when(F.col("_raw").isin(TRUE_CELLS), "TRUE").otherwise("FALSE"))
        .otherwise(F.col("_raw"))
    )
    return found.select(*cells.columns, value.alias("value"))


# Fixed value: the text of a workbook without any.
EMPTY_BOOK = "[XLSX parsed, but no extractable text was found.]"


def sheet_texts(resolved: DataFrame, rows_per_part: int | None = None) -> DataFrame:
    """book, sheet, text: empty cells dropped, cells joined by tabs, rows by line feeds, under a sheet header.

    A sheet is one text cell. For sheets too large for one, ``rows_per_part`` gives book, sheet, part, text instead: row r
    is in part r div rows_per_part, only a sheet's first part has the header, and its parts in order, joined by line feeds,
    are the same text.
    """
    filled = F.when(F.col("value") != "", F.col("value"))
    rows = resolved.groupBy("book", "sheet", "row").agg(ordered_text(F.col("col"), filled, "\t").alias("line"))
    rows = rows.withColumn("line", T.strip(F.col("line"))).filter(F.col("line") != "")
    header = F.concat(F.lit("### Sheet: "), "sheet", F.lit("\n"), "body")
    body = ordered_text(F.col("row"), F.col("line"), "\n").alias("body")
    if rows_per_part is None:
        return rows.groupBy("book", "sheet").agg(body).select("book", "sheet", header.alias("text"))
    part = F.floor(F.col("row") / rows_per_part).cast("bigint")
    parts = rows.withColumn("part", part).groupBy("book", "sheet", "part").agg(body)
    first = F.min("part").over(Window.partitionBy("book", "sheet")) == F.col("part")
    return parts.select("book", "sheet", "part", F.when(first, header).otherwise(F.col("body")).alias("text"))


def book_texts(sheets: DataFrame, texts: DataFrame) -> DataFrame:
    """book, text: the texts of a workbook's sheets in file order, or a fixed line if no sheet has any. sheets: book,
    sheet, pos; texts: book, sheet, text."""
    found = sheets.join(texts.select("book", "sheet", "text"), ["book", "sheet"], "left")
    whole = found.groupBy("book").agg(T.strip(ordered_text(F.col("pos"), F.col("text"), "\n\n")).alias("text"))
    return whole.select("book", F.coalesce(F.nullif("text", F.lit("")), F.lit(EMPTY_BOOK)).alias("text"))


def member_number(name: Column) -> Column:
    """Number before the .xml suffix; a name without one sorts last."""
    n = F.regexp_extract(name, r"(\d+)\.xml$", 1).try_cast("int")
    return F.coalesce(n, F.lit(1_000_000_000))


def slide_texts(paras: DataFrame) -> DataFrame:
    """deck, text. paras: deck, name, pos, text. Slides by number, empty paragraphs dropped, a header per slide."""
    s = T.strip(F.coalesce("text", F.lit("")))
    rows = paras.filter(F.col("name").rlike(r"^ppt/slides/slide\d+\.xml$")).filter(s != "")
    slides = rows.withColumn("n", member_number(F.col("name"))).groupBy("deck", "n").agg(
        ordered_text(F.col("pos"), T.strip(F.col("text")), "\n").alias("body")
    )
    block = F.concat(F.lit("### Slide "), F.col("n").cast("string"), F.lit("\n"), "body")
    return slides.groupBy("deck").agg(ordered_text(F.col("n"), block, "\n\n").alias("text"))


def paragraph_texts(xml: Column) -> Column:
    """Non-empty paragraph texts of a WordprocessingML part, runs joined."""

    def runs(p: Column) -> Column:
        return T.strip(F.array_join(F.regexp_extract_all(p, F.lit(r"<w:t(?: [^>]*)?>([^<]*)</w:t>"), F.lit(1)), ""))

    return F.filter(F.transform(F.split(xml, "</w:p>", -1), runs), lambda t: t != "")


def part_rank(name: Column) -> Column:
    """Body, then headers and footers, then notes and comments; null for parts without text."""
    return (
        F.when(name == "word/document.xml", 0)
        .when(name.rlike(r"^word/(?:header|footer)\d+\.xml$"), 1)
        .when(name.rlike(r"^word/(?:footnotes|endnotes|comments)\.xml$"), 2)
    )


def document_texts(parts: DataFrame) -> DataFrame:
    """doc, text. parts: doc, pos, name, xml."""
    rows = parts.withColumn("_rank", part_rank(F.col("name"))).filter(F.col("_rank").isNotNull())
    body = F.array_join(paragraph_texts(F.col("xml")), "\n")
    rows = rows.withColumn("_body", body).filter(F.col("_body") != "")
    return rows.groupBy("doc").agg(ordered_text(F.struct("_rank", "pos"), F.col("_body"), "\n\n").alias("text"))
