"""Text to lines, blocks and sections.

Input is one row per document ``(doc_id, text)``. Whatever needs neighbouring lines first distributes the documents by
``doc_id`` while the text is still one cell, then explodes it; all windows and group-bys that follow reuse that
distribution. So the text is shuffled once, before it is multiplied into lines (not at all if the documents are bucketed
by ``doc_id``), and the rows of one window are never more than one text cell holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.windows import ordered_text

PREAMBLE = "_preamble"
# Fallback sections and the texts used when a planned section has none of its own.
DEFAULT_SECTIONS = ["Introduction", "Body", "Conclusion"]
MODES = ["auto_generate", "user_provides", "skip"]
USER_TEXT = (
    "This section is intentionally reserved for user-provided content and follows the requested structure without "
    "adding AI-authored analysis."
)
FILLER_TEXT = (
    "This section summarizes the available source material in a concise, formal style to preserve the required "
    "document structure."
)


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def _upto() -> WindowSpec:
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def lines(docs: DataFrame, text: str = "text", grouped: bool = False) -> DataFrame:
    """doc_id, pos, raw, s: one row per line; s is the stripped line.

    grouped=True puts a document's lines into one partition for the windows to come.
    """
    src = docs.select("doc_id", F.col(text).alias("_text"))
    if grouped:
        src = src.repartition("doc_id")  # left out by Spark if an aggregation already placed them so
    rows = src.select("doc_id", F.posexplode(T.split_lines(F.col("_text"))).alias("pos", "raw"))
    return rows.withColumn("s", T.strip(F.col("raw")))


def classified(docs: DataFrame, text: str = "text", grouped: bool = False) -> DataFrame:
    """lines plus kind, level (headings only) and body (marker removed)."""
    rows = T.settle(lines(docs, text, grouped), ["doc_id", "pos", "raw", "s"], kind=T.line_kind(F.col("s")))
    return rows.select(
        "*",
        F.when(F.col("kind") == "heading", T.heading_level(F.col("s"))).alias("level"),
        T.line_text(F.col("kind"), F.col("s")).alias("body"),
    )


def _merge_runs(rows: DataFrame, para: str) -> DataFrame:
    """Number blocks in order; a run of ``para`` lines is one block, joined by a blank."""
    prev = F.lag("kind").over(_doc())
    start = (F.col("kind") != "blank") & ~((F.col("kind") == para) & F.coalesce(prev == para, F.lit(False)))
    rows = rows.select("doc_id", "pos", "kind", "level", "body")
    numbered = rows.withColumn("block_no", F.sum(start.cast("int")).over(_upto()))
    return (
        numbered.filter(F.col("kind") != "blank")
        .groupBy("doc_id", "block_no")
        .agg(
            F.min("kind").alias("kind"),
            F.min("level").alias("level"),
            ordered_text(F.col("pos"), F.col("body"), " ").alias("text"),
        )
    )


def blocks(docs: DataFrame, text: str = "text", placed: bool = False) -> DataFrame:
    """doc_id, block_no, kind, level, text: content blocks with paragraph runs merged.

    placed=True: ``docs`` is a table bucketed by doc_id, so its texts are not moved.
    """
    return _merge_runs(classified(docs, text, grouped=not placed), "paragraph")


def with_root(blks: DataFrame, docs: DataFrame, title: Column) -> DataFrame:
    """Add the document block in front: block_no 0, id root, level 0, the title (Untitled when blank)."""
    name = T.strip(F.coalesce(title, F.lit("")))
    root = docs.select(
        "doc_id",
        F.lit(0).cast("bigint").alias("block_no"),
        F.lit("document").alias("kind"),
        F.lit(0).alias("level"),
        F.when(name == "", "Untitled").otherwise(name).alias("text"),
    )
    return root.unionByName(blks).withColumn(
        "block_id", F.when(F.col("block_no") == 0, "root").otherwise(F.concat(F.lit("b"), F.col("block_no")))
    )


def with_parents(blks: DataFrame) -> DataFrame:
    """parent_no: nearest earlier heading of smaller level for a heading, nearest earlier heading for the rest, else 0."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("kind") == "heading"

    def nearest(below: int) -> Column:
        return F.last(F.when(head & (F.col("level") < below), F.col("block_no")), ignorenulls=True).over(w)

    parent = (
        F.when(head & (F.col("level") == 1), F.lit(0))
        .when(head & (F.col("level") == 2), nearest(2))
        .when(head, nearest(3))
        .otherwise(nearest(4))
    )
    return blks.withColumn("parent_no", F.coalesce(parent, F.lit(0)).cast("bigint"))


def children(blks_with_parents: DataFrame) -> DataFrame:
    """doc_id, parent_no, children: block numbers in order."""
    return blks_with_parents.groupBy("doc_id", "parent_no").agg(
        F.array_sort(F.collect_list("block_no")).alias("children")
    )


def block_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts per document. Runs are told from the line before, taken inside the text cell, so only one count row per
    document and task is shuffled."""
    parts = F.transform(
        T.split_lines(F.col(text)), lambda line: T.line_kind(T.strip(line))
    )
    kinds = T.settle(docs, ["doc_id"], kinds=parts)
    pairs = kinds.select(
        "doc_id",
        F.explode_outer(
            F.arrays_zip(F.col("kinds").alias("kind"), F.concat(F.array(F.lit("")), F.col("kinds")).alias("prev"))
        ).alias("z"),
    ).select("doc_id", F.col("z.kind").alias("kind"), F.col("z.prev").alias("prev"))
    k = F.col("kind")
    para = (k == "paragraph") & (F.col("prev") != "paragraph")
    single = k.isin("heading", "list_item", "ordered_list_item", "image", "table_row")
    return pairs.groupBy("doc_id").agg(
        (F.count_if(para | single) + 1).alias("total_blocks"),
        F.count_if(k == "heading").alias("headings"),
        F.count_if(para).alias("paragraphs"),
        F.count_if(k.isin("list_item", "ordered_list_item")).alias("list_items"),
        F.count_if(k == "table_row").alias("table_rows"),
        F.count_if(k == "image").alias("images"),
    )


def section_bodies(docs: DataFrame, placed: bool = False) -> DataFrame:
    """doc_id, section, body: text under each canonical heading, repeated headings merged, preamble always present.
    placed=True: ``docs`` is bucketed by doc_id."""
    pieces = F.concat(F.array(F.lit(None).cast("string")), T.split_lines(F.col("text")))
    rows = docs.select("doc_id", "text")
    if not placed:
        rows = rows.repartition("doc_id")
    rows = rows.select("doc_id", F.posexplode(pieces).alias("pos", "raw")).withColumn("s", T.strip(F.col("raw")))
    head = F.col("s").rlike(T.HEADING)
    title = F.when(head, T.canon(F.regexp_replace("s", T.HEADING_MARK, "")))
    keyed = rows.withColumn("_head", head).withColumn(
        "section", F.coalesce(F.last(title, ignorenulls=True).over(_upto()), F.lit(PREAMBLE))
    )
    line = F.when(F.col("_head"), None).otherwise(F.col("raw"))
    return (
        keyed.groupBy("doc_id", "section")
        .agg(ordered_text(F.col("pos"), line, "\n").alias("body"))
        .withColumn("body", T.strip(F.col("body")))
    )


def headed_sections(docs: DataFrame) -> DataFrame:
    """doc_id, sec_no, title, heading, body: section 0 is the preamble, duplicates stay apart."""
    rows = lines(docs, grouped=True).withColumn("_head", F.col("s").rlike(T.HEADING))
    rows = rows.withColumn("sec_no", F.sum(F.col("_head").cast("int")).over(_upto()))
    heading = F.max(F.when(F.col("_head"), F.col("s")))
    out = rows.groupBy("doc_id", "sec_no").agg(
        heading.alias("heading"),
        ordered_text(F.col("pos"), F.when(~F.col("_head"), F.col("raw")), "\n").alias("body"),
    )
    return out.select(
        "doc_id",
        "sec_no",
        T.canon(F.regexp_replace("heading", T.HEADING_MARK, "")).alias("title"),
        "heading",
        T.strip(F.col("body")).alias("body"),
    )


def section_slices(docs: DataFrame) -> DataFrame:
    """doc_id, sec_no, name, content: from a heading at column 0 to the next one; no heading gives one Document row."""
    rows = lines(docs, grouped=True).withColumn("_head", F.col("raw").rlike(T.HEADING))
    rows = rows.select(
        "*",
        F.sum(F.col("_head").cast("int")).over(_upto()).alias("sec_no"),
        F.max("_head").over(Window.partitionBy("doc_id")).alias("_any"),
    ).filter((F.col("sec_no") > 0) | ~F.col("_any"))
    out = rows.groupBy("doc_id", "sec_no").agg(
        F.max(F.when(F.col("_head"), F.col("s"))).alias("heading"),
        ordered_text(F.col("pos"), F.col("raw"), "\n").alias("content"),
    )
    name = T.strip(F.regexp_replace("heading", T.HEADING_MARK, ""))
    return out.select(
        "doc_id", "sec_no", F.coalesce(name, F.lit("Document")).alias("name"), T.strip(F.col("content")).alias("content")
    )


def normalise_plan(plan: DataFrame, clip: int = 200) -> DataFrame:
    """Section plan rows: title canonical (clipped first), unknown mode -> auto_generate, empty titles dropped."""
    title = T.canon(F.substring(T.strip(F.coalesce("title", F.lit(""))), 1, clip))
    mode = T.strip(F.coalesce("mode", F.lit("")))
    return plan.select(
        "doc_id",
        "pos",
        title.alias("title"),
        F.when(mode.isin(*MODES), mode).otherwise(MODES[0]).alias("mode"),
    ).filter(F.col("title") != "")


def required_sections(plan: DataFrame, fallback: list[str] | None = None) -> DataFrame:
    """doc_id, required: auto-generated titles in plan order, or the fallback list when there is none."""
    names = [s.lower() for s in (fallback or DEFAULT_SECTIONS)]
    items = F.array_sort(F.collect_list(F.when(F.col("mode") == MODES[0], F.struct("pos", "title"))))
    out = plan.groupBy("doc_id").agg(F.transform(items, lambda x: x["title"]).alias("required"))
    default = F.array(*[F.lit(n) for n in names])
    return out.withColumn("required", F.when(F.size("required") == 0, default).otherwise(F.col("required")))


def apply_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, text: preamble, then the planned sections in plan order (skip drops, user_provides gives a fixed text,
    auto_generate takes the first section of that title or a fixed filler)."""
    secs = headed_sections(docs)
    pre = secs.filter((F.col("sec_no") == 0) & (F.col("body") != "")).select(
        "doc_id", F.lit(-1).cast("bigint").alias("pos"), F.col("body").alias("part")
    )
    first = secs.filter(F.col("sec_no") > 0).groupBy("doc_id", "title").agg(F.min_by("body", "sec_no").alias("body"))
    items = plan.filter(F.col("mode") != "skip").join(first, ["doc_id", "title"], "left")
    body = (
        F.when(F.col("mode") == "user_provides", F.lit(USER_TEXT))
        .when(F.coalesce("body", F.lit("")) != "", F.col("body"))
        .otherwise(F.lit(FILLER_TEXT))
    )
    parts = items.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("## "), "title", F.lit("\n"), body).alias("part")
    )
    return (
        pre.unionByName(parts)
        .groupBy("doc_id")
        .agg(ordered_text(F.col("pos"), F.col("part"), "\n\n").alias("text"))
    )


def flat_blocks(docs: DataFrame) -> DataFrame:
    """Second grammar: markers must stand at column 0 with a blank after #, no tables, no images."""
    r = T.rstrip(F.col("raw"))
    rows = lines(docs, grouped=True).withColumn("r", r)
    r = F.col("r")
    kind = (
        F.when(F.col("s") == "", "blank")
        .when(r.startswith("# "), "h1")
        .when(r.startswith("## "), "h2")
        .when(r.startswith("### "), "h3")
        .when(r.rlike(T.BULLET_MARK), "li")
        .when(r.rlike(T.ORDERED_MARK), "oli")
        .otherwise("p")
    )
    body = (
        F.when(F.col("kind").isin("h1", "h2", "h3"), F.regexp_replace("r", "^#{1,3} ", ""))
        .when(F.col("kind") == "li", F.regexp_replace("r", T.BULLET_MARK, ""))
        .when(F.col("kind") == "oli", F.regexp_replace("r", T.ORDERED_MARK, ""))
        .otherwise(F.col("s"))
    )
    rows = rows.withColumn("kind", kind).withColumn("body", T.strip(body)).withColumn("level", F.lit(None).cast("int"))
    return _merge_runs(rows, "p").drop("level")


def heading_numbers(headings: DataFrame) -> DataFrame:
    """doc_id, pos, level (1-3), title -> numbered: hierarchical numbers; titles that carry one are kept, uncounted."""
    clean = T.strip(F.col("title"))
    counted = ~clean.rlike(T.NUMBERED_TITLE)
    rows = headings.withColumn("_own", counted)

    def unit(level: int) -> Column:
        return (F.col("_own") & (F.col("level") == level)).cast("int")

    rows = rows.withColumn("_n1", F.sum(unit(1)).over(_upto()))
    w2 = Window.partitionBy("doc_id", "_n1").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n2", F.sum(unit(2)).over(w2))
    w3 = Window.partitionBy("doc_id", "_n1", "_n2").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n3", F.sum(unit(3)).over(w3))
    parts = F.array("_n1", "_n2", "_n3")
    shown = F.filter(F.slice(parts, F.lit(1), F.col("level")), lambda n: n > 0)
    number = F.array_join(F.transform(shown, lambda n: n.cast("string")), ".")
    return rows.select(
        "doc_id", "pos", "level", F.when(F.col("_own"), F.concat(number, F.lit(" "), clean)).otherwise(clean).alias("numbered")
    )


# Fixed value: closing sentence of a restructured document. The opening sentence is a parameter.
CLOSING = "The above content has been organized according to the provided formatting rules."
OPENING = (
    "This report has been compiled from the supplied source material. The sections below preserve the original "
    "information while applying a consistent academic structure."
)


def structured(docs: DataFrame, notes: Column | None = None, opening: str = OPENING) -> DataFrame:
    """doc_id, text: title, optional notes, Introduction, Body (short lines ending in a colon become level-3 headings,
    bullets get one form, paragraph lines are joined), Conclusion."""
    rows = lines(docs, grouped=True).withColumn(
        "kind",
        F.when(F.col("s") == "", "blank")
        .when(
            F.col("s").rlike(rf"^#{{1,3}}{T.WS}+") | ((F.length("s") < 80) & F.col("s").endswith(":")), "heading"
        )
        .when(F.col("s").rlike(T.BULLET_MARK), "bullet")
        .otherwise("paragraph"),
    )
    head = F.rtrim(F.col("s"), F.lit(":"))
    head = F.when(head.startswith("#"), head).otherwise(F.concat(F.lit("### "), head))
    rows = rows.withColumn(
        "body",
        F.when(F.col("kind") == "heading", head)
        .when(F.col("kind") == "bullet", F.concat(F.lit("- "), F.regexp_replace("s", T.BULLET_MARK, "")))
        .otherwise(F.col("s")),
    ).withColumn("level", F.lit(None).cast("int"))
    merged = _merge_runs(rows, "paragraph")
    part = F.when(F.col("kind") == "bullet", F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    body = merged.groupBy("doc_id").agg(ordered_text(F.col("block_no"), part, "\n").alias("_body"))
    note = T.strip(F.coalesce(notes, F.lit(""))) if notes is not None else F.lit("")
    meta = docs.select("doc_id", "title", note.alias("_note"))
    pieces = F.filter(
        F.array(
            F.concat(F.lit("# "), "title", F.lit("\n")),
            F.when(F.col("_note") != "", F.concat(F.lit("## Formatting Notes\n"), "_note", F.lit("\n"))),
            F.lit(f"## Introduction\n{opening}\n"),
            F.lit("## Body"),
            F.col("_body"),
            F.lit(f"## Conclusion\n{CLOSING}"),
        ),
        lambda p: p.isNotNull(),
    )
    return meta.join(body, "doc_id", "left").select("doc_id", F.array_join(pieces, "\n").alias("text"))


def chunks(docs: DataFrame, size: int = 8000) -> DataFrame:
    """doc_id, chunk_no (1-based), total, chunk: fixed-size pieces; empty text gives none."""
    n = F.ceil(F.length("text") / F.lit(size)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(1), n))
    return docs.select("doc_id", "text", n.alias("total"), F.explode(starts).alias("chunk_no")).select(
        "doc_id",
        "chunk_no",
        "total",
        F.col("text").substr((F.col("chunk_no") - 1) * size + 1, F.lit(size)).alias("chunk"),
    )


# Lines that end a cover page.
COVER_CONTAINS = ["project report titled", "bonafide certificate"]
COVER_STARTS = ["declaration", "acknowledgement"]
MONTHS = (
    "JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER"
)
MONTH_YEAR = rf"(?i)\b(?:{MONTHS}){T.WS}+\p{{Nd}}{{4}}\b"
CERTIFIED_TITLE = rf"(?is)project report titled{T.WS}*(.+?){T.WS}*is{T.WS}+the{T.WS}+bonafide"
TITLE_EDGE = " \t\r\n'\"-–—"


def cover_summary(paras: DataFrame) -> DataFrame:
    """doc_id, summary: non-blank paragraphs before the first stop line, or up to and including the first month-year
    line. The cut position is a plain minimum, so a large document is never sorted to find it."""
    rows = paras.withColumn("s", T.strip(F.col("text"))).filter(F.col("s") != "")
    low = F.lower("s")
    stop = low.contains(COVER_CONTAINS[0])
    for m in COVER_CONTAINS[1:]:
        stop = stop | low.contains(m)
    for m in COVER_STARTS:
        stop = stop | low.startswith(m)
    cut = F.when(stop, F.col("pos") * 2).when(F.col("s").rlike(MONTH_YEAR), F.col("pos") * 2 + 1)
    cuts = rows.groupBy("doc_id").agg(F.min(cut).alias("_cut"))
    kept = rows.join(cuts, "doc_id").filter(F.col("_cut").isNull() | (F.col("pos") * 2 < F.col("_cut")))
    return kept.groupBy("doc_id").agg(ordered_text(F.col("pos"), F.col("s"), "\n").alias("summary"))


def certified_title(paras: DataFrame) -> DataFrame:
    """doc_id, title: first non-empty title captured from the certificate sentence."""
    s = T.strip(F.col("text"))
    raw = F.regexp_extract(s, CERTIFIED_TITLE, 1)
    # The replacement character and both dashes count as blanks inside a title.
    flat = F.regexp_replace(F.translate(raw, "�–—", "   "), f"{T.WS}+", " ")
    title = F.btrim(flat, F.lit(TITLE_EDGE))
    return (
        paras.select("doc_id", "pos", title.alias("title"))
        .filter(F.col("title") != "")
        .groupBy("doc_id")
        .agg(F.min_by("title", "pos").alias("title"))
    )
