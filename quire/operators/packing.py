"""Block streams into fixed-capacity pages, and checks on the result.

Placements: capacity, doc_id, pos, kind, page, line_start, line_end, est_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let

# Line costs, page capacities and acceptance thresholds.
LIST_WIDTH, TEXT_WIDTH = 70, 90
CAPACITY = {"single": 48, "1.5": 38, "double": 30}
MAX_CAPACITY = 60
MIN_SIMILARITY, MAX_ISSUES, MAX_WARNINGS = 95.0, 0, 0


def block_cost(kind: Column, text: Column) -> Column:
    """Estimated lines of a block."""

    def wrap(width: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(width)).cast("int"))

    return (
        F.when(kind.isin("heading", "document"), 2)
        .when(kind.isin("list_item", "ordered_list_item"), wrap(LIST_WIDTH))
        .when(kind == "table_row", 1)
        .when(kind == "image", 10)
        .otherwise(wrap(TEXT_WIDTH))
    )


def minimum_capacity(target_pages: Column) -> Column:
    return F.when(target_pages >= 120, 8).when(target_pages >= 60, 12).otherwise(20)


def capacity(total_lines: Column, target_pages: Column, line_spacing: Column) -> Column:
    base = F.when(line_spacing == "double", 30).when(line_spacing == "1.5", 38).otherwise(48)
    tuned = F.greatest(
        minimum_capacity(target_pages), F.least(F.lit(MAX_CAPACITY), F.ceil(total_lines / target_pages).cast("int"))
    )
    return F.when((target_pages > 0) & (total_lines > 0), tuned).otherwise(base)


def block_items() -> Column:
    """Aggregate: a document's blocks in order as array<struct(pos, kind, cost)>."""
    item = F.struct(F.col("block_no").alias("pos"), "kind", block_cost(F.col("kind"), F.col("text")).alias("cost"))
    return F.array_sort(F.collect_list(item))


def _opens(cursor: Column, cost: Column, cap: Column) -> Column:
    """Whether a block at ``cursor`` opens the next page."""
    return cursor + cost > cap


def page_slices(items: Column, cap: Column, cursor: Column | None = None) -> Column:
    """One array of items per page; only the first may be empty, when its first block does not fit.

    The recurrence resets at every page, so it is a fold over one cost array that only records where pages begin. ``cursor``
    is the line of the first page where the items begin (default: its top).
    """

    def starts(items: Column) -> Column:
        zero = F.struct(
            (F.lit(0) if cursor is None else cursor).alias("cursor"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts")
        )

        def step(acc: Column, x: Column) -> Column:
            full = _opens(acc["cursor"], x["cost"], cap)
            return F.struct(
                F.when(full, x["cost"]).otherwise(acc["cursor"] + x["cost"]).alias("cursor"),
                (acc["i"] + 1).alias("i"),
                F.when(full, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            )

        return F.concat(F.array(F.lit(0)), F.aggregate(items, zero, step)["starts"], F.array(F.size(items)))

    def pages(items: Column) -> Column:
        return let(
            starts(items),
            lambda b: F.transform(
                F.sequence(F.lit(1), F.size(b) - 1),
                lambda k: F.slice(items, F.element_at(b, k) + 1, F.element_at(b, k + 1) - F.element_at(b, k)),
            ),
        )

    return let(items, pages)


def page_profiles(items: Column, cap: Column) -> Column:
    """array<struct(page, lines, headings, paragraphs, lists, blocks)>: ``page_profile`` of one document without a shuffle."""

    def profile(on_page: Column, k: Column) -> Column:
        def count(*kinds: str) -> Column:
            return F.size(F.filter(on_page, lambda x: x["kind"].isin(*kinds))).cast("long")

        return F.struct(
            (k + 1).alias("page"),
            F.aggregate(on_page, F.lit(0).cast("long"), lambda acc, x: acc + x["cost"]).alias("lines"),
            count("heading").alias("headings"),
            count("paragraph").alias("paragraphs"),
            count("list_item", "ordered_list_item").alias("lists"),
            F.size(on_page).cast("long").alias("blocks"),
        )

    return F.filter(F.transform(page_slices(items, cap), profile), lambda p: p["blocks"] > 0)


#: Blocks of a document that are folded in one place.
SEGMENT = 4096


def _passages(items: Column, cap: Column, first: Column) -> Column:
    """array<struct(pages, cursor)>: for each start cursor, the pages a segment opens and the cursor it ends at.

    A full page is the same whatever overfills it, so cursors end at the capacity: the table has capacity + 1 entries, or
    one where ``first`` says that the segment can only begin at the top of page 1.
    """

    def run(start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            full = _opens(acc["cursor"], x["cost"], cap)
            end = F.least(cap, F.when(full, x["cost"]).otherwise(acc["cursor"] + x["cost"]))
            return F.struct((acc["pages"] + full.cast("int")).alias("pages"), F.greatest(F.lit(0), end).alias("cursor"))

        return F.aggregate(items, F.struct(F.lit(0).alias("pages"), start.alias("cursor")), step)

    return F.transform(F.sequence(F.lit(0), F.when(first, 0).otherwise(F.greatest(cap, F.lit(0)))), run)


def _segment_starts(segments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, _seg, _start (pages, cursor): where the segments after a document's first begin.

    One small table per segment is combined in order; a document within one segment has no row here.
    """
    table = F.struct("_seg", _passages(F.col("items"), F.col("_cap"), F.col("_seg") == 0).alias("table"))
    docs = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(table)).alias("parts")).where(F.size("parts") > 1)
    top = F.struct(F.lit(0).alias("pages"), F.lit(0).alias("cursor"))
    zero = F.struct(top.alias("at"), F.array().cast("array<struct<pages:int,cursor:int>>").alias("starts"))

    def step(acc: Column, part: Column) -> Column:
        through = F.get(part["table"], acc["at"]["cursor"])
        after = F.struct((acc["at"]["pages"] + through["pages"]).alias("pages"), through["cursor"].alias("cursor"))
        return F.struct(after.alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    starts = F.arrays_zip(F.col("parts._seg").alias("_seg"), F.aggregate("parts", zero, step)["starts"].alias("_start"))
    return docs.select(*keys, F.inline(starts).alias("_seg", "_start"))


def pack(blocks: DataFrame, cap: Column, keys: tuple[str, ...] = ("doc_id",), segment: int = SEGMENT) -> DataFrame:
    """Sequential packing: a block that does not fit opens the next page, even on an empty page.

    A document is cut by position into segments that are packed by themselves, each from the page and line where the one
    before it ends; these follow from tables of what every segment does from any start line, which are combined per document.
    So a document of any number of blocks is spread over tasks, and no array holds more than ``segment`` blocks. Offsets
    inside a page are summed over that page's few blocks. ``cap`` may use the key columns and constants; it and the keys are
    not null.
    """
    seg = F.floor(F.col("block_no") / F.lit(segment)).cast("int")
    segments = blocks.groupBy(*keys, seg.alias("_seg")).agg(block_items().alias("items")).withColumn("_cap", cap)
    segments = segments.repartition(*keys, "_seg")  # read twice below, moved once
    rows = segments.join(_segment_starts(segments, keys), [*keys, "_seg"], "left")
    page, cursor = (F.coalesce(F.col(f"_start.{x}"), F.lit(0)) for x in ("pages", "cursor"))
    rows = rows.select(*keys, page.alias("_page"), cursor.alias("_cursor"), "_cap", "items")
    slices = page_slices(F.col("items"), F.col("_cap"), F.col("_cursor"))
    paged = rows.select(*keys, "_page", "_cursor", F.posexplode(slices).alias("_k", "on_page"))
    top = F.when(F.col("_k") == 0, F.col("_cursor")).otherwise(0)
    return _placed(paged.select(*keys, (F.col("_page") + F.col("_k") + 1).alias("page"), top.alias("top"), "on_page"), keys)


def _placed(pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Placements of pages (or their parts from line ``top`` on) given as arrays of blocks in order."""

    def before(i: Column) -> Column:
        return F.aggregate(F.slice("on_page", F.lit(1), i), F.col("top"), lambda acc, x: acc + x["cost"])

    placed = pages.select(
        *keys, "page", F.explode(F.transform("on_page", lambda x, i: F.struct(x.alias("x"), before(i).alias("line_start")))).alias("p")
    )
    return placed.select(
        *keys,
        F.col("p.x.pos").alias("pos"),
        F.col("p.x.kind").alias("kind"),
        "page",
        F.col("p.line_start").alias("line_start"),
        (F.col("p.line_start") + F.col("p.x.cost")).alias("line_end"),
        F.col("p.x.cost").alias("est_lines"),
    )


_KEYS = ("capacity", "doc_id")


def overflows(placements: DataFrame) -> DataFrame:
    return placements.filter(F.col("line_end") > F.col("capacity"))


def orphans(placements: DataFrame) -> DataFrame:
    """capacity, doc_id, page, pos: pages whose last block is a heading."""
    last = placements.groupBy(*_KEYS, "page").agg(F.max_by(F.struct("kind", "pos"), "line_start").alias("last"))
    return last.filter(F.col("last.kind") == "heading").select(*_KEYS, "page", F.col("last.pos").alias("pos"))


def packing_score(placements: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Issues, warnings, score and acceptance per packed document."""
    t = {"min_similarity": MIN_SIMILARITY, "max_issues": MAX_ISSUES, "max_warnings": MAX_WARNINGS, **(thresholds or {})}
    pages = placements.groupBy(*_KEYS, "page").agg(
        F.max_by("kind", "line_start").alias("last_kind"), F.count_if(F.col("line_end") > F.col("capacity")).alias("over")
    )
    docs = pages.groupBy(*_KEYS).agg(
        F.sum("over").alias("issues"), F.count_if(F.col("last_kind") == "heading").alias("warnings")
    )
    score = F.greatest(F.lit(0.0), F.lit(100.0) - 15 * F.col("issues") - 4 * F.col("warnings"))
    return docs.withColumn("score", score).withColumn(
        "accepted",
        (F.col("score") >= t["min_similarity"])
        & (F.col("issues") <= t["max_issues"])
        & (F.col("warnings") <= t["max_warnings"]),
    )


def renormalise(placements: DataFrame) -> DataFrame:
    """Offsets recomputed inside every page in block order."""
    w = Window.partitionBy(*_KEYS, "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("est_lines").over(w).cast("int")
    return placements.withColumn("line_end", end).withColumn("line_start", F.col("line_end") - F.col("est_lines"))


def _whole_pages(placements: DataFrame) -> DataFrame:
    """capacity, doc_id, page, on_page: one row per page with its blocks from top to bottom."""
    block = F.struct(F.col("line_start").alias("at"), "pos", "kind", F.col("est_lines").alias("cost"))
    return placements.groupBy(*_KEYS, "page").agg(F.array_sort(F.collect_list(block)).alias("on_page"))


def _shifted(pages: DataFrame) -> DataFrame:
    """One orphan shift on ``_whole_pages``.

    A page holds no more blocks than lines, so pages are rows of bounded size and the largest thing that is grouped. The
    heading's follower is on the page after it, or before it where an earlier shift left the heading behind the rest.
    """
    last = F.element_at("on_page", -1)
    heading = F.when(last["kind"] == "heading", F.struct("page", last["pos"].alias("pos")))
    end = F.max(F.array_max(F.transform("on_page", lambda x: x["pos"]))).alias("_end")
    docs = pages.groupBy(*_KEYS).agg(end, F.min(heading).alias("_low"), F.max(heading).alias("_high"))
    # The last block is no orphan; at most one page, left by an earlier shift, is behind the page that holds it.
    orphan = docs.withColumn("_h", F.when(F.col("_low.pos") < F.col("_end"), F.col("_low")).when(F.col("_high.pos") < F.col("_end"), F.col("_high")))
    orphan = orphan.where("_h is not null")
    page, pos = F.col("_h.page"), F.col("_h.pos")
    leaves = [F.struct(at.alias("page"), F.array(*who).alias("_leaves")) for at, who in ((page, [pos, pos + 1]), (page - 1, [pos + 1]), (page + 1, [pos + 1]))]
    hits = orphan.select(*_KEYS, F.inline(F.array(*leaves)))
    rows = pages.join(hits, [*_KEYS, "page"], "left")
    leaving = lambda x: F.coalesce(F.array_contains("_leaves", x["pos"]), F.lit(False))
    stay = F.struct("page", F.filter("on_page", lambda x: ~leaving(x)).alias("on_page"))
    go = F.struct((F.col("page") + 1).alias("page"), F.filter("on_page", leaving).alias("on_page"))
    parts = rows.select(*_KEYS, F.inline(F.filter(F.array(stay, go), lambda p: F.size(p["on_page"]) > 0)))
    merged = parts.groupBy(*_KEYS, "page").agg(F.flatten(F.collect_list("on_page")).alias("on_page"))
    ordered = F.array_sort(F.transform("on_page", lambda x: F.struct(x["pos"].alias("at"), x["pos"].alias("pos"), x["kind"].alias("kind"), x["cost"].alias("cost"))))
    return merged.withColumn("on_page", ordered)


def shift_first_orphan(placements: DataFrame) -> DataFrame:
    """One repair pass over a packing: the first orphan heading that has a follower moves one page on together with it."""
    return _placed(_shifted(_whole_pages(placements)).withColumn("top", F.lit(0)), _KEYS)


def repair(placements: DataFrame) -> DataFrame:
    """Two fixed passes of the orphan shift."""
    return _placed(_shifted(_shifted(_whole_pages(placements))).withColumn("top", F.lit(0)), _KEYS)


def page_profile(placements: DataFrame) -> DataFrame:
    """Expected lines and kind counts per page."""
    k = F.col("kind")
    return placements.groupBy(*_KEYS, "page").agg(
        F.sum("est_lines").alias("lines"),
        F.count_if(k == "heading").alias("headings"),
        F.count_if(k == "paragraph").alias("paragraphs"),
        F.count_if(k.isin("list_item", "ordered_list_item")).alias("lists"),
        F.count("*").alias("blocks"),
    )


def page_class() -> Column:
    """heading_heavy, list_heavy, text_heavy or mixed, by shares on a page profile row."""
    total = F.col("headings") + F.col("paragraphs") + F.col("lists")
    return (
        F.when(total == 0, "mixed")
        .when(F.col("headings") * 2 >= total, "heading_heavy")
        .when(F.col("lists") * 2 >= total, "list_heavy")
        .when(F.col("paragraphs") * 10 >= total * 6, "text_heavy")
        .otherwise("mixed")
    )


def class_threshold(cls: Column) -> Column:
    return F.when(cls == "heading_heavy", 60.0).when(cls == "list_heavy", 62.0).when(cls == "text_heavy", 70.0).otherwise(65.0)


def capacity_advice(profiles: DataFrame, minimum: int = 20) -> DataFrame:
    """capacity, doc_id, attempt 1-3, advised: reduction by the shares of page classes and the attempt number."""
    c = page_class()
    docs = profiles.groupBy(*_KEYS).agg(
        F.count_if(c == "heading_heavy").alias("h"),
        F.count_if(c == "list_heavy").alias("l"),
        F.count_if(c == "text_heavy").alias("t"),
        F.count("*").alias("n"),
    )
    tries = docs.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))

    def half(name: str) -> Column:
        return F.col(name) * 2 >= F.col("n")

    gentle = F.when(half("t"), 3).when(half("l"), 1).when(half("h"), 1).otherwise(2)
    moderate = F.when(half("t"), 5).when(half("h"), 3).when(half("l"), 2).otherwise(4)
    cut = F.when(F.col("attempt") == 1, gentle).when(F.col("attempt") == 2, moderate).otherwise(6)
    advised = F.when(F.col("n") == 0, F.greatest(F.lit(20), F.col("capacity") - 2)).otherwise(
        F.greatest(F.lit(minimum), F.col("capacity") - cut)
    )
    return tries.select(*_KEYS, "attempt", advised.alias("advised"))


# Acceptance profiles of the rendered-output check and the long-document overrides.
PROFILES = {
    "strict": (88.0, 0.75, 68.0, 65.0, 0.0, True),
    "balanced": (85.0, 0.68, 35.0, 35.0, 0.5, True),
    "high_range": (82.0, 0.6, 20.0, 20.0, 0.85, False),
}
LONG_PROFILE = (84.0, 0.7, 40.0, 45.0, 0.5, False)
THRESHOLD_FIELDS = ("min_similarity", "min_heading_ratio", "min_visual", "min_page_visual", "max_failed_ratio", "hard_gate")


def thresholds(docs: DataFrame, overrides: dict[str, Column] | None = None) -> DataFrame:
    """docs: ..., expected_pages, target_pages, profile. Adds the profile's thresholds, overridden for long documents and
    then by a document's own rules (``overrides``: field -> column, null keeps the profile), and the tolerated page-count
    difference."""
    own = overrides or {}
    long_form = (F.col("expected_pages") >= 30) | (F.col("target_pages") >= 30)
    very_long = (F.col("expected_pages") >= 60) | (F.col("target_pages") >= 60)

    def field(i: int) -> Column:
        by_profile = F.when(F.col("profile") == "high_range", PROFILES["high_range"][i]).when(
            F.col("profile") == "balanced", PROFILES["balanced"][i]
        ).otherwise(PROFILES["strict"][i])
        value = F.when(long_form, LONG_PROFILE[i]).otherwise(by_profile)
        name = THRESHOLD_FIELDS[i]
        return F.coalesce(own[name], value) if name in own else value

    def share(x: str) -> Column:
        return F.bround(F.col("expected_pages").cast("decimal(12,4)") * F.lit(x).cast("decimal(4,2)"), 0).cast("int")

    tolerance = (
        F.when(F.col("expected_pages") <= 0, 0)
        .when(F.col("profile") == "high_range", F.greatest(F.lit(3), share("0.75")))
        .when(very_long, F.greatest(F.lit(8), share("0.20")))
        .when(long_form, F.greatest(F.lit(4), share("0.15")))
        .otherwise(0)
    )
    return docs.select(
        "*",
        long_form.alias("long_form"),
        *[field(i).alias(n) for i, n in enumerate(THRESHOLD_FIELDS)],
        tolerance.alias("page_tolerance"),
    )


def page_labels(pages: DataFrame) -> DataFrame:
    """pages: page, has_cover, has_prelim, prelim_format, body_format, plain_format -> label (null: no number).

    With a cover the first page has none; with preliminaries the second is number 1 in their format and the body starts
    after it.
    """
    from quire.functions.text import page_label

    n = F.col("page")
    cover, prelim = F.col("has_cover"), F.col("has_prelim")
    label = (
        F.when(cover & (n == 1), F.lit(None).cast("string"))
        .when(cover & prelim & (n == 2), page_label(F.lit(1), F.col("prelim_format")))
        .when(cover & prelim, page_label(n - 2, F.col("body_format")))
        .when(cover, page_label(n - 1, F.col("body_format")))
        .otherwise(page_label(n, F.col("plain_format")))
    )
    return pages.withColumn("label", label)


# Text metrics: heights and calibration


def chars_per_line(column_width_pt: Column, advance_units: Column, units_per_em: Column, size_pt: Column) -> Column:
    """Calibrated characters per line, at least 10."""
    avg = F.round(
        advance_units.cast("decimal(18,6)") / units_per_em.cast("decimal(18,6)") * size_pt.cast("decimal(10,4)"), 4
    ).cast("decimal(18,4)")
    width = F.greatest(avg, F.lit("0.0001").cast("decimal(18,4)"))
    return F.greatest(F.lit(10), F.floor(column_width_pt.cast("decimal(18,4)") / width).cast("int"))


def paragraph_height(length: Column, chars: Column, line_height: Column, spacing: Column, extra: Column) -> Column:
    """Height in points: lines x line height x spacing plus the space around it."""
    lines = F.greatest(F.lit(1), F.ceil(length / F.greatest(F.lit(1), chars)).cast("int"))
    return lines * line_height.cast("decimal(12,4)") * spacing.cast("decimal(6,2)") + extra.cast("decimal(12,4)")


def nearest_widths(wanted: DataFrame, calibrated: DataFrame) -> DataFrame:
    """For every row of ``wanted`` (style, width) the value of the nearest calibrated width of the style; ties take the
    narrower one, and a style without any calibration gives null.

    Both sides are first reduced to their distinct widths, so the sorted search runs over the width domain, not the
    data; the result goes back by an equi join.
    """
    points = calibrated.groupBy("style", "width").agg(F.min("value").alias("value"))
    asked = wanted.select("style", "width").distinct()
    at = F.struct("width", "value")
    line = asked.select("style", "width", F.lit(None).cast("struct<width:int,value:int>").alias("p"), F.lit(1).alias("side")).unionByName(
        points.select("style", "width", at.alias("p"), F.lit(0).alias("side"))
    )
    w = Window.partitionBy("style").orderBy("width", "side")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    found = line.select(
        "style",
        "width",
        "side",
        F.last("p", ignorenulls=True).over(back).alias("lo"),
        F.first("p", ignorenulls=True).over(ahead).alias("hi"),
    ).filter(F.col("side") == 1)
    use_lo = F.col("hi").isNull() | (
        F.col("lo").isNotNull() & (F.col("width") - F.col("lo.width") <= F.col("hi.width") - F.col("width"))
    )
    picked = found.select("style", "width", F.when(use_lo, F.col("lo")).otherwise(F.col("hi")).alias("p"))
    return wanted.join(
        picked.select("style", "width", F.col("p.width").alias("nearest"), F.col("p.value").alias("value")),
        ["style", "width"],
    )


def acceptance(j: DataFrame, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """Acceptance gate: thresholds, sim_a, sim_b, ratio, average_score, pages, failed_pages, placed, rendered_blocks and
    penalty on one row per packed document."""

    def dec(c: Column) -> Column:
        return c.cast("decimal(12,2)")

    def num(x: str) -> Column:
        return F.lit(x).cast("decimal(6,2)")

    sim = F.least(
        dec(F.lit(100)), F.round(dec(F.col("sim_a")) * num("0.45") + dec(F.col("sim_b")) * num("0.45") + 10, 2)
    ).cast("decimal(12,2)")
    r = j.select(
        "*",
        sim.alias("sim"),
        dec(F.col("ratio")).alias("hr"),
        dec(F.coalesce("average_score", F.lit(0.0))).alias("visual"),
        F.coalesce("pages", F.lit(0)).alias("n_pages"),
        F.coalesce("failed_pages", F.lit(0)).alias("failed"),
    )
    r = r.select(
        "*",
        ((F.col("expected_pages") == 0) | (F.abs(F.col("n_pages") - F.col("expected_pages")) <= F.col("page_tolerance"))).alias(
            "pages_ok"
        ),
        (F.col("placed") <= F.greatest(F.col("rendered_blocks"), F.lit(1)) + 4).alias("blocks_ok"),
        F.round(F.col("failed").cast("decimal(18,6)") / F.greatest(F.lit(1), F.col("n_pages")), 3)
        .cast("double")
        .alias("failed_ratio"),
    )
    soft = ~F.col("hard_gate")
    sim_ok = F.col("sim") >= F.col("min_similarity")
    head_ok = F.col("hr") >= F.col("min_heading_ratio")
    visual_ok = F.col("visual") >= F.col("min_visual")
    accepted = (
        sim_ok
        & head_ok
        & (visual_ok | soft)
        & ((F.col("failed") == 0) | (F.col("failed_ratio") <= F.col("max_failed_ratio")) | soft)
        & F.col("pages_ok")
        & F.col("blocks_ok")
        & (F.col("penalty") == 0)
    )
    issues = F.concat_ws(
        "|",
        F.when(~sim_ok, "similarity"),
        F.when(~head_ok, "headings"),
        F.when(F.col("failed") > 0, "failed_pages"),
        F.when(~visual_ok, "visual"),
        F.when(~F.col("pages_ok"), "page_count"),
        F.when(~F.col("blocks_ok"), "block_count"),
        F.when(F.col("penalty") > 0, "rules"),
    )
    structure = F.least(dec(F.lit(100)), F.col("hr") * 70 + F.when(F.col("pages_ok"), 30).otherwise(0))
    drawn = F.col("visual") * num("0.6") + F.col("sim") * num("0.4") - F.when(F.col("blocks_ok"), 0).otherwise(10)
    formatting = F.round(F.greatest(dec(F.lit(0)), F.least(dec(F.lit(100)), drawn)), 2)
    r = r.select(
        "*", accepted.alias("accepted"), issues.alias("issues"), structure.alias("s"), formatting.alias("f")
    )
    rule = F.greatest(F.lit(0), 100 - F.col("penalty"))
    total = F.col("s") * num("0.4") + F.col("f") * num("0.35") + rule * num("0.25") - F.col("penalty")
    return r.select(
        *keys,
        F.col("sim").cast("double").alias("similarity"),
        F.col("hr").cast("double").alias("heading_ratio"),
        F.col("visual").cast("double").alias("visual"),
        "failed_ratio",
        "pages_ok",
        "blocks_ok",
        "accepted",
        "issues",
        F.col("s").cast("double").alias("structure_score"),
        F.col("f").cast("double").alias("formatting_score"),
        F.round(F.greatest(dec(F.lit(0)), total), 2).cast("double").alias("score"),
    )
