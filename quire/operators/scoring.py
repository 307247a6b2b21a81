"""Scores and validation reports for generated text.

All per-text signals are narrow expressions. Section word counts are the only part that needs the line windows; they are
gathered to one small map per document and joined on ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import briefs as K

# Messages and weights of the validation report.
PLACEHOLDER = "Content for this required section was not explicitly generated."
EMPTY = "Generated output is empty."
FEW_HEADINGS = "Output has insufficient heading structure (expected at least 3 headings)."
MISSING = "Missing required section heading: "
NO_CONTENT = "Section has no content: "
LONG = "Output contains very long unstructured paragraphs."
HAS_PLACEHOLDER = "Output still contains placeholder section content."
VERY_SHORT = "Document is very short; quality may be limited."
SUGGEST_HEADINGS = "Add markdown headings for all required sections in the requested order."
SUGGEST_EXPAND = "Expand weak sections with concrete details, examples, and evidence."
SUGGEST_SPLIT = "Split long paragraphs into shorter units and use bullets for readability."
SUGGEST_CITE = "Add citation markers aligned with the requested citation style."
SUGGEST_BULLETS = "Use bullet lists for key points where required by the rules."
SUGGEST_REFERENCES = "Add a References section with properly formatted sources."
SUGGEST_DEPTH = "Increase depth and specificity to improve overall report quality."


def _score(penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - penalty.cast("double"))


def heading_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(T.HEADING_LINE))


def formatting_score(text: Column) -> Column:
    penalty = (
        F.when(heading_count(text) < 3, 20).otherwise(0)
        + F.when(T.has_long_paragraph(text), 25).otherwise(0)
        + F.when(T.has_bullets(text), 0).otherwise(5)
    )
    return _score(penalty)


def has_citation(text: Column, style: Column) -> Column:
    return F.when(style == "IEEE", text.rlike(T.CITE_NUMBER)).otherwise(text.rlike(T.CITE_AUTHOR))


def violations(text: Column, *, render: bool = False) -> Column:
    """array<struct<rule,severity,penalty>> for a row with compiled rule columns.

    render=True uses the lighter weights of the rendered-output check, accepts either citation form and leaves out the
    constraint lines.
    """
    weights = {"bullets": 8, "references": 8, "citation": 5} if render else {"bullets": 10, "references": 10, "citation": 6}
    cited = (
        text.rlike(rf"{T.CITE_AUTHOR}|{T.CITE_NUMBER}") if render else has_citation(text, F.col("citation_style"))
    )

    def item(cond: Column, rule: Column, severity: str, points: int) -> Column:
        return F.when(
            cond, F.struct(rule.alias("rule"), F.lit(severity).alias("severity"), F.lit(points).alias("penalty"))
        )

    head = F.array_compact(
        F.array(
            item(F.col("require_bullets") & ~T.has_bullets(text), F.lit("require_bullets"), "medium", weights["bullets"]),
            item(
                F.col("include_references") & ~T.has_references(text), F.lit("include_references"), "medium", weights["references"]
            ),
            item((F.col("citation_style") != "none") & ~cited, F.lit("citation_style"), "low", weights["citation"]),
        )
    )
    if render:
        return head

    def missing(low: Column, lines: str, severity: str, points: int) -> Column:
        return F.transform(
            F.filter(lines, lambda x: ~F.contains(low, F.lower(x))),
            lambda x: F.struct(x.alias("rule"), F.lit(severity).alias("severity"), F.lit(points).alias("penalty")),
        )

    return T.let(
        F.lower(text),
        lambda low: F.concat(head, missing(low, "hard", "high", 12), missing(low, "soft", "low", 3)),
    )


def total_penalty(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, v: acc + v["penalty"])


def check_count() -> Column:
    return 2 + (F.col("citation_style") != "none").cast("int") + F.size("hard") + F.size("soft")


def section_stats(docs: DataFrame) -> DataFrame:
    """doc_id, stats: map section -> struct(words, filled). One entry per distinct heading of a document."""
    bodies = B.section_bodies(docs).select(
        "doc_id", "section", F.struct(T.word_count(F.col("body")).alias("words"), (F.col("body") != "").alias("filled")).alias("v")
    )
    return bodies.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "v"))).alias("stats"))


def missing_sections(docs: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, section: required section names without a heading. required: doc_id, required array."""
    want = required.select("doc_id", F.explode("required").alias("section"))
    have = B.headed_sections(docs).filter(F.col("sec_no") > 0).select("doc_id", F.col("title").alias("section"))
    return want.join(have.distinct(), ["doc_id", "section"], "left_anti")


def minimum_words(name: Column) -> Column:
    return F.when(name == "body", 25).otherwise(15)


def weak_sections(docs: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, section, words, minimum: required sections present but too short."""
    want = required.select("doc_id", F.explode("required").alias("section"))
    have = B.section_bodies(docs).select("doc_id", "section", T.word_count(F.col("body")).alias("words"))
    low = minimum_words(F.col("section"))
    return want.join(have, ["doc_id", "section"]).withColumn("minimum", low).filter(F.col("words") < F.col("minimum"))


def _texts(items: Column, fn) -> Column:
    return F.transform(items, fn)


def report(docs: DataFrame, briefs: DataFrame) -> DataFrame:
    """Composite validation report per document.

    docs: doc_id, brief_id, text. Each document is checked against its own brief; a missing brief means defaults.
    """
    stats = section_stats(docs)
    joined = (
        docs.select("doc_id", "brief_id", F.col("text").alias("doc_text"))
        .join(briefs, "brief_id", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
    )
    rules = K.compile_rules(K.parse(joined, keep=("doc_id", "doc_text")))
    r = rules.join(stats, "doc_id")
    text = F.col("doc_text")
    state = F.transform(
        "required",
        lambda n: F.struct(
            F.initcap(n).alias("name"),
            F.map_contains_key("stats", n).alias("present"),
            F.coalesce(F.try_element_at("stats", n)["words"], F.lit(0)).alias("words"),
            F.coalesce(F.try_element_at("stats", n)["filled"], F.lit(False)).alias("filled"),
            minimum_words(n).alias("minimum"),
        ),
    )
    r = T.settle(
        r,
        ["doc_id", "stats", "doc_text"],
        state=state,
        heading_count=heading_count(text),
        total_words=T.word_count(text),
        long_paragraph=T.has_long_paragraph(text),
        formatting_score=formatting_score(text),
        violations=violations(text),
        artifact_numbers=T.artifact_count(text),
        check_count=check_count(),
    )
    missing = F.transform(F.filter("state", lambda s: ~s["present"]), lambda s: s["name"])
    weak = F.transform(F.filter("state", lambda s: s["present"] & (s["words"] < s["minimum"])), lambda s: s["name"])
    # A missing section is reported twice: as a missing heading and as having no content.
    content_errors = F.transform(
        F.filter("state", lambda s: ~s["filled"] | (s["words"] < s["minimum"])),
        lambda s: F.when(~s["filled"], F.concat(F.lit(NO_CONTENT), s["name"])).otherwise(
            F.format_string("Section too short (%d words): %s (minimum %d)", s["words"], s["name"], s["minimum"])
        ),
    )

    def one(cond: Column, message: str) -> Column:
        return F.when(cond, F.array(F.lit(message))).otherwise(F.array().cast("array<string>"))

    errors = F.concat(
        one(T.strip(text) == "", EMPTY),
        one(F.col("heading_count") < 3, FEW_HEADINGS),
        F.transform("missing", lambda n: F.concat(F.lit(MISSING), n)),
        content_errors,
        one(F.col("long_paragraph"), LONG),
        one(text.contains(PLACEHOLDER), HAS_PLACEHOLDER),
    )
    r = T.settle(r, r.columns, missing=missing, weak=weak)
    r = T.settle(r, r.columns, errors=errors, warnings=one(F.col("total_words") < 180, VERY_SHORT))
    penalty = total_penalty(F.col("violations"))
    structure = _score(
        18 * F.size("missing") + 10 * F.size("weak") + F.when(F.col("long_paragraph"), 12).otherwise(0)
    )
    r = r.select(
        "*",
        penalty.alias("penalty"),
        structure.alias("structure_score"),
        _score(penalty).alias("rule_score"),
        _score(18 * F.size("errors") + 4 * F.size("warnings")).alias("quality_score"),
        (F.size("stats") - 1).alias("detected_sections"),
    )

    def dec(c: str) -> Column:
        return F.col(c).cast("decimal(12,2)")

    # The compliance penalty counts twice on purpose: inside the rule score and again here.
    enhanced = F.greatest(
        F.lit(0).cast("decimal(20,4)"),
        dec("structure_score") * F.lit("0.45").cast("decimal(4,2)")
        + dec("formatting_score") * F.lit("0.25").cast("decimal(4,2)")
        + dec("rule_score") * F.lit("0.30").cast("decimal(4,2)")
        - F.col("penalty"),
    )
    return r.select(
        "*",
        F.round(enhanced, 2).cast("double").alias("enhanced_score"),
        F.array_sort(F.array_union("missing", "weak")).alias("weak_sections"),
        (F.size("errors") == 0).alias("ok"),
    ).withColumn("suggestions", suggestions())


def suggestions() -> Column:
    """At most six hints in fixed order, from errors, warnings and violations."""

    def err(part: str) -> Column:
        return F.exists("errors", lambda e: F.contains(F.lower(e), F.lit(part)))

    def broke(rule: str) -> Column:
        return F.exists("violations", lambda v: v["rule"] == rule)

    hints = F.array_compact(
        F.array(
            F.when(err("missing required section heading"), SUGGEST_HEADINGS),
            F.when(err("section too short"), SUGGEST_EXPAND),
            F.when(err("very long unstructured paragraphs"), SUGGEST_SPLIT),
            F.when(broke("citation_style"), SUGGEST_CITE),
            F.when(broke("require_bullets"), SUGGEST_BULLETS),
            F.when(broke("include_references"), SUGGEST_REFERENCES),
        )
    )
    fallback = F.when(F.size("warnings") > 0, F.array(F.lit(SUGGEST_DEPTH))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.when(F.size(hints) > 0, hints).otherwise(fallback), 1, 6)


def correction_buckets() -> dict[str, Column]:
    """Issue texts sorted into four yes/no buckets."""
    issues = F.concat("errors", "warnings")

    def has(*parts: str) -> Column:
        return F.exists(issues, lambda i: K._any(F.lower(i), list(parts)))

    return {
        "missing_headings": has("missing required section heading"),
        "poor_structure": has("section too short", "insufficient heading", "very long"),
        "formatting_inconsistencies": has("paragraph", "placeholder", "heading"),
        "rule_violations": F.size("violations") > 0,
    }


def candidate_score(text: Column) -> Column:
    """Heuristic quality of a candidate text; exact decimal arithmetic."""
    tokens = T.let(
        F.lower(text),
        lambda low: F.when(F.contains(low, F.lit("introduction")), 25).otherwise(0)
        + F.when(F.contains(low, F.lit("body")), 20).otherwise(0)
        + F.when(F.contains(low, F.lit("conclusion")), 25).otherwise(0),
    )
    heads = F.least(heading_count(text) * 4, F.lit(20))
    bullets = F.regexp_count(text, F.lit(rf"(?md)^{T.WS}*[-*]{T.WS}+"))
    half_points = F.least(bullets * 15, F.lit(100)).cast("decimal(12,3)") / 10
    size = F.least(F.length(text).cast("decimal(12,3)") / 200, F.lit(20).cast("decimal(12,3)"))
    short = F.when(F.length(text) < 300, 20).otherwise(0)
    return F.round(tokens + heads + half_points + size - short, 3).cast("double")


def best_candidate(cands: DataFrame) -> DataFrame:
    """item, name, score: top candidate; a tie goes to the lowest rank. Partial max, so no ranking window."""
    scored = cands.withColumn("score", candidate_score(F.col("text")))
    return scored.groupBy("item").agg(
        F.max_by("name", F.struct("score", -F.col("rank"))).alias("name"), F.max("score").alias("score")
    )


def first_usable(cands: DataFrame, fallback: str = "rule_based") -> DataFrame:
    """item, name: first candidate with text in fixed order, else the fallback."""
    usable = F.when(T.strip(F.coalesce("text", F.lit(""))) != "", F.col("rank"))
    return cands.groupBy("item").agg(F.coalesce(F.min_by("name", usable), F.lit(fallback)).alias("name"))
