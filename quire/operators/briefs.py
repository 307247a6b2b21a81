"""Free-text rule briefs: parse, resolve conflicts, compile, and digest.

A brief is one text cell, so every operator is a narrow projection: dictionaries are literal arrays evaluated per row
instead of a theta join, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Section vocabulary and defaults.
SECTION_WORDS = ["introduction", "background", "methodology", "analysis", "discussion", "results", "conclusion", "references"]
CORE = ["introduction", "body", "conclusion"]
HARD_WORDS = ["must", "required", "always", "do not", "never"]
SOFT_WORDS = ["should", "prefer", "ideally", "recommended"]
NUMBERED = rf"^(\p{{Nd}}+(?:\.\p{{Nd}}+)*){T.WS}*[-.)]?{T.WS}+(.+)$"
PAGES = rf"(?:up{T.WS}*to|max(?:imum)?|around|about)?{T.WS}*(\p{{Nd}}{{1,3}}){T.WS}*pages?"
MARKS = " -\t"

# Tokens per field in dictionary order; the last occurrence in the text decides.
TOKENS = {
    "alignment": [
        ("left align", "left"),
        ("left-aligned", "left"),
        ("justify", "justified"),
        ("justified", "justified"),
        ("center", "center"),
        ("centered", "center"),
        ("centred", "center"),
    ],
    "line_spacing": [
        ("single spacing", "single"),
        ("double spacing", "double"),
        ("double-spaced", "double"),
        ("1.5 spacing", "1.5"),
        ("one and a half", "1.5"),
    ],
    "citation_style": [("apa", "APA"), ("mla", "MLA"), ("harvard", "Harvard"), ("ieee", "IEEE")],
    "require_bullets": [("no bullet", "no"), ("avoid bullet", "no"), ("use bullet", "yes"), ("bullet points", "yes")],
}

CONFLICT_SPACING = "Conflicting line spacing instructions: single and double."
CONFLICT_ALIGN = "Conflicting alignment instructions: left and justified."
CONFLICT_BULLETS = "Conflicting list instructions: bullets required and prohibited."
AMBIGUOUS_SECTIONS = "Sections are not clearly specified; defaults may be applied."
AMBIGUOUS_EMPTY = "No rules provided; standard academic defaults will be applied."


def _any(low: Column, words: list[str]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def _outline_entry(s: Column) -> Column:
    """struct(level, title) of a heading line, else null."""
    level = F.length(F.regexp_extract(s, "^(#{1,3}) ", 1))
    token = F.regexp_extract(s, NUMBERED, 1)
    depth = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit(""))) + 1
    return F.when(
        level > 0, F.struct(level.alias("level"), T.strip(F.regexp_replace(s, "^#{1,3} ", "")).alias("title"))
    ).when(
        s.rlike(NUMBERED),
        F.struct(F.least(depth, F.lit(4)).alias("level"), T.strip(F.regexp_extract(s, NUMBERED, 2)).alias("title")),
    )


def outline(lines: Column) -> Column:
    return F.array_compact(F.transform(lines, lambda line: _outline_entry(T.strip(line))))


def formatting(low: Column) -> dict[str, Column]:
    """Formatting preferences by fixed precedence."""
    return {
        "citation_seen": F.when(low.contains("apa"), "APA")
        .when(low.contains("mla"), "MLA")
        .when(low.contains("harvard"), "Harvard")
        .when(low.contains("ieee"), "IEEE")
        .otherwise("none"),
        "alignment_seen": F.when(_any(low, ["justify", "justified"]), "justified")
        .when(_any(low, ["left align", "left-aligned"]), "left")
        .when(_any(low, ["center", "centred", "centered"]), "center")
        .otherwise("unspecified"),
        "spacing_seen": F.when(_any(low, ["double spacing", "double-spaced"]), "double")
        .when(_any(low, ["1.5", "one and a half"]), "1.5")
        .otherwise("single"),
        "require_bullets": _any(low, ["bullet", "list", "points"]),
        "require_numbering": _any(low, ["numbered", "1.", "2.", "section numbering"]),
        "heading_numbering": _any(low, ["numbered heading", "numbered headings", "section numbering"]),
        "tone": F.when(_any(low, ["formal", "academic"]), "formal").otherwise("unspecified"),
        "paragraph_spacing": F.when(low.contains("paragraph spacing") & low.contains("extra"), "wide").otherwise("normal"),
        "font_family": F.when(low.contains("times new roman"), "Times New Roman").otherwise("unspecified"),
    }


def required_sections(low: Column) -> Column:
    """Canonical section names: core order first, extras sorted. Outline titles are part of the text, so one test does."""
    found = F.filter(F.array(*[F.lit(w) for w in SECTION_WORDS]), lambda w: F.contains(low, w))
    core = F.array(*[F.lit(w) for w in CORE])
    extras = F.array_sort(F.array_except(found, core))
    return F.when((F.size(found) == 0), core).when(F.arrays_overlap(found, core), F.concat(core, extras)).otherwise(extras)


def _graded(line: Column) -> Column:
    """struct(text, grade) of a line with its list marks removed: hard, soft or plain; hard wins."""
    text = F.btrim(T.rstrip(line), F.lit(MARKS))
    return T.let(
        text,
        lambda t: T.let(
            F.lower(t),
            lambda low: F.struct(
                t.alias("text"),
                F.when(t == "", "plain")
                .when(_any(low, HARD_WORDS), "hard")
                .when(_any(low, SOFT_WORDS), "soft")
                .otherwise("plain")
                .alias("grade"),
            ),
        ),
    )


def parse(briefs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns are passed through. Adds brief_id, raw, headings, required, formatting and structural fields, hard, soft, instructions, conflicts,
    ambiguities."""
    ids = ["brief_id", *keep]
    base = T.settle(briefs, ids, raw=T.strip(F.coalesce("text", F.lit(""))))
    base = T.settle(base, [*ids, "raw"], low=F.lower("raw"))
    low = F.col("low")
    # Plain projections: each is read more than once, so it is not inlined, and a job that reads none of it drops it.
    base = base.select("*", T.split_lines(F.col("raw")).alias("_lines"))
    base = base.select(
        *ids,
        "raw",
        "low",
        "_lines",
        outline(F.col("_lines")).alias("headings"),
        required_sections(low).alias("required"),
        F.transform("_lines", _graded).alias("_graded"),
    )

    def graded(grade: str) -> Column:
        return F.transform(F.filter("_graded", lambda g: g["grade"] == grade), lambda g: g["text"])

    levels = F.transform("headings", lambda h: h["level"])
    pages = F.coalesce(F.regexp_extract(low, PAGES, 1).try_cast("int"), F.lit(0))
    words = F.when(low.contains("long"), 1500).when(low.contains("medium"), 800).otherwise(500)
    bullets = _any(low, ["bullet", "list", "points"])
    return base.select(
        "brief_id",
        *keep,
        "raw",
        "low",
        "headings",
        "required",
        *[c.alias(n) for n, c in formatting(low).items()],
        F.coalesce(F.array_max(levels), F.lit(3)).alias("max_heading_depth"),
        pages.alias("target_pages"),
        F.when(pages > 0, F.greatest(words, pages * 300)).otherwise(words).alias("target_words"),
        low.contains("table").alias("prefer_tables"),
        _any(low, ["image", "figure"]).alias("prefer_images"),
        _any(low, ["references", "bibliography"]).alias("include_references"),
        (
            (low.contains("introduction") & low.contains("body") & low.contains("conclusion"))
            | (F.coalesce(F.array_max(levels), F.lit(3)) >= 2)
        ).alias("require_core"),
        graded("hard").alias("hard"),
        graded("soft").alias("soft"),
        F.transform(
            F.filter("_lines", lambda x: (T.strip(x) != "") & ~F.startswith(T.strip(x), F.lit("#"))),
            lambda x: F.btrim(T.rstrip(x), F.lit(MARKS)),
        ).alias("instructions"),
        F.array_compact(
            F.array(
                F.when(low.contains("single spacing") & low.contains("double spacing"), CONFLICT_SPACING),
                F.when(low.contains("left align") & _any(low, ["justify", "justified"]), CONFLICT_ALIGN),
                F.when(low.contains("no bullet") & bullets, CONFLICT_BULLETS),
            )
        ).alias("conflicts"),
        F.array_compact(
            F.array(
                F.when(F.size("required") <= 1, AMBIGUOUS_SECTIONS), F.when(F.col("raw") == "", AMBIGUOUS_EMPTY)
            )
        ).alias("ambiguities"),
    )


def token_events(low: Column, field: str) -> Column:
    """array<struct(position, ord, token, value)> of every non-overlapping occurrence, in text order."""

    def hits(ord_: int, token: str, value: str) -> Column:
        """Positions are running sums of the lengths between occurrences; a text without the token is not split."""
        none = F.array().cast("array<struct<position:int,ord:int,token:string,value:string>>")
        start = F.struct(F.lit(0).alias("at"), none.alias("events"))

        def step(acc: Column, gap: Column) -> Column:
            at = acc["at"] + gap
            event = F.struct(at.alias("position"), F.lit(ord_).alias("ord"), F.lit(token).alias("token"), F.lit(value).alias("value"))
            return F.struct((at + len(token)).alias("at"), F.concat(acc["events"], F.array(event)).alias("events"))

        gaps = F.transform(F.split(low, rf"\Q{token}\E", -1), lambda p: F.length(p))
        found = F.aggregate(T.let(gaps, lambda g: F.slice(g, F.lit(1), F.size(g) - 1)), start, step, lambda acc: acc["events"])
        return F.when(low.contains(token), found).otherwise(none)

    return F.array_sort(F.concat(*[hits(i, t, v) for i, (t, v) in enumerate(TOKENS[field])]))


def latest(low: Column, field: str) -> Column:
    """Value of the token whose last occurrence is furthest to the right; at one position the later token in order."""

    def at(ord_: int, token: str, value: str) -> Column:
        pos = F.length(low) - F.length(F.substring_index(low, token, -1)) - len(token)
        return F.when(
            low.contains(token), F.struct(pos.alias("position"), F.lit(ord_).alias("ord"), F.lit(value).alias("value"))
        )

    return F.array_max(F.array(*[at(i, t, v) for i, (t, v) in enumerate(TOKENS[field])]))["value"]


def resolve(parsed: DataFrame) -> DataFrame:
    """Add resolved_<field>: the last instruction wins, else the parsed preference."""
    low = F.col("low")
    return T.settle(
        parsed,
        parsed.columns,
        resolved_alignment=F.coalesce(latest(low, "alignment"), "alignment_seen"),
        resolved_line_spacing=F.coalesce(latest(low, "line_spacing"), "spacing_seen"),
        resolved_citation_style=F.coalesce(latest(low, "citation_style"), "citation_seen"),
        resolved_require_bullets=F.coalesce(latest(low, "require_bullets") == "yes", "require_bullets"),
    )


def trace_text(field: str) -> Column:
    """Every occurrence of the field's tokens as token@position, in text order."""
    return F.array_join(
        F.transform(token_events(F.col("low"), field), lambda e: F.concat(e["token"], F.lit("@"), e["position"].cast("string"))), ","
    )


def compile_rules(parsed: DataFrame) -> DataFrame:
    """Chosen values with defaults, the defaults that were applied, and sections with a 1-based order.

    ``require_bullets`` stays the parsed preference; the resolved one is kept beside it.
    """
    r = resolve(parsed)
    unspecified = F.col("resolved_alignment") == "unspecified"
    defaults = F.array_compact(
        F.array(
            F.when(F.col("resolved_citation_style") == "none", "citation_style:none"),
            F.when(unspecified, "alignment:justified"),
        )
    )
    return r.select(
        "*",
        F.transform(
            "required",
            lambda name, i: F.struct(name.alias("name"), F.lit(True).alias("required"), (i + 1).alias("order")),
        ).alias("sections"),
        F.when(unspecified, "justified").otherwise(F.col("resolved_alignment")).alias("alignment"),
        F.col("resolved_line_spacing").alias("line_spacing"),
        F.col("resolved_citation_style").alias("citation_style"),
        (F.col("heading_numbering") | F.col("require_numbering")).alias("number_headings"),
        defaults.alias("applied_defaults"),
    )


def _listing(title: str, items: Column, cap: int) -> Column:
    """A titled bullet list of the first ``cap`` items, nothing when empty. The cap is part of the digest format."""
    rows = F.transform(F.slice(items, 1, cap), lambda x: F.concat(F.lit("- "), x))
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(title)), rows)).otherwise(F.array().cast("array<string>"))


def _yes(c: Column, yes: str = "yes", no: str = "no") -> Column:
    return F.when(c, yes).otherwise(no)


def _lines(*parts: Column) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _kv(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))


def compiled_digest() -> Column:
    """Text summary of a compiled rules row. All labels and list caps."""
    c = F.col
    return F.array_join(
        F.flatten(
            F.array(
                _lines(
                    "Compiled constraints (deterministic):",
                    F.concat(F.lit("Required section order: "), F.array_join("required", ", ")),
                    "Typography:",
                    _kv("Font", c("font_family")),
                    _kv("Alignment", c("alignment")),
                    _kv("Line spacing", c("line_spacing")),
                    _kv("Paragraph spacing", c("paragraph_spacing")),
                    _kv("Citation style", c("citation_style")),
                    "Layout:",
                    _kv("Heading numbering", _yes(c("number_headings"), "enabled", "disabled")),
                    _kv("Max heading depth", c("max_heading_depth")),
                    _kv("Tables allowed", _yes(c("prefer_tables"))),
                    _kv("Images allowed", _yes(c("prefer_images"))),
                    "Content constraints:",
                    _kv("Target length words", c("target_words")),
                    _kv("Target length pages", F.when(c("target_pages") > 0, c("target_pages").cast("string")).otherwise("auto")),
                    _kv("Use bullets", _yes(c("require_bullets"))),
                    _kv("Include references", _yes(c("include_references"))),
                ),
                _listing("Hard constraints:", c("hard"), 15),
                _listing("Soft constraints:", c("soft"), 15),
                _listing("Conflicts detected (resolved by latest instruction):", c("conflicts"), 10),
                _listing("Ambiguities detected (defaults applied):", c("ambiguities"), 10),
                _listing("Applied defaults:", c("applied_defaults"), 10),
            )
        ),
        "\n",
    )


def parsed_digest() -> Column:
    """Text summary of a parsed rules row."""
    c = F.col
    heads = F.transform("headings", lambda h: F.concat(F.lit("H"), h["level"].cast("string"), F.lit(": "), h["title"]))
    return F.array_join(
        F.flatten(
            F.array(
                _lines(
                    F.concat(F.lit("Required sections: "), F.array_join("required", ", ")),
                    "Formatting preferences:",
                    _kv("Bullets", _yes(c("require_bullets"))),
                    _kv("Numbering", _yes(c("require_numbering"))),
                    _kv("Citation style", c("citation_seen")),
                    _kv("Tone", c("tone")),
                    _kv("Alignment", c("alignment_seen")),
                    _kv("Line spacing", c("spacing_seen")),
                    _kv("Paragraph spacing", c("paragraph_spacing")),
                    "Structural requirements:",
                    _kv("Include references", _yes(c("include_references"))),
                    _kv("Prefer tables", _yes(c("prefer_tables"))),
                    _kv("Prefer images", _yes(c("prefer_images"))),
                    _kv("Max heading depth", c("max_heading_depth")),
                    _kv("Target length (words)", c("target_words")),
                ),
                _listing("Heading outline:", heads, 2**31 - 1),
                _listing("Additional instructions:", c("instructions"), 20),
                _listing("Hard constraints:", c("hard"), 15),
                _listing("Soft constraints:", c("soft"), 15),
                _listing("Detected conflicts (resolve with latest instruction):", c("conflicts"), 10),
                _listing("Detected ambiguities (apply defaults where needed):", c("ambiguities"), 10),
            )
        ),
        "\n",
    )


def reference_outline(docs: DataFrame) -> DataFrame:
    """doc_id, enabled, headings, shown (first 30), avg_level over all headings, style flags."""
    content = T.strip(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", content.alias("content"))

    def entry(s: Column) -> Column:
        caps = (F.length(s) <= 80) & (F.upper(s) == s) & s.rlike(r"\p{L}")
        colon = (F.length(s) <= 90) & F.endswith(s, F.lit(":"))
        return (
            F.when(_outline_entry(s).isNotNull(), _outline_entry(s))
            .when(caps, F.struct(F.lit(2).alias("level"), F.lower(s).alias("title")))
            .when(colon, F.struct(F.lit(3).alias("level"), F.rtrim(s, F.lit(":")).alias("title")))
        )

    heads = F.array_compact(F.transform(T.split_lines(F.col("content")), lambda x: entry(T.strip(x))))
    rows = rows.withColumn("headings", heads)
    total = F.aggregate("headings", F.lit(0), lambda acc, h: acc + h["level"])
    n = F.size("headings")
    avg = F.when(n > 0, F.round(total.cast("decimal(20,8)") / n, 2).cast("double")).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id",
        (F.col("content") != "").alias("enabled"),
        "headings",
        F.slice("headings", 1, 30).alias("shown"),
        avg.alias("avg_level"),
        F.col("content").contains("# ").alias("uses_markdown_headings"),
        F.col("content").rlike(rf"(?md)^\p{{Nd}}+(?:\.\p{{Nd}}+)*{T.WS}").alias("uses_numbered_sections"),
        F.col("content").rlike(rf"(?md)^{T.WS}*[-*•]{T.WS}+").alias("uses_bullets"),
    )


# Opening lines of a reference digest.
REFERENCE_INTRO = [
    "Use the reference only for organization and formatting similarity.",
    "Do not copy wording, sentences, or unique phrasing from the reference.",
    "Preserve user-provided facts and content as the source of truth.",
]
NO_REFERENCE = "No reference alignment requested."


def reference_digest() -> Column:
    """Text summary of a reference outline row."""
    order = F.filter(F.transform("shown", lambda h: T.strip(h["title"])), lambda t: t != "")
    heads = F.transform("shown", lambda h: F.concat(F.lit("H"), h["level"].cast("string"), F.lit(": "), h["title"]))
    body = F.array_join(
        F.flatten(
            F.array(
                _lines(
                    *REFERENCE_INTRO,
                    F.concat(
                        F.lit("Target section order: "),
                        F.when(F.size(order) > 0, F.array_join(order, ", ")).otherwise("No explicit order detected"),
                    ),
                    "Style cues:",
                    _kv("Markdown headings", _yes(F.col("uses_markdown_headings"))),
                    _kv("Numbered sections", _yes(F.col("uses_numbered_sections"))),
                    _kv("Bullet usage", _yes(F.col("uses_bullets"))),
                ),
                _listing("Reference heading blueprint:", heads, 12),
            )
        ),
        "\n",
    )
    return F.when(F.col("enabled"), body).otherwise(NO_REFERENCE)


def plan_digest(plan: DataFrame) -> DataFrame:
    """doc_id, digest: section plan summary, titles grouped by mode in plan order."""

    def titles(mode: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("mode") == mode, F.struct("pos", "title"))))
        return F.transform(items, lambda x: x["title"])

    grouped = plan.groupBy("doc_id").agg(*[titles(m).alias(m) for m in ("auto_generate", "user_provides", "skip")])

    def line(prefix: str, mode: str) -> Column:
        return F.when(F.size(mode) > 0, F.concat(F.lit(prefix), F.array_join(mode, ", ")))

    parts = F.array_compact(
        F.array(
            F.lit("SECTION PLAN:"),
            F.lit("- Follow this section order exactly using markdown headings (##)."),
            line("- Auto-generate content for: ", "auto_generate"),
            line(
                "- For user-provided sections, include heading only and do not generate substantive content: ",
                "user_provides",
            ),
            line("- Omit skipped sections entirely: ", "skip"),
        )
    )
    return grouped.select("doc_id", F.array_join(parts, "\n").alias("digest"))
