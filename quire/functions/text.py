"""Column helpers for text: every function maps Column -> Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes, and the line boundaries of a universal line split.
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"

# Line grammar, tested on the stripped line in this order.
HEADING = rf"^#{{1,3}}{WS}+."
HEADING_MARK = rf"^#{{1,3}}{WS}+"
BULLET = rf"^[-*•]{WS}+."
BULLET_MARK = rf"^[-*•]{WS}+"
ORDERED = rf"^\p{{Nd}}+[.)]{WS}+."
ORDERED_MARK = rf"^\p{{Nd}}+[.)]{WS}+"
IMAGE = r"^!\[[^\]]*\]\(([^)]+)\)"
NUMBERED_TITLE = rf"^\p{{Nd}}+(\.\p{{Nd}}+)*{WS}+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Every whitespace run becomes one blank; ends are stripped."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def canon(c: Column) -> Column:
    """Comparison form of a section name."""
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def split_lines(c: Column) -> Column:
    """Array of lines; one trailing empty piece (text ending in a line break, or empty text) is no line."""
    parts = F.split(c, LINE_BREAK, -1)
    # The let-style aggregate evaluates the split once although the array is used three times.
    return F.element_at(
        F.transform(
            F.array(parts),
            lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
        ),
        1,
    )


def pipe_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))


def line_kind(stripped: Column) -> Column:
    """blank, heading, list_item, ordered_list_item, image, table_row or paragraph: first match wins."""
    return (
        F.when(stripped == "", "blank")
        .when(stripped.rlike(HEADING), "heading")
        .when(stripped.rlike(BULLET), "list_item")
        .when(stripped.rlike(ORDERED), "ordered_list_item")
        .when(stripped.rlike(IMAGE), "image")
        .when(pipe_count(stripped) >= 2, "table_row")
        .otherwise("paragraph")
    )


def heading_level(stripped: Column) -> Column:
    return F.length(F.regexp_extract(stripped, "^#{1,3}", 0))


def line_text(kind: Column, stripped: Column) -> Column:
    """The text of a line with its marker removed."""
    return (
        F.when(kind == "heading", strip(F.regexp_replace(stripped, HEADING_MARK, "")))
        .when(kind == "list_item", strip(F.regexp_replace(stripped, BULLET_MARK, "")))
        .when(kind == "ordered_list_item", strip(F.regexp_replace(stripped, ORDERED_MARK, "")))
        .when(kind == "image", strip(F.regexp_extract(stripped, IMAGE, 1)))
        .otherwise(stripped)
    )


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


# Multiline patterns: the d flag keeps ^ and $ on line feeds only.
HAS_BULLET = rf"(?md)^{WS}*([-*]|\p{{Nd}}+\.){WS}+"
HAS_REFERENCES = rf"(?imd)^#{{1,3}}{WS}+references{WS}*$"
HEADING_LINE = rf"(?md)^#{{1,3}}{WS}+.+$"
CITE_NUMBER = r"\[\p{Nd}+\]"
CITE_AUTHOR = rf"\([A-Z][A-Za-z\-]+,{WS}*\p{{Nd}}{{4}}\)"
ARTIFACT = r"(?<![\p{L}\p{N}_])\p{Nd}{6,9}(?![\p{L}\p{N}_])"


def has_bullets(c: Column) -> Column:
    return c.rlike(HAS_BULLET)


def has_references(c: Column) -> Column:
    return c.rlike(HAS_REFERENCES)


def artifact_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ARTIFACT))


def has_long_paragraph(c: Column, threshold: int = 1200) -> Column:
    """A blank-line separated paragraph of one line is longer than the threshold."""
    return F.exists(
        F.split(c, rf"\n{WS}*\n", -1),
        lambda p: (F.length(strip(p)) > threshold) & ~F.contains(strip(p), F.lit("\n")),
    )


def safe_name(c: Column, limit: int = 120) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "_"), 1, limit)


def url_file_name(c: Column) -> Column:
    """File name part of a URL: query string dropped, trailing slashes ignored, then made safe; null if empty."""
    path = F.rtrim(F.substring_index(strip(c), "?", 1), F.lit("/"))
    name = F.substring_index(path, "/", -1)
    return F.when(name != "", safe_name(name))


def escape_markup(c: Column) -> Column:
    amp = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def preview(c: Column, limit: int = 160) -> Column:
    """Whitespace-collapsed text cut to ``limit`` with three dots."""
    flat = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(rstrip(F.substring(flat, 1, limit - 3)), F.lit("..."))
    )


def truncate_ellipsis(c: Column, limit: int) -> Column:
    """Overflow form: one character shorter than the room, right-stripped, plus an ellipsis character."""
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(rstrip(F.substring(c, 1, max(1, limit - 1))), F.lit("…"))
    )


def split_at_word(c: Column, limit: int) -> Column:
    """struct(head, tail): break at the last blank inside the first ``limit`` characters, else a hard cut."""
    head = F.substring(c, 1, limit)
    cut = limit - F.instr(F.reverse(head), " ")
    at = F.when((F.instr(head, " ") == 0) | (cut <= 0), F.lit(limit)).otherwise(cut)
    return F.when(
        F.length(c) <= limit, F.struct(c.alias("head"), F.lit("").alias("tail"))
    ).otherwise(
        F.struct(
            rstrip(c.substr(F.lit(1), at)).alias("head"),
            lstrip(c.substr(at + 1, F.length(c))).alias("tail"),
        )
    )


# Roman digits by decimal place.
ROMAN_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
ROMAN_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ROMAN_HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]


def roman(n: Column) -> Column:
    """Upper-case Roman numeral; empty for zero and below."""

    def digit(table: list[str], place: int) -> Column:
        idx = F.pmod(F.floor(n / place), F.lit(10)).cast("int") + 1
        return F.element_at(F.array(*[F.lit(x) for x in table]), idx)

    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    return F.when(n <= 0, "").otherwise(
        F.concat(thousands, digit(ROMAN_HUNDREDS, 100), digit(ROMAN_TENS, 10), digit(ROMAN_ONES, 1))
    )


def page_label(n: Column, fmt: Column) -> Column:
    f = F.lower(strip(F.coalesce(fmt, F.lit(""))))
    return (
        F.when(f.isin("roman", "lowerroman"), F.lower(roman(n)))
        .when(f == "upperroman", roman(n))
        .otherwise(n.cast("string"))
    )


def prettify_label(c: Column) -> Column:
    """Metadata key to label: runs of _ and - become blanks, words get a capital; empty becomes Metadata."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), "[_-]+", " "))
    words = F.split(flat, f"{WS}+", -1)
    cap = F.transform(words, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.when(flat == "", "Metadata").otherwise(F.array_join(cap, " "))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it several times: fn gets it as a lambda variable."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def settle(df, keep: list[str], **columns: Column):
    """Select ``keep`` plus named columns that are computed exactly once per row.

    Without it the optimizer would inline a costly expression into every place that reads it.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(made)).alias("_made")).select(*keep, "_made.*")
