"""Literal cases: inputs and expected values of single operators."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.functions.jsontext import is_json
from quire.operators import attempts, blocks, briefs, history, layers, packing, raster, registry, scoring, similarity
from quire.plans import relations
from quire.sources import ingest, parts

LONG = " ".join(["word"] * 30)


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"T{i}", t) for i, t in enumerate(texts)], "doc_id long, title string, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_every_block_kind(spark):
    text = "# Title\nfirst line\nsecond line\n\n- item\n1. step\n| a | b |\n![alt](pic.png)\n## Sub\nend"
    rows = blocks.with_parents(blocks.blocks(docs(spark, text))).orderBy("block_no").collect()
    assert [(r.kind, r.text, r.parent_no) for r in rows] == [
        ("heading", "Title", 0),
        ("paragraph", "first line second line", 1),
        ("list_item", "item", 1),
        ("ordered_list_item", "step", 1),
        ("table_row", "| a | b |", 1),
        ("image", "pic.png", 1),
        ("heading", "Sub", 1),
        ("paragraph", "end", 7),
    ]
    stats = blocks.block_stats(docs(spark, text)).first()
    assert (stats.total_blocks, stats.headings, stats.paragraphs, stats.list_items) == (9, 2, 2, 2)
    assert (stats.table_rows, stats.images) == (1, 1)


def test_empty_and_blank_texts(spark):
    rows = {r.doc_id: r for r in blocks.block_stats(docs(spark, "", "\n\n", "x")).collect()}
    assert [rows[i].total_blocks for i in range(3)] == [1, 1, 2]
    assert blocks.chunks(docs(spark, "")).count() == 0
    root = blocks.with_root(blocks.blocks(docs(spark, "")), docs(spark, ""), F.lit("  ")).collect()
    assert [(r.block_id, r.text) for r in root] == [("root", "Untitled")]


def test_lines_split_like_universal_newlines(spark):
    text = "a\r\nb\rc\x0bd\x85e f\n"
    assert [r.raw for r in blocks.lines(docs(spark, text)).orderBy("pos").collect()] == text.splitlines()


def test_grammars_differ(spark):
    text = "  # indented\n#tab\n## ok"
    assert [r.kind for r in blocks.blocks(docs(spark, text)).orderBy("block_no").collect()] == ["heading", "paragraph", "heading"]
    assert [r.kind for r in blocks.flat_blocks(docs(spark, text)).orderBy("block_no").collect()] == ["p", "h2"]


def test_conflicting_brief(spark):
    text = "Use APA style. Use MLA style. Double spacing. Single spacing. justify text. left align text."
    b = spark.createDataFrame([(1, text)], "brief_id long, text string")
    r = briefs.compile_rules(briefs.parse(b)).first()
    assert (r.citation_style, r.line_spacing, r.alignment) == ("MLA", "single", "left")
    assert list(r.conflicts) == [briefs.CONFLICT_SPACING, briefs.CONFLICT_ALIGN]


def test_brief_sections_and_lengths(spark):
    b = spark.createDataFrame([(1, "Include Introduction and methodology, up to 12 pages."), (2, "")], "brief_id long, text string")
    rows = {r.brief_id: r for r in briefs.parse(b).collect()}
    assert list(rows[1].required) == ["introduction", "body", "conclusion", "methodology"]
    assert (rows[1].target_pages, rows[1].target_words) == (12, 3600)
    assert list(rows[2].required) == ["introduction", "body", "conclusion"]
    assert list(rows[2].ambiguities) == [briefs.AMBIGUOUS_EMPTY]


def test_valid_report_and_artifact_number(spark):
    good = f"# Title\n\n## Introduction\n{LONG}\n\n## Body\n{LONG} 1234567 {LONG}\n\n## Conclusion\n{LONG}"
    d = docs(spark, good, "# T\ntext").withColumn("brief_id", F.lit(-1))
    none = spark.createDataFrame([], "brief_id long, text string")
    rows = {r.doc_id: r for r in scoring.report(d, none).collect()}
    assert rows[0].ok and list(rows[0].errors) == [] and rows[0].artifact_numbers == 1
    assert list(rows[1].missing) == ["Introduction", "Body", "Conclusion"]
    # a missing section counts as missing and as empty: 6 errors, the heading count 1, and one warning
    assert len(rows[1].errors) == 7 and rows[1].quality_score == 0.0
    assert rows[1].structure_score == 46.0


def test_layer_merge_keeps_falsy_values(spark):
    rows = [
        (1, "size", "22", 0, 0, "d"), (1, "size", None, 1, 0, "e"), (1, "size", "0", 2, 0, "o"),
        (1, "font", "Arial", 0, 1, "d"), (1, "font", None, 2, 1, "o"), (1, "headings.1.font", "Calibri Light", 2, 2, "o"),
    ]
    kv = spark.createDataFrame(rows, "entity long, key string, value string, priority int, seq int, source string")
    got = {r.key: r.value for r in layers.merge(kv).collect()}
    assert got == {"size": "0", "font": "Arial", "headings.1.font": "Calibri Light"}


def test_resolved_leaves_equal_the_row_merge(spark):
    """Maps laid over constant defaults: a null never overrides, falsy values do, a missing layer changes nothing."""
    rows = [
        (1, {"body_size_halfpt": "22", "headings.1.font": None, "own": ""}, {"body_size_halfpt": "0", "body_font": None}),
        (2, None, None),
        (3, {"has_toc": "true"}, None),
    ]
    frame = spark.createDataFrame(rows, "entity long, e map<string, string>, o map<string, string>")
    got = {}
    for r in layers.rule_rows(frame, layers.resolved(F.col("e"), F.col("o"))).collect():
        got.setdefault(r.entity, {})[r.key] = (r.value, r.source)
    base = {k: (v, "defaults") for k, v in layers.DEFAULTS.items()}
    assert got[2] == base
    assert got[1] == base | {"body_size_halfpt": ("0", "override"), "own": ("", "extracted")}
    assert got[3] == base | {"has_toc": ("true", "extracted")}
    long = spark.createDataFrame(
        [(1, "a", "1", 1, 0), (1, "a", "2", 1, 1), (1, "b", None, 1, 0), (1, "b", "3", 2, 0), (2, "b", "4", 2, 0), (2, "c", "5", 0, 0)],
        "entity long, key string, value string, priority int, seq int",
    )
    maps = {r.entity: (r.low, r.high) for r in layers.layer_maps(long, {1: "low", 2: "high"}).collect()}
    assert maps == {1: ({"a": "2"}, {"b": "3"}), 2: ({}, {"b": "4"})}
    changed = layers.diff_maps(frame, F.col("e"), F.col("o")).collect()
    assert {(r.entity, r.key, r.before, r.after) for r in changed} == {(1, "body_size_halfpt", "22", "0"), (1, "own", "", None), (3, "has_toc", "true", None)}


def formatting(spark, rules, flat=None, typography=None, numbered=None, summary=None):
    kind = "rules map<string, string>, flat map<string, string>, typography map<string, string>, heading_numbering boolean, cover_summary_text string"
    frame = spark.createDataFrame([(1, rules, flat, typography, numbered, summary)], f"entity long, {kind}")
    return layers.effective_formatting(frame).first().asDict()


def test_effective_formatting_of_no_rules_is_the_defaults(spark):
    got = formatting(spark, None)
    assert len(got) == 131 and got["page_width_dxa"] == "11906" and got["margin_header_dxa"] == "720" and got["body_font"] == "Times New Roman"
    assert got["body_line_spacing_factor"] == 1.5 and got["has_body_section"] and not got["has_page_numbers"] and not got["heading_numbering"]
    assert got["page_number_format"] == "decimal" and got["prelim_page_format"] == "lowerRoman" and got["h1_left_indent_dxa"] is None
    assert got["heading_1_size_halfpt"] == "36" and got["heading_6_space_after"] == "40" and got["signature_block_space_before_pt"] == "18.0"


def test_effective_formatting_treats_falsy_and_null_apart(spark):
    zeros = {"page_width_dxa": "0", "body_space_before": "0", "cover_title_bold": "false", "body_left_indent_dxa": "0", "body_font": "", "has_body_section": "false"}
    got = formatting(spark, zeros, typography={"font_family": "Georgia", "alignment": "left", "line_spacing": " Double "}, numbered=True, summary="s")
    assert got["page_width_dxa"] == "11906"  # falsy gives the default
    assert (got["body_space_before"], got["cover_title_bold"], got["body_left_indent_dxa"]) == ("0", "false", "0")  # only null does
    assert (got["body_font"], got["body_alignment"], got["body_line_spacing_factor"]) == ("Georgia", "left", 2.0)
    assert not got["has_body_section"] and got["heading_numbering"] and got["cover_summary_text"] == "s"


def test_effective_formatting_of_headings_numbers_and_flat_rules(spark):
    got = formatting(spark, {"headings.2.bold": None, "headings.3.font": "", "body_page_format": "upperRoman", "body_line_spacing_val": "480"}, flat={"body_font": "Flat"})
    assert got["heading_2_bold"] is None and got["heading_3_font"] == "" and got["heading_1_font"] == "Calibri"
    assert got["page_number_format"] == "upperRoman" and got["body_line_spacing_factor"] == 2.0 and got["body_font"] == "Times New Roman"
    got = formatting(spark, {}, flat={"body_font": "Flat", "body_space_after": None})
    assert got["body_font"] == "Flat" and got["body_space_after"] == "120"
    assert formatting(spark, {"body_line_spacing_val": "wide"})["body_line_spacing_factor"] == 1.0


def test_priority_order_and_tie(spark):
    rows = [(1, "size", v, p, s, "x") for v, p, s in [("10", 0, 0), ("11", 1, 1), ("12", 2, 2), ("13", 2, 3)]]
    kv = spark.createDataFrame(rows, "entity long, key string, value string, priority int, seq int, source string")
    assert layers.priority_merge(kv).first().value == "13"


@pytest.mark.parametrize(
    "value,unit,emu", [("1", "in", 914400), ("12", "pt", 152400), ("2.54", "cm", 914400), ("25.4", "mm", 914400), ("7.5", "emu", 8), ("1", "px", None)]
)
def test_emu(spark, value, unit, emu):
    assert one(spark, U.to_emu(F.lit(value).cast("decimal(10,4)"), F.lit(unit))) == emu


def test_override_conversion(spark):
    row = ("12", "1.0", "24.0", "invalid_number", "-1")
    df = spark.createDataFrame(
        [(1, " Arial ", row[0], row[1], row[3], row[4], None, row[2])],
        "entity long, bodyFont string, bodySizePt string, marginTopIn string, marginLeftIn string, marginBottomIn string, "
        "marginRightIn string, lineSpacingPt string",
    )
    r = layers.convert_overrides(df).first()
    assert (r.body_font, r.body_size_halfpt, r.margin_top_dxa, r.body_line_spacing_val) == ("Arial", 24, 1440, 480)
    assert r.margin_left_dxa is None and r.margin_bottom_dxa is None and r.margin_right_dxa is None


def test_packing_opens_a_page_for_an_oversized_first_block(spark):
    text = "# A\n" + "x" * 3901 + "\n# B"
    b = blocks.blocks(docs(spark, text)).withColumn("capacity", F.lit(48))
    rows = packing.pack(b, F.col("capacity"), ("capacity", "doc_id")).orderBy("pos").collect()
    assert [(r.page, r.line_start, r.line_end) for r in rows] == [(1, 0, 2), (1, 2, 46), (1, 46, 48)]
    tiny = packing.pack(b.withColumn("capacity", F.lit(1)), F.col("capacity"), ("capacity", "doc_id")).orderBy("pos").collect()
    assert [r.page for r in tiny] == [2, 3, 4]


@pytest.mark.parametrize("attempt,advised", [(1, 45), (2, 43), (3, 42)])
def test_capacity_advice_for_text(spark, attempt, advised):
    prof = spark.createDataFrame(
        [(48, 1, p, 40, 0, 3, 0, 3) for p in (1, 2, 3)],
        "capacity int, doc_id long, page int, lines int, headings int, paragraphs int, lists int, blocks int",
    )
    rows = {r.attempt: r.advised for r in packing.capacity_advice(prof).collect()}
    assert rows[attempt] == advised


@pytest.mark.parametrize("n,text", [(0, ""), (4, "IV"), (9, "IX"), (44, "XLIV"), (1994, "MCMXCIV"), (3999, "MMMCMXCIX")])
def test_roman(spark, n, text):
    assert one(spark, T.roman(F.lit(n))) == text


def test_attempt_score(spark):
    assert one(spark, attempts.attempt_score(F.lit(False), F.lit(70.0), F.lit(60.0), F.lit(0.5))) == 63.0
    assert one(spark, attempts.attempt_score(F.lit(True), F.lit(1.0), F.lit(1.0), F.lit(0.0))) == 100.0


def test_ssim_identity_and_shift(spark):
    base = [0] * 32 + [255] * 32
    df = spark.createDataFrame([(1, base, base), (2, base, base[4:] + base[:4])], "id long, a array<int>, b array<int>")
    rows = {r.id: r for r in raster.compare(df, "a", "b", "id").collect()}
    assert rows[1].ssim == 1.0 and rows[1].mad == 0.0 and rows[2].ssim < 0.97


def test_version_order(spark):
    t = spark.createDataFrame(
        [("a", "1.9.0", False), ("a", "1.10.0", False), ("a", "2.0.0", True), ("b", "1.0.0", True)],
        "template_id string, version string, deprecated boolean",
    )
    assert {r.template_id: r.latest for r in registry.latest_live(t).collect()} == {"a": "1.10.0"}
    hints = {r.template_id: r.hint for r in registry.deprecation_report(t).collect()}
    assert hints == {"a": "Please migrate to a@1.10.0.", "b": "No non-deprecated version is available."}


@pytest.mark.parametrize(
    "name,mime,route",
    [
        ("a.TXT", "", "text"), ("x", "TEXT/plain", "text"), ("a.json", "", "json"), ("a.docx", "", "docx"), ("a.ppsx", "", "pptx"),
        ("a.xltm", "", "xlsx"), ("a.bin", "application/pdf", "pdf"), ("a.JPEG", "", "image"), (".json", "", "fallback"), ("a", "", "fallback"),
    ],
)
def test_route(spark, name, mime, route):
    assert one(spark, ingest.route(F.lit(name), F.lit(mime))) == route


@pytest.mark.parametrize(
    "raw,text",
    [("é".encode(), "é"), ("é".encode("utf-16"), "é"), ("café".encode("latin-1"), "café"), (b"", "")],
)
def test_bytes_to_text(spark, raw, text):
    assert spark.createDataFrame([(raw,)], "b binary").select(ingest.bytes_to_text(F.col("b"))).first()[0] == text


@pytest.mark.parametrize(
    "text,ok", [('{"a": 1}', True), ('{"a": 1}}', False), ("1, 2", False), ("1] [2", False), ('"x"', True), ("", False), ("null", True), ("[1,2]", True)]
)
def test_is_json(spark, text, ok):
    assert one(spark, is_json(F.lit(text))) is ok


def test_sheet_text(spark):
    cells = spark.createDataFrame(
        [(1, "S", 1, 1, "s", "0"), (1, "S", 1, 2, "s", "9"), (1, "S", 2, 1, "b", "1"), (1, "S", 2, 2, "inlineStr", " "), (1, "S", 2, 3, "n", "42")],
        "book long, sheet string, row long, col int, t string, v string",
    )
    words = spark.createDataFrame([(0, "Name")], "idx long, text string")
    assert parts.sheet_texts(parts.resolve_cells(cells, words)).first().text == "### Sheet: S\nName\t9\nTRUE\t42"
    got = {r.part: r.text for r in parts.sheet_texts(parts.resolve_cells(cells, words), rows_per_part=2).collect()}
    assert got == {0: "### Sheet: S\nName\t9", 1: "TRUE\t42"}
    sheets = spark.createDataFrame([(1, "T", 0), (1, "S", 1), (2, "S", 0)], "book long, sheet string, pos int")
    books = {r.book: r.text for r in parts.book_texts(sheets, parts.sheet_texts(parts.resolve_cells(cells, words))).collect()}
    assert books == {1: "### Sheet: S\nName\t9\nTRUE\t42", 2: parts.EMPTY_BOOK}


def test_long_conversations_do_not_meet(spark, tmp_path):
    """70,000 turns of one conversation and a few of the next: each document has turns of one conversation only."""
    turns = "SELECT 0 AS conv_id, id AS turn FROM range(70000) UNION ALL SELECT 1, id FROM range(3)"
    rows = spark.sql(f"SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, 'user' AS role, concat('c', conv_id) AS text FROM ({turns})")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    found = relations.v_conv(spark, str(tmp_path)).selectExpr("doc_id", "title", "contains(text, 'c0') AS a", "contains(text, 'c1') AS b").collect()
    assert len(found) == 1095 and len({r.doc_id for r in found}) == 1095
    assert all((r.a, r.b) == (r.title == "Conversation 0", r.title == "Conversation 1") for r in found)


def test_slides_sort_by_number(spark):
    rows = [(1, f"ppt/slides/slide{n}.xml", 0, f"p{n}") for n in (10, 2, 1)]
    df = spark.createDataFrame(rows, "deck long, name string, pos int, text string")
    assert parts.slide_texts(df).first().text == "### Slide 1\np1\n\n### Slide 2\np2\n\n### Slide 10\np10"


def test_error_classes(spark):
    d = "Output quality validation failed after one retry: a; b ;"
    assert one(spark, history.error_code(F.lit(d))) == "quality_validation"
    assert one(spark, history.quality_errors(F.lit(d))) == ["a", "b"]
    assert one(spark, history.public_message(F.lit("INPUT_VALIDATION: no text"))) == "no text"
    assert one(spark, history.status_category(F.lit(429))) == "rate_limited"


def test_word_split(spark):
    r = one(spark, T.split_at_word(F.lit("alpha beta gamma"), 12))
    assert (r["head"], r["tail"]) == ("alpha beta", "gamma")
    r = one(spark, T.split_at_word(F.lit("alphabetagamma"), 5))
    assert (r["head"], r["tail"]) == ("alpha", "betagamma")


def test_a_diff_against_resolved_rules_has_own_and_default_keys(spark):
    frame = spark.createDataFrame([(1, {"has_toc": "true", "own": "a", "gone": None}, {"own": "b", "new": "c"})], "entity long, e map<string, string>, o map<string, string>")
    rows = layers.diff_maps(frame, F.col("e"), layers.resolved(F.col("e"), F.col("o"))).collect()
    base = {(k, None, v) for k, v in layers.DEFAULTS.items() if k != "has_toc"}
    assert {(r.key, r.before, r.after) for r in rows} == base | {("own", "a", "b"), ("new", None, "c")}


def test_rows_of_the_similarity_join_are_narrow(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    bags = similarity._bags(similarity.bag_rows(rows, "doc_id"), "doc_id")
    found = similarity._prefixes(bags, [1] * similarity.BUCKETS, 8200)
    assert dict(found.dtypes) == {"grp": "string", "h": "binary", "n": "int", "el": "bigint", "place": "int"}
