"""Rule briefs and reference outlines (R11 is with the rule layers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import briefs as K
from quire.plans import relations as R
from quire.plans import sqltext as S
from quire.plans.base import ctes, query


def _has(words, x="low"):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _in(words, x):
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


def _entry(s, extra_level="", extra_title=""):
    tok = f"regexp_extract({s}, '{K.NUMBERED}', 1)"
    return f"""CASE WHEN {s} LIKE '# %' THEN 1 WHEN {s} LIKE '## %' THEN 2 WHEN {s} LIKE '### %' THEN 3
        WHEN regexp_matches({s}, '{K.NUMBERED}') THEN least(4, length({tok}) - length(replace({tok}, '.', '')) + 1)
        {extra_level} END AS level, CASE WHEN regexp_matches({s}, '^#{{1,3}} ') THEN
        {S.strip(f"regexp_replace({s}, '^#{{1,3}} ', '')")} WHEN regexp_matches({s}, '{K.NUMBERED}') THEN
        {S.strip(f"regexp_extract({s}, '{K.NUMBERED}', 2)")} {extra_title} END AS title"""


_TOKEN_ROWS = ", ".join(
    f"('{f}', {i}, '{t}', '{v}')" for f, items in K.TOKENS.items() for i, (t, v) in enumerate(items)
)

ctes(
    brief_raw=f"SELECT brief_id, {S.strip('text')} AS raw, lower({S.strip('text')}) AS low FROM v_brief",
    brief_lines=S.lines_of("brief_raw", "brief_id", "raw"),
    brief_heads=f"""SELECT brief_id, pos, CAST(level AS INTEGER) AS level, title FROM (SELECT brief_id, pos, {_entry('s')}
        FROM brief_lines) WHERE level IS NOT NULL""",
    brief_marks=f"""SELECT brief_id, pos, s, trim({S.rstrip('raw')}, ' -' || chr(9)) AS t FROM brief_lines""",
    brief_hard=f"SELECT brief_id, pos, t FROM brief_marks WHERE t <> '' AND {_in(K.HARD_WORDS, 't')}",
    brief_soft=f"""SELECT brief_id, pos, t FROM brief_marks WHERE t <> '' AND NOT {_in(K.HARD_WORDS, 't')} AND
        {_in(K.SOFT_WORDS, 't')}""",
    brief_format=f"""SELECT brief_id,
        CASE WHEN {_has(['apa'])} THEN 'APA' WHEN {_has(['mla'])} THEN 'MLA' WHEN {_has(['harvard'])} THEN 'Harvard'
            WHEN {_has(['ieee'])} THEN 'IEEE' ELSE 'none' END AS citation_seen,
        CASE WHEN {_has(['justify', 'justified'])} THEN 'justified' WHEN {_has(['left align', 'left-aligned'])} THEN 'left'
            WHEN {_has(['center', 'centred'])} THEN 'center' ELSE 'unspecified' END AS alignment_seen,
        CASE WHEN {_has(['double spacing', 'double-spaced'])} THEN 'double' WHEN {_has(['1.5', 'one and a half'])} THEN '1.5'
            ELSE 'single' END AS spacing_seen,
        {_has(['bullet', 'list', 'points'])} AS require_bullets,
        {_has(['numbered', '1.', '2.', 'section numbering'])} AS require_numbering,
        {_has(['numbered heading', 'section numbering'])} AS heading_numbering,
        CASE WHEN {_has(['formal', 'academic'])} THEN 'formal' ELSE 'unspecified' END AS tone,
        CASE WHEN {_has(['paragraph spacing'])} AND {_has(['extra'])} THEN 'wide' ELSE 'normal' END AS paragraph_spacing,
        CASE WHEN {_has(['times new roman'])} THEN 'Times New Roman' ELSE 'unspecified' END AS font_family
        FROM brief_raw""",
    brief_words=f"""SELECT brief_id, word FROM brief_raw, (VALUES {', '.join(f"('{w}')" for w in K.SECTION_WORDS)}) AS t(word)
        WHERE contains(low, word)""",
    brief_required="""SELECT brief_id, CASE WHEN n = 0 THEN 'introduction|body|conclusion'
        WHEN core > 0 THEN 'introduction|body|conclusion' || coalesce('|' || extras, '') ELSE extras END AS required
        FROM (SELECT r.brief_id, count(word) AS n, count(*) FILTER (word IN ('introduction', 'conclusion')) AS core,
        string_agg(word, '|' ORDER BY word) FILTER (word NOT IN ('introduction', 'conclusion')) AS extras
        FROM brief_raw r LEFT JOIN brief_words w ON w.brief_id = r.brief_id GROUP BY r.brief_id)""",
    brief_struct=f"""SELECT brief_id, CAST(depth AS INTEGER) AS max_heading_depth, CAST(pages AS INTEGER) AS target_pages,
        CAST(CASE WHEN pages > 0 THEN greatest(words, pages * 300) ELSE words END AS INTEGER) AS target_words,
        {_has(['table'])} AS prefer_tables, {_has(['image', 'figure'])} AS prefer_images,
        {_has(['references', 'bibliography'])} AS include_references,
        ({_has(['introduction'])} AND {_has(['body'])} AND {_has(['conclusion'])}) OR depth >= 2 AS require_core FROM (
        SELECT r.brief_id, low, coalesce((SELECT max(level) FROM brief_heads h WHERE h.brief_id = r.brief_id), 3) AS depth,
        coalesce(TRY_CAST(regexp_extract(low, '{K.PAGES}', 1) AS INTEGER), 0) AS pages,
        CASE WHEN {_has(['long'])} THEN 1500 WHEN {_has(['medium'])} THEN 800 ELSE 500 END AS words FROM brief_raw r)""",
    brief_flags=f"""SELECT brief_id, concat_ws('|',
        CASE WHEN {_has(['single spacing'])} AND {_has(['double spacing'])} THEN '{K.CONFLICT_SPACING}' END,
        CASE WHEN {_has(['left align'])} AND {_has(['justify', 'justified'])} THEN '{K.CONFLICT_ALIGN}' END,
        CASE WHEN {_has(['no bullet'])} AND {_has(['bullet', 'list', 'points'])} THEN '{K.CONFLICT_BULLETS}' END) AS conflicts,
        concat_ws('|', CASE WHEN (SELECT NOT contains(required, '|') FROM brief_required q WHERE q.brief_id = r.brief_id)
        THEN '{K.AMBIGUOUS_SECTIONS}' END, CASE WHEN raw = '' THEN '{K.AMBIGUOUS_EMPTY}' END) AS ambiguities
        FROM brief_raw r""",
    brief_events=f"""SELECT brief_id, field, ord, token, value, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) AS INTEGER) + (i - 1) * length(token) AS position FROM (
        SELECT *, unnest(range(1, len(pieces))) AS i FROM (
        SELECT brief_id, field, ord, token, value, string_split(low, token) AS pieces FROM brief_raw,
        (VALUES {_TOKEN_ROWS}) AS t(field, ord, token, value) WHERE contains(low, token)))""",
    brief_last="""SELECT brief_id, field, arg_max(value, position * 100 + ord) AS value,
        array_to_string(list(token || '@' || position ORDER BY position * 100 + ord), ',') AS trace FROM brief_events
        GROUP BY brief_id, field""",
    brief_resolved="""SELECT f.brief_id,
        coalesce(a.value, alignment_seen) AS alignment, coalesce(s.value, spacing_seen) AS line_spacing,
        coalesce(c.value, citation_seen) AS citation_style, coalesce(b.value = 'yes', require_bullets) AS bullets,
        coalesce(a.trace, '') AS alignment_trace, coalesce(s.trace, '') AS spacing_trace,
        coalesce(c.trace, '') AS citation_trace, coalesce(b.trace, '') AS bullets_trace FROM brief_format f
        LEFT JOIN brief_last a ON a.brief_id = f.brief_id AND a.field = 'alignment'
        LEFT JOIN brief_last s ON s.brief_id = f.brief_id AND s.field = 'line_spacing'
        LEFT JOIN brief_last c ON c.brief_id = f.brief_id AND c.field = 'citation_style'
        LEFT JOIN brief_last b ON b.brief_id = f.brief_id AND b.field = 'require_bullets'""",
    brief_compiled="""SELECT f.brief_id, q.required, CASE WHEN r.alignment = 'unspecified' THEN 'justified' ELSE r.alignment END
        AS alignment, r.line_spacing, r.citation_style, f.font_family, f.paragraph_spacing, f.tone,
        f.heading_numbering OR f.require_numbering AS number_headings, f.require_bullets, f.require_numbering,
        f.citation_seen, f.alignment_seen, f.spacing_seen,
        t.max_heading_depth, t.target_pages, t.target_words, t.prefer_tables, t.prefer_images, t.include_references,
        concat_ws('|', CASE WHEN r.citation_style = 'none' THEN 'citation_style:none' END,
        CASE WHEN r.alignment = 'unspecified' THEN 'alignment:justified' END) AS applied_defaults,
        g.conflicts, g.ambiguities,
        (SELECT list(t ORDER BY pos) FROM brief_hard h WHERE h.brief_id = f.brief_id) AS hard,
        (SELECT list(t ORDER BY pos) FROM brief_soft h WHERE h.brief_id = f.brief_id) AS soft
        FROM brief_format f JOIN brief_required q ON q.brief_id = f.brief_id
        JOIN brief_resolved r ON r.brief_id = f.brief_id JOIN brief_struct t ON t.brief_id = f.brief_id
        JOIN brief_flags g ON g.brief_id = f.brief_id""",
    doc_content=f"SELECT doc_id, {S.strip('text')} AS content FROM v_doc",
    content_lines=S.lines_of("doc_content", "doc_id", "content"),
    doc_heads="SELECT doc_id, pos, CAST(level AS INTEGER) AS level, title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ("
    + "SELECT doc_id, pos, "
    + _entry(
        "s",
        "WHEN s <> '' AND length(s) <= 80 AND upper(s) = s AND regexp_matches(s, '\\p{L}') THEN 2 "
        "WHEN length(s) <= 90 AND s LIKE '%:' THEN 3",
        "WHEN length(s) <= 80 AND upper(s) = s AND regexp_matches(s, '\\p{L}') THEN lower(s) "
        "WHEN s LIKE '%:' THEN rtrim(s, ':')",
    )
    + " FROM content_lines) WHERE level IS NOT NULL",
    doc_outline=f"""SELECT c.doc_id, content <> '' AS enabled, count(h.n) AS heading_count,
        coalesce(string_agg(level || ' ' || title, chr(10) ORDER BY n) FILTER (n <= 30), '') AS shown,
        CASE WHEN count(h.n) = 0 THEN 0.0 ELSE {S.round_half_up('sum(level) * 1.0 / count(h.n)')} END AS avg_level,
        contains(content, '# ') AS uses_markdown_headings,
        regexp_matches(content, '(?m)^\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*{T.WS}') AS uses_numbered_sections,
        regexp_matches(content, '(?m)^{T.WS}*[-*•]{T.WS}+') AS uses_bullets
        FROM doc_content c LEFT JOIN doc_heads h ON h.doc_id = c.doc_id GROUP BY c.doc_id, content""",
)


def _parsed(spark, d):
    return K.parse(R.v_brief(spark, d))


def _join(name):
    return F.array_join(name, "|").alias(name)


@query(
    "r01_outline",
    """SELECT brief_id, CAST(row_number() OVER (PARTITION BY brief_id ORDER BY pos) - 1 AS INTEGER) AS pos, level, title
    FROM brief_heads""",
)
def _(spark, d):
    return _parsed(spark, d).select("brief_id", F.posexplode("headings").alias("pos", "h")).select(
        "brief_id", "pos", "h.level", "h.title"
    )


@query("r02_formatting_flags", "SELECT * FROM brief_format")
def _(spark, d):
    return _parsed(spark, d).select("brief_id", *K.formatting(F.col("raw")).keys())


@query("r03_required_sections", "SELECT * FROM brief_required")
def _(spark, d):
    return _parsed(spark, d).select("brief_id", _join("required"))


@query("r04_structural_targets", "SELECT * FROM brief_struct")
def _(spark, d):
    return _parsed(spark, d).select(
        "brief_id",
        "max_heading_depth",
        "target_pages",
        "target_words",
        "prefer_tables",
        "prefer_images",
        "include_references",
        "require_core",
    )


@query(
    "r05_constraint_lines",
    """SELECT r.brief_id, coalesce((SELECT string_agg(t, '|' ORDER BY pos) FROM brief_hard h WHERE h.brief_id = r.brief_id), '')
    AS hard, coalesce((SELECT string_agg(t, '|' ORDER BY pos) FROM brief_soft h WHERE h.brief_id = r.brief_id), '') AS soft
    FROM brief_raw r""",
)
def _(spark, d):
    return _parsed(spark, d).select("brief_id", _join("hard"), _join("soft"))


@query("r06_conflict_flags", "SELECT * FROM brief_flags")
def _(spark, d):
    return _parsed(spark, d).select("brief_id", _join("conflicts"), _join("ambiguities"))


@query(
    "r07_instruction_lines",
    """SELECT brief_id, CAST(row_number() OVER (PARTITION BY brief_id ORDER BY pos) - 1 AS INTEGER) AS pos, t AS instruction
    FROM brief_marks WHERE s <> '' AND s NOT LIKE '#%'""",
)
def _(spark, d):
    return _parsed(spark, d).select("brief_id", F.posexplode("instructions").alias("pos", "instruction"))


@query("r08_last_instruction_wins", "SELECT * FROM brief_resolved")
def _(spark, d):
    return K.resolve(_parsed(spark, d)).select(
        "brief_id",
        F.col("resolved_alignment").alias("alignment"),
        F.col("resolved_line_spacing").alias("line_spacing"),
        F.col("resolved_citation_style").alias("citation_style"),
        F.col("resolved_require_bullets").alias("bullets"),
        K.trace_text("alignment").alias("alignment_trace"),
        K.trace_text("line_spacing").alias("spacing_trace"),
        K.trace_text("citation_style").alias("citation_trace"),
        K.trace_text("require_bullets").alias("bullets_trace"),
    )


@query(
    "r09_compiled_rules",
    """SELECT brief_id, array_to_string(list_transform(string_split(required, '|'), lambda x, i: i || ':' || x), '|') AS sections,
    alignment, line_spacing, citation_style, font_family, paragraph_spacing, tone, number_headings, max_heading_depth,
    target_pages, target_words, require_bullets, applied_defaults FROM brief_compiled""",
)
def _(spark, d):
    return K.compile_rules(_parsed(spark, d)).select(
        "brief_id",
        F.array_join(
            F.transform("sections", lambda s: F.concat(s["order"].cast("string"), F.lit(":"), s["name"])), "|"
        ).alias("sections"),
        "alignment",
        "line_spacing",
        "citation_style",
        "font_family",
        "paragraph_spacing",
        "tone",
        "number_headings",
        "max_heading_depth",
        "target_pages",
        "target_words",
        "require_bullets",
        _join("applied_defaults"),
    )


@query("r10_reference_outline", "SELECT * FROM doc_outline")
def _(spark, d):
    return K.reference_outline(R.v_doc(spark, d)).select(
        "doc_id",
        "enabled",
        F.size("headings").cast("bigint").alias("heading_count"),
        F.array_join(
            F.transform("shown", lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["title"])), "\n"
        ).alias("shown"),
        "avg_level",
        "uses_markdown_headings",
        "uses_numbered_sections",
        "uses_bullets",
    )


def _yn(x, yes="yes", no="no"):
    return f"CASE WHEN {x} THEN '{yes}' ELSE '{no}' END"


def _cap(title, items, cap):
    return f"""CASE WHEN len({items}) > 0 THEN chr(10) || '{title}' || array_to_string(list_transform({items}[1:{cap}],
        lambda x: chr(10) || '- ' || x), '') ELSE '' END"""


def _split(x):
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split({x}, '|') END)"


@query(
    "r12_rules_digest",
    f"""SELECT brief_id, 'Compiled constraints (deterministic):' || chr(10) || 'Required section order: ' ||
    replace(required, '|', ', ') || chr(10) || 'Typography:' || chr(10) || '- Font: ' || font_family || chr(10) ||
    '- Alignment: ' || alignment || chr(10) || '- Line spacing: ' || line_spacing || chr(10) || '- Paragraph spacing: ' ||
    paragraph_spacing || chr(10) || '- Citation style: ' || citation_style || chr(10) || 'Layout:' || chr(10) ||
    '- Heading numbering: ' || {_yn('number_headings', 'enabled', 'disabled')} || chr(10) || '- Max heading depth: ' ||
    max_heading_depth || chr(10) || '- Tables allowed: ' || {_yn('prefer_tables')} || chr(10) || '- Images allowed: ' ||
    {_yn('prefer_images')} || chr(10) || 'Content constraints:' || chr(10) || '- Target length words: ' || target_words ||
    chr(10) || '- Target length pages: ' || CASE WHEN target_pages > 0 THEN target_pages::VARCHAR ELSE 'auto' END || chr(10)
    || '- Use bullets: ' || {_yn('require_bullets')} || chr(10) || '- Include references: ' || {_yn('include_references')} ||
    {_cap('Hard constraints:', 'hard', 15)} || {_cap('Soft constraints:', 'soft', 15)} ||
    {_cap('Conflicts detected (resolved by latest instruction):', _split('conflicts'), 10)} ||
    {_cap('Ambiguities detected (defaults applied):', _split('ambiguities'), 10)} ||
    {_cap('Applied defaults:', _split('applied_defaults'), 10)} AS compiled_digest FROM brief_compiled""",
)
def _(spark, d):
    return K.compile_rules(_parsed(spark, d)).select("brief_id", K.compiled_digest().alias("compiled_digest"))


@query(
    "r12_parsed_digest",
    f"""SELECT c.brief_id, 'Required sections: ' || replace(required, '|', ', ') || chr(10) || 'Formatting preferences:' || chr(10)
    || '- Bullets: ' || {_yn('require_bullets')} || chr(10) || '- Numbering: ' || {_yn('require_numbering')} || chr(10) ||
    '- Citation style: ' || citation_seen || chr(10) || '- Tone: ' || tone || chr(10) || '- Alignment: ' || alignment_seen ||
    chr(10) || '- Line spacing: ' || spacing_seen || chr(10) || '- Paragraph spacing: ' || paragraph_spacing || chr(10) ||
    'Structural requirements:' || chr(10) || '- Include references: ' || {_yn('include_references')} || chr(10) ||
    '- Prefer tables: ' || {_yn('prefer_tables')} || chr(10) || '- Prefer images: ' || {_yn('prefer_images')} || chr(10) ||
    '- Max heading depth: ' || max_heading_depth || chr(10) || '- Target length (words): ' || target_words ||
    {_cap('Heading outline:', 'heads', 1000000)} || {_cap('Additional instructions:', 'instr', 20)} ||
    {_cap('Hard constraints:', 'hard', 15)} || {_cap('Soft constraints:', 'soft', 15)} ||
    {_cap('Detected conflicts (resolve with latest instruction):', _split('conflicts'), 10)} ||
    {_cap('Detected ambiguities (apply defaults where needed):', _split('ambiguities'), 10)} AS parsed_digest
    FROM (SELECT c.*, (SELECT list('H' || level || ': ' || title ORDER BY pos) FROM brief_heads h WHERE h.brief_id = c.brief_id)
    AS heads, (SELECT list(t ORDER BY pos) FROM brief_marks m WHERE m.brief_id = c.brief_id AND s <> '' AND s NOT LIKE '#%')
    AS instr FROM brief_compiled c) c""",
)
def _(spark, d):
    return _parsed(spark, d).select("brief_id", K.parsed_digest().alias("parsed_digest"))


@query(
    "r12_reference_digest",
    f"""SELECT doc_id, CASE WHEN NOT enabled THEN '{K.NO_REFERENCE}' ELSE '{K.REFERENCE_INTRO[0]}' || chr(10) ||
    '{K.REFERENCE_INTRO[1]}' || chr(10) || '{K.REFERENCE_INTRO[2]}' || chr(10) || 'Target section order: ' ||
    coalesce(section_order, 'No explicit order detected') || chr(10) || 'Style cues:' || chr(10) || '- Markdown headings: ' ||
    {_yn('uses_markdown_headings')} || chr(10) || '- Numbered sections: ' || {_yn('uses_numbered_sections')} || chr(10) ||
    '- Bullet usage: ' || {_yn('uses_bullets')} || {_cap('Reference heading blueprint:', 'heads', 12)} END AS digest FROM (
    SELECT o.*, (SELECT string_agg({S.strip('title')}, ', ' ORDER BY n) FILTER (n <= 30 AND {S.strip('title')} <> '')
    FROM doc_heads h WHERE h.doc_id = o.doc_id) AS section_order, (SELECT list('H' || level || ': ' || title ORDER BY n)
    FROM doc_heads h WHERE h.doc_id = o.doc_id) AS heads FROM doc_outline o)""",
)
def _(spark, d):
    return K.reference_outline(R.v_doc(spark, d)).select("doc_id", K.reference_digest().alias("digest"))


@query(
    "r12_plan_digest",
    """SELECT doc_id, concat_ws(chr(10), 'SECTION PLAN:', '- Follow this section order exactly using markdown headings (##).',
    '- Auto-generate content for: ' || string_agg(title, ', ' ORDER BY pos) FILTER (mode = 'auto_generate'),
    '- For user-provided sections, include heading only and do not generate substantive content: ' ||
    string_agg(title, ', ' ORDER BY pos) FILTER (mode = 'user_provides'),
    '- Omit skipped sections entirely: ' || string_agg(title, ', ' ORDER BY pos) FILTER (mode = 'skip')) AS digest
    FROM clean_plan GROUP BY doc_id""",
)
def _(spark, d):
    return K.plan_digest(B.normalise_plan(R.v_plan(spark, d)))
