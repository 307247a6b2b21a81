"""Q1-Q16, Q20: text signals, scores, validation reports, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import briefs as K
from quire.operators import scoring as Q
from quire.plans import relations as R
from quire.plans import sqltext as S
from quire.plans.base import ctes, query, table
from quire.plans.text_queries import _three, _union

_RE2_M = "(?m)"


def _re(p: str) -> str:
    """Java multiline flags to the SQL engine's: line feeds are its only line ends already."""
    return p.replace("(?md)", "(?m)").replace("(?imd)", "(?im)")


LONG = (
    "len(list_filter(regexp_split_to_array(text, '\\n" + T.WS + "*\\n'), lambda p: length(" + S.strip("p")
    + ") > 1200 AND NOT contains(" + S.strip("p") + ", chr(10)))) > 0"
)
HEADS = f"CAST({S.count_re('text', _re(T.HEADING_LINE))} AS INTEGER)"
BULLETS = f"regexp_matches(text, '{_re(T.HAS_BULLET)}')"
REFS = f"regexp_matches(text, '{_re(T.HAS_REFERENCES)}')"
ARTIFACTS = f"CAST(len(list_filter(regexp_extract_all(text, '{T.WORD}'), lambda w: regexp_full_match(w, '\\p{{Nd}}{{6,9}}'))) AS INTEGER)"

ctes(
    corpus_text="""SELECT 'conv' AS corpus, doc_id, text FROM v_conv UNION ALL SELECT 'doc', doc_id, text FROM v_doc
        UNION ALL SELECT 'page', doc_id, text FROM v_page_text""",
    signals=f"""SELECT corpus, doc_id, {S.words('text')} AS words, {HEADS} AS heads, {BULLETS} AS bullets, {LONG} AS long_par,
        {ARTIFACTS} AS artifacts FROM corpus_text""",
    conv_brief="""SELECT c.doc_id, c.text, lower(c.text) AS low, k.* FROM v_conv c LEFT JOIN brief_compiled k
        ON k.brief_id = c.doc_id // 4294967296 + c.doc_id % 4294967296""",
    conv_required="SELECT doc_id, unnest(string_split(required, '|')) AS section, unnest(range(99)) AS ord FROM conv_brief",
    conv_need="SELECT doc_id, section, ord, CASE WHEN section = 'body' THEN 25 ELSE 15 END AS minimum FROM conv_required WHERE section IS NOT NULL",
    conv_state=f"""SELECT n.doc_id, n.ord, upper(n.section[1]) || n.section[2:] AS name, n.section, n.minimum,
        s.section IS NOT NULL AS present, coalesce(s.words, 0) AS words, coalesce(s.body, '') <> '' AS filled
        FROM conv_need n LEFT JOIN (SELECT doc_id, section, body, {S.words('body')} AS words FROM conv_sections) s
        ON s.doc_id = n.doc_id AND s.section = n.section""",
    conv_violations=f"""SELECT doc_id, ord, rule, severity, penalty FROM (
        SELECT doc_id, 1 AS ord, 'require_bullets' AS rule, 'medium' AS severity, 10 AS penalty FROM conv_brief
            WHERE require_bullets AND NOT {BULLETS}
        UNION ALL SELECT doc_id, 2, 'include_references', 'medium', 10 FROM conv_brief WHERE include_references AND NOT {REFS}
        UNION ALL SELECT doc_id, 3, 'citation_style', 'low', 6 FROM conv_brief WHERE citation_style <> 'none' AND NOT CASE WHEN
            citation_style = 'IEEE' THEN regexp_matches(text, '{T.CITE_NUMBER}') ELSE regexp_matches(text, '{T.CITE_AUTHOR}') END
        UNION ALL SELECT doc_id, 100 + i, h, 'high', 12 FROM (SELECT doc_id, low, unnest(hard) AS h, unnest(range(len(hard)))
            AS i FROM conv_brief) WHERE NOT contains(low, lower(h))
        UNION ALL SELECT doc_id, 10000 + i, h, 'low', 3 FROM (SELECT doc_id, low, unnest(soft) AS h, unnest(range(len(soft)))
            AS i FROM conv_brief) WHERE NOT contains(low, lower(h)))""",
    conv_penalty="""SELECT b.doc_id, CAST(coalesce(sum(penalty), 0) AS INTEGER) AS penalty,
        coalesce(string_agg(rule || ':' || severity, '|' ORDER BY ord), '') AS violations,
        coalesce(bool_or(rule = 'citation_style'), false) AS v_cite, coalesce(bool_or(rule = 'require_bullets'), false) AS v_bul,
        coalesce(bool_or(rule = 'include_references'), false) AS v_ref, count(rule) AS v_count
        FROM conv_brief b LEFT JOIN conv_violations v ON v.doc_id = b.doc_id GROUP BY b.doc_id""",
    conv_counts="""SELECT doc_id, count(*) FILTER (NOT present) AS missing, count(*) FILTER (present AND words < minimum) AS weak,
        coalesce(string_agg(CASE WHEN NOT present THEN name END, '|' ORDER BY ord), '') AS missing_names,
        coalesce(string_agg(CASE WHEN present AND words < minimum THEN name END, '|' ORDER BY ord), '') AS weak_names,
        coalesce(string_agg(DISTINCT CASE WHEN NOT present OR words < minimum THEN name END, '|' ORDER BY
            CASE WHEN NOT present OR words < minimum THEN name END), '') AS weak_sections,
        count(*) FILTER (NOT filled) AS no_content, count(*) FILTER (filled AND words < minimum) AS too_short
        FROM conv_state GROUP BY doc_id""",
    conv_errors=f"""SELECT doc_id, ord, message FROM (
        SELECT doc_id, 0 AS ord, '{Q.EMPTY}' AS message FROM v_conv WHERE {S.strip('text')} = ''
        UNION ALL SELECT doc_id, 1, '{Q.FEW_HEADINGS}' FROM signals WHERE corpus = 'conv' AND heads < 3
        UNION ALL SELECT doc_id, 100 + ord, '{Q.MISSING}' || name FROM conv_state WHERE NOT present
        UNION ALL SELECT doc_id, 1000 + ord, CASE WHEN NOT filled THEN '{Q.NO_CONTENT}' || name ELSE 'Section too short (' ||
            words || ' words): ' || name || ' (minimum ' || minimum || ')' END FROM conv_state WHERE NOT filled OR words < minimum
        UNION ALL SELECT doc_id, 5000, '{Q.LONG}' FROM signals WHERE corpus = 'conv' AND long_par
        UNION ALL SELECT doc_id, 5001, '{Q.HAS_PLACEHOLDER}' FROM v_conv WHERE contains(text, '{Q.PLACEHOLDER}'))""",
    conv_report=f"""SELECT g.doc_id, g.heads AS heading_count, g.words AS total_words, e.n AS error_count, e.texts AS errors,
        CASE WHEN g.words < 180 THEN '{Q.VERY_SHORT}' ELSE '' END AS warnings, c.missing_names, c.weak_names, c.weak_sections,
        greatest(0.0, 100.0 - 18 * e.n - CASE WHEN g.words < 180 THEN 4 ELSE 0 END) AS quality,
        greatest(0.0, 100.0 - 18 * c.missing - 10 * c.weak - CASE WHEN g.long_par THEN 12 ELSE 0 END) AS structure,
        greatest(0.0, 100.0 - CASE WHEN g.heads < 3 THEN 20 ELSE 0 END - CASE WHEN g.long_par THEN 25 ELSE 0 END -
            CASE WHEN g.bullets THEN 0 ELSE 5 END) AS formatting,
        greatest(0.0, 100.0 - p.penalty) AS rule_score, p.penalty, p.violations, p.v_cite, p.v_bul, p.v_ref, p.v_count,
        g.artifacts, c.too_short, c.missing, g.long_par,
        (SELECT count(*) - 1 FROM conv_sections s WHERE s.doc_id = g.doc_id) AS detected
        FROM (SELECT * FROM signals WHERE corpus = 'conv') g JOIN conv_counts c ON c.doc_id = g.doc_id
        JOIN conv_penalty p ON p.doc_id = g.doc_id JOIN (SELECT v.doc_id, count(message) AS n,
        coalesce(string_agg(message, '|' ORDER BY ord), '') AS texts FROM v_conv v LEFT JOIN conv_errors e
        ON e.doc_id = v.doc_id GROUP BY v.doc_id) e ON e.doc_id = g.doc_id""",
    conv_hints=f"""SELECT doc_id, CASE WHEN h <> '' THEN h WHEN warnings <> '' THEN '{Q.SUGGEST_DEPTH}' ELSE '' END AS suggestions
        FROM (SELECT doc_id, warnings, concat_ws('|', CASE WHEN missing > 0 THEN '{Q.SUGGEST_HEADINGS}' END,
        CASE WHEN too_short > 0 THEN '{Q.SUGGEST_EXPAND}' END, CASE WHEN long_par THEN '{Q.SUGGEST_SPLIT}' END,
        CASE WHEN v_cite THEN '{Q.SUGGEST_CITE}' END, CASE WHEN v_bul THEN '{Q.SUGGEST_BULLETS}' END,
        CASE WHEN v_ref THEN '{Q.SUGGEST_REFERENCES}' END) AS h FROM conv_report)""",
    v_cand="SELECT doc_id // 4 AS item, doc_id % 4 AS rank, 'src' || doc_id AS name, text FROM documents",
    cand_scores=f"""SELECT item, rank, name, text, CAST(round(CAST(
        CASE WHEN contains(lower(text), 'introduction') THEN 25 ELSE 0 END + CASE WHEN contains(lower(text), 'body') THEN 20
        ELSE 0 END + CASE WHEN contains(lower(text), 'conclusion') THEN 25 ELSE 0 END + least({HEADS} * 4, 20) AS DECIMAL(18,4))
        + CAST(least({S.count_re('text', '(?m)^' + T.WS + '*[-*]' + T.WS + '+')} * 1.5, 10) AS DECIMAL(18,4))
        + CAST(least(length(text) / 200.0, 20) AS DECIMAL(18,4)) - CASE WHEN length(text) < 300 THEN 20 ELSE 0 END, 3) AS DOUBLE)
        AS score FROM v_cand""",
)


def _docs_with_brief(spark, d):
    return R.v_conv(spark, d).withColumn("brief_id", F.expr(f"doc_id div {R.IDS} + doc_id % {R.IDS}"))


def _rules(spark, d):
    docs = _docs_with_brief(spark, d).select("doc_id", "brief_id", F.col("text").alias("doc_text"))
    joined = docs.join(R.v_brief(spark, d), "brief_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return K.compile_rules(K.parse(joined, keep=("doc_id", "doc_text")))


def _report(spark, d):
    return Q.report(_docs_with_brief(spark, d), R.v_brief(spark, d))


def _signal(name, expr):
    def run(spark, d):
        return _union(
            docs.select(F.lit(n).alias("corpus"), "doc_id", expr(F.col("text")).alias(name)) for n, docs in _three(spark, d)
        )

    return run


query("q01_word_count", "SELECT corpus, doc_id, words FROM signals")(_signal("words", T.word_count))
query("q02_heading_count", "SELECT corpus, doc_id, heads FROM signals")(_signal("heads", Q.heading_count))
query("q03_has_bullets", "SELECT corpus, doc_id, bullets FROM signals")(_signal("bullets", T.has_bullets))
query("q04_long_paragraph", "SELECT corpus, doc_id, long_par FROM signals")(_signal("long_par", T.has_long_paragraph))
query("q05_artifact_numbers", "SELECT corpus, doc_id, artifacts > 0 AS has_artifacts, artifacts FROM signals")(
    lambda spark, d: _signal("artifacts", T.artifact_count)(spark, d).withColumn("has_artifacts", F.col("artifacts") > 0)
)


@query("q06_missing_sections", "SELECT doc_id, section FROM conv_state WHERE NOT present")
def _(spark, d):
    return Q.missing_sections(R.v_conv(spark, d), _rules(spark, d).select("doc_id", "required"))


@query(
    "q07_weak_sections",
    "SELECT doc_id, section, words, CAST(minimum AS INTEGER) AS minimum FROM conv_state WHERE present AND words < minimum",
)
def _(spark, d):
    return Q.weak_sections(R.v_conv(spark, d), _rules(spark, d).select("doc_id", "required"))


@query(
    "q08_structure_score",
    """SELECT doc_id, CAST(structure AS DOUBLE) AS structure_score, missing_names AS missing, weak_names AS weak,
    CAST(detected AS INTEGER) AS detected_sections FROM conv_report""",
)
def _(spark, d):
    return _report(spark, d).select(
        "doc_id",
        "structure_score",
        F.array_join("missing", "|").alias("missing"),
        F.array_join("weak", "|").alias("weak"),
        "detected_sections",
    )


@query(
    "q09_formatting_score",
    """SELECT corpus, doc_id, CAST(greatest(0, 100 - CASE WHEN heads < 3 THEN 20 ELSE 0 END - CASE WHEN long_par THEN 25 ELSE 0
    END - CASE WHEN bullets THEN 0 ELSE 5 END) AS DOUBLE) AS formatting_score FROM signals""",
)
def _(spark, d):
    return _signal("formatting_score", Q.formatting_score)(spark, d)


@query(
    "q10_rule_compliance",
    """SELECT p.doc_id, CAST(greatest(0, 100 - penalty) AS DOUBLE) AS rule_score, penalty, violations,
    CAST(2 + CASE WHEN citation_style <> 'none' THEN 1 ELSE 0 END + coalesce(len(hard), 0) + coalesce(len(soft), 0) AS INTEGER)
    AS checks FROM conv_penalty p JOIN conv_brief b ON b.doc_id = p.doc_id""",
)
def _(spark, d):
    r = _rules(spark, d).select("doc_id", Q.violations(F.col("doc_text")).alias("v"), Q.check_count().alias("checks"))
    return r.select(
        "doc_id",
        Q._score(Q.total_penalty(F.col("v"))).alias("rule_score"),
        Q.total_penalty(F.col("v")).alias("penalty"),
        F.array_join(F.transform("v", lambda x: F.concat(x["rule"], F.lit(":"), x["severity"])), "|").alias("violations"),
        "checks",
    )


@query(
    "q11_validation_report",
    f"""SELECT r.doc_id, error_count = 0 AS ok, errors, warnings, heading_count, total_words, CAST(quality AS DOUBLE) AS
    quality_score, CAST(structure AS DOUBLE) AS structure_score, CAST(formatting AS DOUBLE) AS formatting_score,
    CAST(rule_score AS DOUBLE) AS rule_score, penalty, {S.round_half_up('greatest(0.0, CAST(structure AS DECIMAL(12,2)) * 0.45 + CAST(formatting AS DECIMAL(12,2)) * 0.25 + CAST(rule_score AS DECIMAL(12,2)) * 0.30 - penalty)')} AS enhanced_score,
    violations, weak_sections, artifacts AS artifact_numbers, h.suggestions FROM conv_report r JOIN conv_hints h
    ON h.doc_id = r.doc_id""",
)
def _(spark, d):
    return _report(spark, d).select(
        "doc_id",
        "ok",
        F.array_join("errors", "|").alias("errors"),
        F.array_join("warnings", "|").alias("warnings"),
        "heading_count",
        "total_words",
        "quality_score",
        "structure_score",
        "formatting_score",
        "rule_score",
        "penalty",
        "enhanced_score",
        F.array_join(F.transform("violations", lambda x: F.concat(x["rule"], F.lit(":"), x["severity"])), "|").alias(
            "violations"
        ),
        F.array_join("weak_sections", "|").alias("weak_sections"),
        "artifact_numbers",
        F.array_join("suggestions", "|").alias("suggestions"),
    )


@query("q12_suggestions", "SELECT * FROM conv_hints")
def _(spark, d):
    return _report(spark, d).select("doc_id", F.array_join("suggestions", "|").alias("suggestions"))


@query(
    "q13_correction_buckets",
    """SELECT doc_id, contains(i, 'missing required section heading') AS missing_headings,
    contains(i, 'section too short') OR contains(i, 'insufficient heading') OR contains(i, 'very long') AS poor_structure,
    contains(i, 'paragraph') OR contains(i, 'placeholder') OR contains(i, 'heading') AS formatting_inconsistencies,
    v_count > 0 AS rule_violations FROM (SELECT *, lower(errors || '|' || warnings) AS i FROM conv_report)""",
)
def _(spark, d):
    return _report(spark, d).select("doc_id", *[c.alias(n) for n, c in Q.correction_buckets().items()])


@query(
    "q14_candidate_score", "SELECT CAST(substr(name, 4) AS BIGINT) AS doc_id, score FROM cand_scores"
)
def _(spark, d):
    return R.v_doc(spark, d).select("doc_id", Q.candidate_score(F.col("text")).alias("score"))


def _cands(spark, d):
    return table(spark, d, "documents").select(
        F.expr("doc_id div 4").alias("item"),
        (F.col("doc_id") % 4).alias("rank"),
        F.concat(F.lit("src"), "doc_id").alias("name"),
        "text",
    )


@query(
    "q15_best_candidate",
    "SELECT item, arg_max(name, score * 10 - rank * 0.001) AS name, max(score) AS score FROM cand_scores GROUP BY item",
)
def _(spark, d):
    return Q.best_candidate(_cands(spark, d))


@query(
    "q16_first_usable",
    """SELECT item, coalesce(arg_min(name, rank) FILTER (length(text) >= 400), 'rule_based') AS name FROM v_cand GROUP BY item""",
)
def _(spark, d):
    # A provider counts as silent when its text is too short to use.
    cands = _cands(spark, d).withColumn("text", F.when(F.length("text") >= 400, F.col("text")))
    return Q.first_usable(cands)


@query(
    "q20_render_penalties",
    f"""SELECT doc_id, b * 8 + r * 8 + c * 5 AS penalty, CAST(greatest(0, 100 - b * 8 - r * 8 - c * 5) AS DOUBLE) AS score,
    concat_ws('|', CASE WHEN b = 1 THEN 'require_bullets' END, CASE WHEN r = 1 THEN 'include_references' END,
    CASE WHEN c = 1 THEN 'citation_style' END) AS violations FROM (SELECT doc_id,
    CASE WHEN require_bullets AND NOT {BULLETS} THEN 1 ELSE 0 END AS b,
    CASE WHEN include_references AND NOT {REFS} THEN 1 ELSE 0 END AS r,
    CASE WHEN citation_style <> 'none' AND NOT regexp_matches(text, '{T.CITE_AUTHOR}|{T.CITE_NUMBER}') THEN 1 ELSE 0 END AS c
    FROM conv_brief)""",
)
def _(spark, d):
    r = _rules(spark, d).select("doc_id", Q.violations(F.col("doc_text"), render=True).alias("v"))
    return r.select(
        "doc_id",
        Q.total_penalty(F.col("v")).alias("penalty"),
        Q._score(Q.total_penalty(F.col("v"))).alias("score"),
        F.array_join(F.transform("v", lambda x: x["rule"]), "|").alias("violations"),
    )
