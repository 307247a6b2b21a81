"""The registered queries of these operators, and their SQL where SQL can say them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, divergence, embed, exact, filteraudit, hpylm, langid, linededup, packing, pii, simhash, tokencount


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers find this library where the driver found it, whatever their working folder."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [ROOT, *paths]))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.linked(table(spark, sf_dir, "embeddings"))


def op3_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scored(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.document_token_counts(table(spark, sf_dir, "documents"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    table(spark, sf_dir, "documents")
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_embedding_near_dedup, op3_pitman_yor_scores, op4_byte_bpe, op5_token_counts, op6_pii_pseudonyms, op7_simhash, op8_best_fit_packing, op9_line_dedup, op10_language_id, op11_filter_audit, op12_source_divergence, op13_decontamination, pipeline)}

SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (
            SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
        c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
               vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a""",
    "op11_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        d AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
                    'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS f
            FROM w LEFT JOIN lab USING (doc_id)),
        m AS (
            SELECT part, map(['A', 'B', 'C', 'D', 'E'], [f.A, f.B, f.C, f.D, f.E]) AS f, count(*) AS n,
                   count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
        hits AS (
            SELECT part, o, step, o[step] AS l, n, good, toxic, f[o[step]] AS own,
                   len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 AS earlier,
                   len(list_filter(o, lambda x: f[x])) = 1 AS lone FROM m, steps),
        r AS (
            SELECT part, o, step, l, coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS removed,
                   coalesce(sum(n) FILTER (own AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (own AND lone), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (own AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT earlier), 0) AS toxic_lost
            FROM hits GROUP BY ALL)
        SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
        FROM r""",
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        occ AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL HAVING count(DISTINCT k) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        n AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        total AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
            FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
            LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        out AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM out)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
        WHERE part = 'pair' OR rank <= 10""",
    "op13_decontamination": r"""
        WITH it AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, len(w) AS size, w AS grams FROM it WHERE len(w) BETWEEN 1 AND 9
            UNION ALL
            SELECT DISTINCT item_id, 10, w[i:i + 9] FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM it WHERE len(w) >= 10)),
        d AS (
            SELECT row_number() OVER () AS k, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        sizes AS (SELECT DISTINCT CAST(size AS BIGINT) AS size FROM win),
        spot AS (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes),
        found AS (SELECT k, i, spot.size, item_id FROM spot JOIN win ON win.size = spot.size AND win.grams = spot.w[spot.i:spot.i + spot.size - 1]),
        hit AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS pos FROM found) GROUP BY k),
        ids AS (SELECT k, list_sort(list(DISTINCT item_id)) AS ids FROM found WHERE item_id IS NOT NULL GROUP BY k)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
               sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (k) LEFT JOIN ids USING (k)""",
}
