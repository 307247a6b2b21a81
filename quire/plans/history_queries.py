"""Attempts, report history, event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import attempts as A
from quire.operators import history as H
from quire.operators import layers as L
from quire.functions import text as T
from quire.plans import sqltext as S
from quire.plans.base import ctes, query, table
from quire.plans.layer_queries import _wide

_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"
_DETAIL = """CASE event_id % 5 WHEN 0 THEN 'INPUT_VALIDATION: No text for ' || CAST(event_id AS STRING) WHEN 1 THEN
    'RENDER_VALIDATION: low similarity; pages ; ' WHEN 2 THEN 'Output quality validation failed after one retry: missing ' ||
    event_type || ';; short' WHEN 3 THEN 'time-out' ELSE 'Output quality validation failed after one retry' END"""
_ISSUE = """CASE event_type WHEN 'view' THEN '"plain ' || CAST(event_id AS STRING) || '"' WHEN 'click' THEN
    '{"message":"m","severity":"Error","section":"Body"}' WHEN 'signup' THEN '{"code":"c1","severity":"warning"}' WHEN 'purchase'
    THEN '{"severity":"info"}' ELSE '{"message":"","code":"x","severity":"odd"}' END"""
_LINE = """'{"ts":"' || {ts} || '+00:00","event":"' || event_type || '","user_id":' || CAST(user_id AS STRING) || ',"k":' ||
    CAST(event_id % 100 AS STRING)"""

ctes(
    v_att="""SELECT user_id AS report_id, event_id, ts, least(100.0::DOUBLE, value) AS score, row_number() OVER w AS attempt,
        lag(least(100.0::DOUBLE, value)) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    att_delta="SELECT *, CAST(score AS DECIMAL(12,2)) - CAST(prev AS DECIMAL(12,2)) AS delta FROM v_att",
    att_streak="""SELECT report_id, event_id, attempt, score, prev, attempt - last_value(CASE WHEN prev IS NULL OR score > prev THEN attempt
        END IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak,
        attempt >= 3 AND delta <= 0.2 AND coalesce(lag(delta) OVER (PARTITION BY report_id ORDER BY attempt) <= 0.2, false) AS stalled
        FROM att_delta""",
    v_life=f"""SELECT event_id % 500 AS report_id, event_id, ts, user_id, {_STATUS} AS status,
        CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS score,
        CASE WHEN event_type = 'error' THEN props END AS error, CASE WHEN event_type = 'error' AND value > 50 THEN true
        WHEN event_type = 'purchase' THEN false END AS quality_failure FROM events""",
    life_folded="""SELECT report_id, arg_max(status, (ts, event_id)) AS status, arg_max(score, (ts, event_id)) FILTER (score IS NOT NULL)
        AS score, arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS error,
        arg_max(quality_failure, (ts, event_id)) FILTER (quality_failure IS NOT NULL) AS quality_failure,
        arg_min(user_id, (ts, event_id)) AS owner, count(*) AS updates FROM v_life GROUP BY report_id""",
    deletions="""SELECT DISTINCT f.report_id FROM life_folded f JOIN v_life v ON v.report_id = f.report_id AND v.user_id = f.owner
        WHERE v.status = 'failed'""",
    event_gaps="""SELECT event_type AS event, CAST(floor((epoch_us(ts) - epoch_us(prev)) / 1000000.0) AS BIGINT) AS s FROM (
        SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL""",
)


def events(spark, d):
    """events with ts as an instant."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def v_att(spark, d):
    return events(spark, d).select(
        F.col("user_id").alias("report_id"), "event_id", "ts", F.least(F.lit(100.0), F.col("value")).alias("score")
    )


def v_life(spark, d):
    return events(spark, d).selectExpr(
        "event_id % 500 AS report_id",
        "event_id",
        "ts",
        "user_id",
        f"{_STATUS} AS status",
        "CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS score",
        "CASE WHEN event_type = 'error' THEN props END AS error",
        "CASE WHEN event_type = 'error' AND value > 50 THEN true WHEN event_type = 'purchase' THEN false END AS quality_failure",
    )


def _folded(spark, d):
    return H.fold(v_life(spark, d), ["status", "score", "error", "quality_failure"])


@query(
    "q27_attempt_score",
    f"""SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 100.0 ELSE
    {S.round_half_up("coalesce(CAST(CASE WHEN event_type <> 'signup' THEN least(value, 100) END AS DECIMAL(12,4)), 0) * 0.5 + CAST(event_id % 100 AS DECIMAL(12,4)) * 0.3 + CAST((event_id % 11) / 10.0 AS DECIMAL(12,4)) * 20")}
    END AS score FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events")
    similarity = F.when(F.col("event_type") != "signup", F.least(F.col("value"), F.lit(100.0)))
    return e.select(
        "event_id",
        A.attempt_score(
            (F.col("event_type") == "purchase") & (F.col("value") > 50),
            similarity,
            F.col("event_id") % 100,
            (F.col("event_id") % 11).cast("decimal(12,4)") / 10,
        ).alias("score"),
    )


@query(
    "q28_streaks",
    "SELECT report_id, event_id, attempt, score, streak, stalled FROM att_streak",
)
def _(spark, d):
    return A.streaks(v_att(spark, d), ["ts", "event_id"]).select(
        "report_id", "event_id", "attempt", "score", "streak", "stalled"
    )


@query(
    "q28_stop_points",
    """SELECT report_id, attempts, least(a, b) AS stop_attempt, CASE WHEN least(a, b) IS NULL THEN NULL WHEN a = least(a, b) THEN
    'backoff' ELSE 'unlikely' END AS reason FROM (SELECT report_id, count(*) AS attempts, min(attempt) FILTER (streak >= 2) AS a,
    min(attempt) FILTER (stalled) AS b FROM att_streak GROUP BY report_id)""",
)
def _(spark, d):
    return A.stop_points(A.streaks(v_att(spark, d), ["ts", "event_id"]))


@query(
    "q29_delta_class",
    """SELECT report_id, attempt, CASE WHEN prev IS NULL THEN 'first' WHEN score > prev THEN 'up' WHEN score < prev THEN 'down' ELSE
    'flat' END AS class FROM v_att""",
)
def _(spark, d):
    rows = A.numbered(v_att(spark, d), ["ts", "event_id"])
    return rows.select("report_id", "attempt", A.delta_class(F.col("prev"), F.col("score")).alias("class"))


@query(
    "q33_error_classes",
    f"""SELECT event_id, CASE WHEN d LIKE 'INPUT_VALIDATION:%' THEN 'input_validation' WHEN d LIKE 'RENDER_VALIDATION:%' THEN
    'render_validation' WHEN contains(d, '{H.QUALITY_MARK}') THEN 'quality_validation' ELSE 'processing_failure' END AS error_code,
    CASE WHEN d LIKE 'INPUT_VALIDATION:%' THEN trim(d[18:]) WHEN d LIKE 'RENDER_VALIDATION:%' THEN '{H.RENDER_MESSAGE}'
    WHEN contains(d, '{H.QUALITY_MARK}') THEN '{H.QUALITY_MESSAGE}' ELSE '{H.OTHER_MESSAGE}' END AS message,
    CASE WHEN c = 429 THEN 'rate_limited' WHEN c BETWEEN 500 AND 599 THEN 'provider_server_error' WHEN c IN (401, 403) THEN 'auth_error'
    WHEN c BETWEEN 400 AND 499 THEN 'request_error' ELSE 'unknown' END AS category FROM (SELECT event_id, {_DETAIL} AS d,
    395 + event_id % 220 AS c FROM events)""",
)
def _(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{_DETAIL} AS d", "395 + event_id % 220 AS c")
    return e.select(
        "event_id",
        H.error_code(F.col("d")).alias("error_code"),
        H.public_message(F.col("d")).alias("message"),
        H.status_category(F.col("c")).alias("category"),
    )


@query(
    "q34_quality_errors",
    f"""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'low similarity|pages' WHEN 2 THEN 'missing ' || event_type || '|short' ELSE '' END
    AS errors FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{_DETAIL} AS d")
    return e.select("event_id", F.array_join(H.quality_errors(F.col("d")), "|").alias("errors"))


@query(
    "q35_issues",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'plain ' || event_id WHEN 'click' THEN 'm' WHEN 'signup' THEN 'c1' WHEN
    'purchase' THEN 'Validation issue' ELSE 'x' END AS message, CASE event_type WHEN 'click' THEN 'Error' WHEN 'signup' THEN 'warning'
    WHEN 'purchase' THEN 'info' WHEN 'error' THEN 'odd' END AS severity, CASE event_type WHEN 'click' THEN 'Body' END AS section,
    CASE event_type WHEN 'click' THEN 'destructive' WHEN 'signup' THEN 'secondary' WHEN 'purchase' THEN 'outline' ELSE 'default' END AS
    severity_class FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{_ISSUE} AS raw")
    e = e.select("event_id", H.normalise_issue(F.col("raw")).alias("i")).select("event_id", "i.*")
    return e.withColumn("severity_class", H.severity_class(F.col("severity")))


@query(
    "q36_metadata_labels",
    """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'Metadata' ELSE array_to_string(list_transform(string_split(trim(regexp_replace(
    replace(p_name, ' ', '__') || '-' || lower(p_type), '[_-]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS label
    FROM part""",
)
def _(spark, d):
    p = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size = 1 THEN ' _-' ELSE replace(p_name, ' ', '__') || '-' || lower(p_type) END AS k"
    )
    return p.select("p_partkey", T.prettify_label(F.col("k")).alias("label"))


@query(
    "h01_newest_first",
    """SELECT user_id, event_id AS report_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE
    ts END DESC NULLS LAST, event_id) AS rank FROM events""",
)
def _(spark, d):
    e = events(spark, d)
    reports = e.select(
        "user_id", F.col("event_id").alias("report_id"), F.when(F.col("event_type") != "error", F.col("ts")).alias("created_at")
    )
    return H.newest_first(reports).select("user_id", "report_id", "rank")


@query("h02_status_fold", "SELECT * FROM life_folded")
def _(spark, d):
    return _folded(spark, d)


@query(
    "h02_illegal_steps",
    """SELECT report_id, event_id, before, after FROM (SELECT report_id, event_id, status AS after, lag(status) OVER (PARTITION BY report_id
    ORDER BY ts, event_id) AS before FROM v_life) WHERE NOT ((before IS NULL AND after = 'pending') OR coalesce((before = 'pending' AND
    after = 'processing') OR (before = 'processing' AND after IN ('completed', 'failed')), false))""",
)
def _(spark, d):
    return H.illegal_steps(v_life(spark, d))


@query(
    "h03_secondary_state",
    """SELECT report_id, CASE WHEN status = 'processing' AND report_id % 4 = 0 THEN 'Correction retries stopped (backoff triggered)'
    WHEN coalesce(quality_failure, false) THEN 'Quality validation failed' WHEN coalesce(score, updates) IS NOT NULL THEN 'Quality score: '
    || coalesce(score, updates) ELSE '' END AS state FROM life_folded""",
)
def _(spark, d):
    f = _folded(spark, d)
    state = H.secondary_state(
        F.col("status"), F.col("report_id") % 4 == 0, F.col("quality_failure"), F.col("score"), F.col("updates")
    )
    return f.select("report_id", state.alias("state"))


@query("h04_status_counts", "SELECT status, count(*) AS reports FROM life_folded GROUP BY status")
def _(spark, d):
    return _folded(spark, d).groupBy("status").agg(F.count("*").alias("reports"))


def _deleted(spark, d):
    reports = _folded(spark, d).select("report_id", "status", "owner")
    requests = v_life(spark, d).filter("status = 'failed'").select("report_id", F.col("user_id").alias("requester"))
    return H.delete_reports(reports, requests)


@query("h05_reports_kept", "SELECT report_id, status, owner FROM life_folded WHERE report_id NOT IN (SELECT report_id FROM deletions)")
def _(spark, d):
    return _deleted(spark, d)[0]


@query(
    "h05_removed_artifacts",
    "SELECT report_id, 'report_' || report_id || '.pdf|report_' || report_id || '_final.docx' AS files FROM deletions",
)
def _(spark, d):
    rid = F.col("report_id")
    names = H.artifact_names(
        F.concat(F.lit("https://host/files/report "), rid, F.lit(".pdf?v=1")),
        F.concat(F.lit("/files/report_"), rid, F.lit("(final.docx/")),
    )
    return _deleted(spark, d)[1].select("report_id", F.array_join(names, "|").alias("files"))


@query(
    "h06_admission",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'forbidden' WHEN doc_id % 17 = 0 OR doc_id % 23 = 0 THEN 'title_length' WHEN
    length(CASE WHEN doc_id % 19 = 0 THEN '  ' ELSE text END) > 5000 THEN 'content_too_large' WHEN doc_id % 19 = 0 OR trim(text) = ''
    THEN 'empty_content' END AS reject FROM documents""",
)
def _(spark, d):
    req = table(spark, d, "documents").selectExpr(
        "doc_id",
        "doc_id % 50 AS user_id",
        "CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id % 50 END AS token_user",
        "CASE WHEN doc_id % 17 = 0 THEN repeat('t', 301) WHEN doc_id % 23 = 0 THEN '' ELSE source END AS title",
        "'' AS rules",
        "CASE WHEN doc_id % 19 = 0 THEN '  ' ELSE text END AS content",
    )
    return H.admission(req, 5_000).select("doc_id", "reject")


@query(
    "h07_rules_lookup",
    """SELECT report_id, r.entity IS NOT NULL AS found, coalesce(body_size_halfpt, '24') AS body_size_halfpt,
    coalesce(margin_top_dxa, '1440') AS margin_top_dxa FROM life_folded f LEFT JOIN rule_wide r ON r.entity = f.report_id * 4""",
)
def _(spark, d):
    reports = _folded(spark, d).select("report_id", (F.col("report_id") * 4).alias("rules_id"))
    rules = _wide(spark, d).withColumnRenamed("entity", "rules_id")
    # Rules are dealt by entity already, and more than their size estimate says: reports come to them.
    j = reports.join(rules.withColumn("found", F.lit(True)).hint("merge"), "rules_id", "left")
    return j.select(
        "report_id",
        F.coalesce("found", F.lit(False)).alias("found"),
        *[F.coalesce(k, F.lit(L.DEFAULTS[k])).alias(k) for k in ("body_size_halfpt", "margin_top_dxa")],
    )


def _lines(spark, d):
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    end = "CASE WHEN event_type = 'error' AND value < 20 THEN '' ELSE '}' END"
    return table(spark, d, "events").selectExpr("event_id", f"{_LINE.replace('{ts}', stamp)} || {end} AS line")


@query(
    "h09_parsed_events",
    """SELECT event_id, epoch_us(ts) AS micros, event_type AS event, user_id, CAST(event_id % 100 AS INTEGER) AS k FROM events
    WHERE NOT (event_type = 'error' AND value < 20)""",
)
def _(spark, d):
    good, _ = H.parse_events(_lines(spark, d))
    return good.select("event_id", F.unix_micros("ts").alias("micros"), "event", "user_id", "k")


@query("h09_quarantined_lines", "SELECT event_id FROM events WHERE event_type = 'error' AND value < 20")
def _(spark, d):
    return H.parse_events(_lines(spark, d))[1].select("event_id")


@query(
    "h10_stage_latency",
    """SELECT event, count(*) AS n, round(sum(s)::DOUBLE / count(*), 4) AS mean_s, round(quantile_cont(s, 0.5), 4) AS p50_s,
    round(quantile_cont(s, 0.95), 4) AS p95_s FROM event_gaps GROUP BY event""",
)
def _(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "event")
    return H.stage_latency(e)


@query(
    "h10_report_stages",
    """SELECT report_id, stage, count(*) AS runs, sum((us - s + 5) // 10)::DOUBLE / 100 AS elapsed_ms
    FROM (SELECT report_id, us, CASE event_type WHEN 'purchase' THEN 'layout' WHEN 'signup' THEN 'input' END AS stage,
    CASE event_type WHEN 'purchase' THEN last_value(CASE WHEN event_type = 'click' THEN us END IGNORE NULLS) OVER w
    WHEN 'signup' THEN last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER w END AS s
    FROM (SELECT *, event_id % 500 AS report_id, epoch_us(ts) AS us FROM events)
    WINDOW w AS (PARTITION BY report_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WHERE s IS NOT NULL GROUP BY report_id, stage""",
)
def _(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "event").withColumn("report_id", F.col("event_id") % 500)
    spans = H.stage_spans(e, "report_id", {"input": ("view", "signup"), "layout": ("click", "purchase")})
    return H.report_stages(spans, "report_id")


_KINDS = {"candidate": "view", "retry": "click", "selected": "signup", "used": "purchase", "error": "error"}


@query(
    "h17_provider_outcomes",
    "SELECT user_id % 3 AS provider, "
    + ", ".join(f"count(*) FILTER (event_type = '{v}') AS {k}" for k, v in _KINDS.items())
    + " FROM events GROUP BY user_id % 3",
)
def _(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("provider"), "event_type")
    p = e.groupBy("provider").pivot("event_type", list(_KINDS.values())).count()
    return p.select("provider", *[F.coalesce(v, F.lit(0)).alias(k) for k, v in _KINDS.items()])


@query(
    "h18_clipped_records",
    """SELECT doc_id, substr(text, 1, 500) AS author, lang, substr(text, 1, 200) AS font, CASE WHEN text = '' THEN 'unnamed' ELSE
    substr(text, 1, 260) END AS filename, 'application/octet-stream' AS mime, 'content' AS role FROM documents""",
)
def _(spark, d):
    rows = table(spark, d, "documents").selectExpr(
        "doc_id",
        "map('author', text, 'lang', lang) AS metadata",
        "map('bodyFont', text) AS overrides",
        "array(named_struct('filename', text, 'mime', '', 'role', CAST(NULL AS STRING))) AS files",
    )
    c = H.clip_record(rows)
    return c.select(
        "doc_id",
        F.col("metadata")["author"].alias("author"),
        F.col("metadata")["lang"].alias("lang"),
        F.col("overrides")["bodyFont"].alias("font"),
        F.col("files")[0]["filename"].alias("filename"),
        F.col("files")[0]["mime"].alias("mime"),
        F.col("files")[0]["role"].alias("role"),
    )
