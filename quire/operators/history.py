"""Report history: status fold, listings, admission, error classes, event parsing, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.jsontext import is_json
from quire.functions.quantiles import quantiles
from quire.functions.windows import ordered
from quire.session import materialised

# Error prefixes, public messages and the legal status steps.
INPUT_PREFIX, RENDER_PREFIX = "INPUT_VALIDATION:", "RENDER_VALIDATION:"
QUALITY_MARK = "Output quality validation failed after one retry"
RENDER_MESSAGE = "Generated output did not meet render fidelity requirements."
QUALITY_MESSAGE = "Generated output did not meet quality requirements after retry."
OTHER_MESSAGE = "Generation failed due to a temporary processing issue. Please try again."
STEPS = [(None, "pending"), ("pending", "processing"), ("processing", "completed"), ("processing", "failed")]


def newest_first(reports: DataFrame) -> DataFrame:
    """user_id, rank, ...: rank 1 is the newest report of a user, null times last. Counted on sampled pieces."""
    # Descending order is ascending order of the negated time; a null time becomes the largest value.
    late = F.coalesce(-F.unix_micros("created_at"), F.lit(2**62))
    return ordered(reports.withColumn("_late", late), ["user_id"], ["_late", "report_id"], sums={"rank": F.lit(1)}).drop("_late")


def fold(updates: DataFrame, fields: list[str]) -> DataFrame:
    """report_id and the last non-null value of every field, by (ts, event_id)."""
    at = F.struct("ts", "event_id")
    return updates.groupBy("report_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields],
        F.min_by("user_id", at).alias("owner"),
        F.count("*").alias("updates"),
    )


def illegal_steps(updates: DataFrame) -> DataFrame:
    """report_id, event_id, before, after: status changes the lifecycle does not allow."""
    rows = ordered(updates, ["report_id"], ["ts", "event_id"], prevs={"before": F.col("status")})
    legal = F.lit(False)
    for a, b in STEPS:
        legal = legal | (F.col("before").eqNullSafe(F.lit(a)) & (F.col("status") == b))
    return rows.filter(~legal).select("report_id", "event_id", "before", F.col("status").alias("after"))


def secondary_state(status: Column, backoff: Column, quality_failure: Column, score: Column, render: Column) -> Column:
    value = F.coalesce(score, render)
    return (
        F.when((status == "processing") & F.coalesce(backoff, F.lit(False)), "Correction retries stopped (backoff triggered)")
        .when(F.coalesce(quality_failure, F.lit(False)), "Quality validation failed")
        .when(value.isNotNull(), F.concat(F.lit("Quality score: "), value.cast("string")))
        .otherwise("")
    )


def artifact_names(pdf: Column, docx: Column) -> Column:
    return F.array_compact(F.array(T.url_file_name(pdf), T.url_file_name(docx)))


def delete_reports(reports: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): a request deletes a report only when the requester owns it. requests: report_id, requester."""
    allowed = (
        requests.join(reports.select("report_id", F.col("owner").alias("requester")), ["report_id", "requester"])
        .select("report_id")
        .distinct()
    )
    removed = reports.join(allowed, "report_id", "left_semi")
    return reports.join(allowed, "report_id", "left_anti"), removed


def admission(requests: DataFrame, max_content: int, max_title: int = 300, max_rules: int = 10_000) -> DataFrame:
    """Adds reject: null for accepted, else the reason of the first failed test."""
    n = F.length
    reason = (
        F.when(F.col("token_user") != F.col("user_id"), "forbidden")
        .when((n("title") < 1) | (n("title") > max_title), "title_length")
        .when(n("rules") > max_rules, "rules_length")
        .when(n("content") > max_content, "content_too_large")
        .when(T.strip(F.col("content")) == "", "empty_content")
    )
    return requests.withColumn("reject", reason)


def is_quality_failure(detail: Column) -> Column:
    return detail.contains(QUALITY_MARK) | detail.startswith(RENDER_PREFIX)


def error_code(detail: Column) -> Column:
    return (
        F.when(detail.startswith(INPUT_PREFIX), "input_validation")
        .when(detail.startswith(RENDER_PREFIX), "render_validation")
        .when(is_quality_failure(detail), "quality_validation")
        .otherwise("processing_failure")
    )


def public_message(detail: Column) -> Column:
    return (
        F.when(detail.startswith(INPUT_PREFIX), T.strip(detail.substr(F.lit(len(INPUT_PREFIX) + 1), F.length(detail))))
        .when(detail.startswith(RENDER_PREFIX), RENDER_MESSAGE)
        .when(is_quality_failure(detail), QUALITY_MESSAGE)
        .otherwise(OTHER_MESSAGE)
    )


def status_category(code: Column) -> Column:
    return (
        F.when(code == 429, "rate_limited")
        .when(code.between(500, 599), "provider_server_error")
        .when(code.isin(401, 403), "auth_error")
        .when(code.between(400, 499), "request_error")
        .otherwise("unknown")
    )


def quality_errors(detail: Column) -> Column:
    """Parts after the first colon, split at semicolons; only for quality failures."""
    rest = F.when(F.contains(detail, F.lit(":")), detail.substr(F.instr(detail, ":") + 1, F.length(detail)))
    parts = F.filter(F.transform(F.split(rest, ";", -1), T.strip), lambda p: p != "")
    return F.when(is_quality_failure(detail) & rest.isNotNull(), parts).otherwise(F.array().cast("array<string>"))


def normalise_issue(raw: Column) -> Column:
    """struct(message, severity, section) of an issue that is a JSON string or a JSON object."""
    v = F.try_parse_json(raw)
    text = F.schema_of_variant(v) == "STRING"
    get = lambda p: F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))
    message = F.when(text, F.try_variant_get(v, "$", "string")).otherwise(
        F.coalesce(get("$.message"), get("$.code"), F.lit("Validation issue"))
    )
    part = lambda p: F.when(~text, F.try_variant_get(v, p, "string"))
    return F.struct(message.alias("message"), part("$.severity").alias("severity"), part("$.section").alias("section"))


def severity_class(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    return (
        F.when(s.isin("error", "critical"), "destructive")
        .when(s == "warning", "secondary")
        .when(s == "info", "outline")
        .otherwise("default")
    )


EVENT_SCHEMA = "ts TIMESTAMP, event STRING, user_id BIGINT, k INT"


def parse_events(lines: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): JSON lines to typed fields; a line that is no JSON object with an event goes aside."""
    e = F.from_json(column, EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_e", e)
    good = F.col("_e.event").isNotNull() & F.col("_e.ts").isNotNull() & is_json(F.col(column))
    keep = [c for c in lines.columns if c != column]
    return rows.filter(good).select(*keep, "_e.*"), rows.filter(~F.coalesce(good, F.lit(False))).select(*lines.columns)


def stage_gaps(events: DataFrame) -> DataFrame:
    """event, s: whole seconds since the user's previous event, of all events that have one."""
    rows = ordered(events, ["user_id"], ["ts", "event_id"], prevs={"_prev": F.unix_micros("ts")})
    secs = F.floor((F.unix_micros("ts") - F.col("_prev")) / 1_000_000).cast("bigint")
    return rows.filter(F.col("_prev").isNotNull()).select("event", secs.alias("s"))


def stage_latency(events: DataFrame) -> DataFrame:
    """stage, n, mean and percentiles of whole seconds since the user's previous event.

    Latencies are counted per (stage, second) first and written; percentiles are ranks over the counts, so one stage's
    seconds are spread over tasks.
    """
    hist = materialised(stage_gaps(events).groupBy("event", "s").agg(F.count("*").alias("w")), "latencies")
    marks = quantiles(hist, ["event"], {"p50_s": ("s", 0.5), "p95_s": ("s", 0.95)}, F.col("w"), counted=True)
    means = hist.groupBy("event").agg(F.sum("w").alias("n"), F.round(F.sum(F.col("s") * F.col("w")) / F.sum("w"), 4).alias("mean_s"))
    marks = marks.select(F.col("event").alias("_event"), F.round("p50_s", 4).alias("p50_s"), F.round("p95_s", 4).alias("p95_s"))
    return means.join(marks, F.col("event").eqNullSafe(F.col("_event")), "left").drop("_event")


def stage_spans(events: DataFrame, key: str, stages: dict[str, tuple[str, str]]) -> DataFrame:
    """key, stage, event_id, elapsed_ms: each end event with the latest start event of its stage before it.

    stages: name -> (start event, end event). An end without a start has no span.
    """
    micros = F.unix_micros("ts")
    lasts = {f"_s_{n}": F.when(F.col("event") == start, micros) for n, (start, _) in stages.items()}
    rows = ordered(events, [key], ["ts", "event_id"], lasts=lasts)
    stage, began = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for n, (_, end) in stages.items():
        stage = F.when(F.col("event") == end, n).otherwise(stage)
        began = F.when(F.col("event") == end, F.col(f"_s_{n}")).otherwise(began)
    # Milliseconds with two decimals, rounded half up, as exact hundredths.
    rows = rows.select(key, stage.alias("stage"), "event_id", (micros - began + 5).alias("_us"))
    elapsed = (F.expr("_us div 10").cast("decimal(20,0)") / 100).cast("decimal(20,2)")
    return rows.filter(F.col("_us").isNotNull()).select(key, "stage", "event_id", elapsed.alias("elapsed_ms"))


def report_stages(spans: DataFrame, key: str) -> DataFrame:
    """key, stage, runs, elapsed_ms: the stage's time per report."""
    return spans.groupBy(key, "stage").agg(F.count("*").alias("runs"), F.sum("elapsed_ms").cast("double").alias("elapsed_ms"))


def clip_record(rows: DataFrame) -> DataFrame:
    """Clip request maps and file entries to their stored lengths."""
    clip = lambda m, n: F.transform_values(m, lambda _, v: F.substring(v, 1, n))
    files = F.transform(
        "files",
        lambda f: F.struct(
            F.substring(F.coalesce(F.nullif(f["filename"], F.lit("")), F.lit("unnamed")), 1, 260).alias("filename"),
            F.substring(F.coalesce(F.nullif(f["mime"], F.lit("")), F.lit("application/octet-stream")), 1, 200).alias("mime"),
            F.substring(F.coalesce(F.nullif(f["role"], F.lit("")), F.lit("content")), 1, 20).alias("role"),
        ),
    )
    return rows.withColumn("metadata", clip("metadata", 500)).withColumn("overrides", clip("overrides", 200)).withColumn(
        "files", files
    )
