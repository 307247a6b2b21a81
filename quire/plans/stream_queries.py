"""Streaming jobs run over the stored events, compared with their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.plans.base import ctes, query, table
from quire.plans.history_queries import _STATUS
from quire.plans.source_queries import v_file
from quire.session import checkpoint_root
from quire.streaming import live as V

DELAY_S = 600


def _run(spark, stream, name, mode, prepare=None):
    # A fresh folder per run, so a rerun starts from nothing.
    root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    q = V.write_batches(stream, f"{root}/out", f"{root}/state", mode, prepare)
    q.awaitTermination()
    return V.read_batches(spark, f"{root}/out")


def _events(spark, d):
    s = V.read_stream(spark, f"{d.rstrip('/')}/events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _time(c):
    return F.unix_micros(c)


ctes(
    stream_end=f"SELECT max(epoch_us(ts)) - {DELAY_S}000000 AS mark FROM events",
    gap_sessions="""SELECT user_id, session, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 3600000000 AS end_us, count(*) AS n
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN prev IS NULL OR
        epoch_us(ts) - epoch_us(prev) >= 3600000000 THEN 1 ELSE 0 END AS fresh FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id
        ORDER BY ts, event_id) AS prev FROM events))) GROUP BY user_id, session""",
)


@query(
    "h11_live_status",
    f"""SELECT report_id, arg_max(status, (ts, event_id)) AS status, max(event_id) FILTER (last) AS event_id FROM (SELECT *,
    row_number() OVER (PARTITION BY report_id ORDER BY ts DESC, event_id DESC) = 1 AS last FROM v_life) GROUP BY report_id""",
)
def _(spark, d):
    life = _events(spark, d).selectExpr("event_id % 500 AS report_id", "event_id", "ts", f"{_STATUS} AS status")
    root = f"{checkpoint_root(spark)}/status-{uuid.uuid4().hex}"
    V.write_current(V.latest_status(life), f"{root}/out", f"{root}/state", "report_id").awaitTermination()
    return V.read_current(spark, f"{root}/out").select("report_id", "status", F.col("at.event_id").alias("event_id"))


@query(
    "h12_tumbling_counts",
    """SELECT w * 3600000000 AS start_us, event, n FROM (SELECT epoch_us(ts) // 3600000000 AS w, event_type AS event, count(*) AS n
    FROM events GROUP BY ALL), stream_end WHERE (w + 1) * 3600000000 <= mark""",
)
def _(spark, d):
    e = _events(spark, d).withColumnRenamed("event_type", "event")
    out = _run(spark, V.windowed_counts(e, "1 hour", None, f"{DELAY_S} seconds"), "tumbling", "append")
    return out.select(_time("start").alias("start_us"), "event", "n")


@query(
    "h12_sliding_counts",
    """SELECT w * 1800000000 AS start_us, event, n FROM (SELECT w, event, count(*) AS n FROM (SELECT event_type AS event,
    unnest([epoch_us(ts) // 1800000000 - 1, epoch_us(ts) // 1800000000]) AS w FROM events) GROUP BY w, event), stream_end
    WHERE w * 1800000000 + 3600000000 <= mark""",
)
def _(spark, d):
    e = _events(spark, d).withColumnRenamed("event_type", "event")
    out = _run(spark, V.windowed_counts(e, "1 hour", "30 minutes", f"{DELAY_S} seconds"), "sliding", "append")
    return out.select(_time("start").alias("start_us"), "event", "n")


@query(
    "h13_live_sessions",
    "SELECT user_id, start_us, end_us, n FROM gap_sessions, stream_end WHERE end_us <= mark",
)
def _(spark, d):
    out = _run(spark, V.sessions(_events(spark, d), "1 hour", f"{DELAY_S} seconds"), "sessions", "append")
    return out.select("user_id", _time("start").alias("start_us"), _time("end").alias("end_us"), "n")


@query("h13_batch_sessions", "SELECT user_id, start_us, end_us, n FROM gap_sessions")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = V.batch_sessions(e, 3600)
    return out.select("user_id", _time("start").alias("start_us"), _time("end").alias("end_us"), "n")


@query("h14_deduplicated", "SELECT event_id, user_id FROM events")
def _(spark, d):
    # Every event arrives twice (a retry); the stream keeps one.
    e = _events(spark, d)
    twice = e.unionByName(e)
    return _run(spark, V.deduplicated(twice, ["event_id"], "1 hour"), "dedup", "append").select("event_id", "user_id")


@query("h14_batch_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates()


@query(
    "h15_backoff_stops",
    """SELECT report_id, CAST(least(a, b) AS INTEGER) AS stop_attempt, CASE WHEN a = least(a, b) THEN 'backoff' ELSE 'unlikely' END AS reason
    FROM (SELECT report_id, min(attempt) FILTER (streak >= 2) AS a, min(attempt) FILTER (stalled) AS b FROM att_streak
    JOIN (SELECT event_id FROM events, stream_end WHERE epoch_us(ts) <= mark) USING (event_id) GROUP BY report_id) WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def _(spark, d):
    scores = _events(spark, d).select(
        F.col("user_id").alias("report_id"), "event_id", "ts", F.least(F.lit(100.0), F.col("value")).alias("score")
    )
    return _run(spark, V.backoff_stops(scores, f"{DELAY_S} seconds"), "backoff", "append").drop("batch")


@query(
    "h16_streaming_ingest",
    """SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, kind, level, text FROM corpus_blocks WHERE corpus = 'doc' AND doc_id % 97 <> 0""",
)
def _(spark, d):
    files = V.read_stream(spark, f"{d.rstrip('/')}/documents.parquet").select(
        F.lit(0).alias("job_id"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("mime"),
        F.lit("content").alias("role"),
        F.when(F.col("doc_id") % 97 == 0, "@@@").otherwise(F.base64(F.encode("text", "UTF-8"))).alias("payload"),
    )

    def to_blocks(batch):
        return B.blocks(batch.filter("status = 'processed'").select(F.col("pos").alias("doc_id"), "text"))

    return _run(spark, V.ingested_files(files), "ingest", "append", to_blocks).drop("batch")
