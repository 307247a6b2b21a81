"""Structured Streaming forms of the live views: latest status, windowed counts, sessions, de-duplication, back-off
detection and file ingest.

Sinks are idempotent per micro-batch (a batch overwrites its own folder), so a replayed batch after a lost executor or
driver leaves the result unchanged. State and offsets live under the caller's checkpoint folder.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.attempts import BACKOFF, MIN_DELTA
from quire.sources import ingest as I

# Python functions travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet folder or file as a stream; the schema is taken from what is there."""
    schema = spark.read.parquet(path).schema
    # As a glob the path may be a single file as well as a folder.
    glob = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run over what is available; every micro-batch overwrites ``out/batch=<id>``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def latest_status(events: DataFrame) -> DataFrame:
    """Stream of the newest status per report (update mode)."""
    at = F.struct("ts", "event_id")
    return events.groupBy("report_id").agg(F.max_by("status", at).alias("status"), F.max(at).alias("at"))


def write_current(stream: DataFrame, out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Keep the current row per key of an update-mode stream as one table.

    Each micro-batch is merged into the table before it, whose other rows it takes over. Two slots are written in turn, so
    at most one old version exists, and a replayed batch reads the other slot and writes the same again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        if batch_id > 0:
            before = batch.sparkSession.read.schema(rows.schema).parquet(f"{out}/slot={(batch_id - 1) % 2}")
            kept = before.join(batch.select(key), key, "left_anti").withColumn("batch", F.lit(batch_id).cast("bigint"))
            rows = rows.unionByName(kept)
        rows.write.mode("overwrite").parquet(f"{out}/slot={batch_id % 2}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def read_current(spark: SparkSession, out: str) -> DataFrame:
    """The table that ``write_current`` keeps."""
    both = spark.read.parquet(out)
    newest = both.agg(F.max("batch")).first()[0]
    return both.filter(F.col("batch") == F.lit(newest)).drop("batch", "slot")


def windowed_counts(events: DataFrame, size: str, slide: str | None, delay: str) -> DataFrame:
    """start, end, event, n per tumbling or sliding window; rows behind the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = events.withWatermark("ts", delay).groupBy(w, "event").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event", "n")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """user_id, start, end, n: events of a user separated by at most ``gap``."""
    s = F.session_window("ts", gap)
    counts = events.withWatermark("ts", delay).groupBy(s, "user_id").agg(F.count("*").alias("n"))
    return counts.select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


def batch_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Batch twin of ``sessions``: a new session starts after a gap; numbered on sampled pieces."""
    from quire.functions.windows import Ordered

    pieces = Ordered(events, ["user_id"], ["ts", "event_id"])
    rows = pieces.running(pieces.rows, prevs={"_prev": F.unix_micros("ts")})
    fresh = F.col("_prev").isNull() | (F.unix_micros("ts") - F.col("_prev") >= gap_seconds * 1_000_000)
    rows = pieces.running(rows, sums={"session": F.coalesce(fresh.cast("int"), F.lit(1))})
    return rows.groupBy("user_id", "session").agg(
        F.min("ts").alias("start"), (F.max("ts") + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("end"), F.count("*").alias("n")
    )


def deduplicated(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First event per key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


STATE = "reports string"
OUTPUT = "report_id long, stop_attempt int, reason string"
#: A report without scores for longer than this, in event time, is forgotten, finished or not: the next score is its first.
IDLE_MS = 400 * 24 * 3600 * 1000
#: Groups of reports that share a cell of state and a call of Python.
SLOTS = 4096
SMALL = int(Decimal(str(MIN_DELTA)) * 100)


def _cents(score: float) -> int:
    return int(Decimal(repr(score)).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100)


def _detector(idle_ms: int) -> Callable:
    fresh = (0, None, None, 0, False)

    def advance(own: list, mark: int) -> Iterator[tuple[int, str]]:
        """Move one report on by the scores the watermark has passed; later ones keep waiting. Gives its stop once."""
        attempt, prev, delta, streak, done, last, waiting = own
        waiting.sort(key=lambda w: (w[0], w[1]))
        ready = 0
        while ready < len(waiting) and waiting[ready][0] <= mark * 1000:
            us, _, score = waiting[ready]
            ready += 1
            if last is not None and us - last > idle_ms * 1000:
                attempt, prev, delta, streak, done = fresh
            last = us
            if done:
                continue
            attempt += 1
            before, delta = delta, (None if prev is None else _cents(score) - _cents(prev))
            streak = streak + 1 if prev is not None and score <= prev else 0
            prev = score
            stalled = attempt >= 3 and before is not None and delta <= SMALL and before <= SMALL
            if streak >= BACKOFF or stalled:
                done = True
                yield attempt, "backoff" if streak >= BACKOFF else "unlikely"
        own[:] = attempt, prev, delta, streak, done, last, waiting[ready:]

    def detect(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Advance the reports of one slot, each on its own."""
        reports = dict(json.loads(state.get[0])) if state.exists else {}
        for chunk in chunks:
            for nobody, report, *score in zip(*(chunk[c].tolist() for c in ("nobody", "report_id", "us", "event_id", "score")), strict=True):
                reports.setdefault(None if nobody else report, [*fresh, None, []])[-1].append(score)
        mark = state.getCurrentWatermarkMs()
        stops, wakes = [], []
        for report, own in [*reports.items()]:
            stops.extend((report, *stop) for stop in advance(own, mark))
            *_, last, waiting = own
            # Woken when the watermark reaches the first waiting score, else when the report has been idle.
            wake = waiting[0][0] // 1000 - 1 if waiting else last // 1000 + idle_ms
            if not waiting and wake < mark:
                del reports[report]
            else:
                wakes.append(wake)
        if stops:
            ids, attempts, reasons = zip(*stops, strict=True)
            yield pd.DataFrame({"report_id": pd.array(ids, "Int64"), "stop_attempt": attempts, "reason": reasons})
        if not reports:
            state.remove()
            return
        state.update((json.dumps([*reports.items()]),))
        state.setTimeoutTimestamp(max(min(wakes), mark))

    return detect


def backoff_stops(scores: DataFrame, delay: str, idle_ms: int = IDLE_MS, slots: int = SLOTS) -> DataFrame:
    """Stop point per report as scores arrive in any order. scores: report_id, event_id, ts, score.

    A score counts once the watermark, ``delay`` behind the newest score of all, has passed it, so within the delay the
    order of arrival and the cut of the micro-batches change nothing and the answer is that of the batch job; scores that
    come later are dropped, as are null ones. State per report: six values and the scores of the last ``delay``; it is removed once the
    report has been idle for ``idle_ms``. A call of Python and its state cell serve all reports of a slot, as a call per
    report costs more than its work; ``slots`` may grow with the number of reports, to some hundred reports each, and stays
    as it is for the life of a checkpoint.
    """
    timed = scores.filter("score is not null").withWatermark("ts", delay)
    slot = F.pmod(F.xxhash64("report_id"), F.lit(slots)).alias("slot")
    report = F.coalesce("report_id", F.lit(0).cast("long")).alias("report_id")
    timed = timed.select(slot, F.isnull("report_id").alias("nobody"), report, "event_id", "ts", "score", F.unix_micros("ts").alias("us"))
    return timed.groupBy("slot").applyInPandasWithState(_detector(idle_ms), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ingested_files(files: DataFrame) -> DataFrame:
    """Streaming ingest: the same narrow column functions as the batch job."""
    return I.ingest(files)
