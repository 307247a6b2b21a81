"""Streams over several micro-batches, restarts and late rows; stores and files."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import attempts
from quire.operators.registry import append_only
from quire.session import checkpoint_root
from quire.sources import ingest, stores
from quire.streaming import live


def _files(spark, rows, schema, folder, per_file):
    for n in range(0, len(rows), per_file):
        part = spark.createDataFrame(rows[n : n + per_file], schema).coalesce(1)
        part.write.mode("append").parquet(folder)


SCORES = "report_id long, event_id long, ts timestamp, score double"


def _scores(n):
    start = dt.datetime(2024, 1, 1)
    seq = [10.0, 20.0, 15.0, 12.0, 50.0, 60.0]
    return [(i % 3, i, start + dt.timedelta(minutes=i), seq[(i // 3) % 6]) for i in range(n)]


def test_backoff_in_any_order_equals_the_batch_job(spark, tmp_path):
    """Scores arrive shuffled over many batches and a restart; the stops are those of the batch job on the same scores."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = _scores(36)
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    close = [(99, 999, rows[-1][2] + dt.timedelta(days=2), 1.0)]  # moves the watermark past all scores

    def run():
        stream = live.backoff_stops(live.read_stream(spark, src, files_per_batch=1), "1 day")
        live.write_batches(stream, out, state, "append").awaitTermination()

    _files(spark, mixed[:20], SCORES, src, 5)
    run()
    _files(spark, mixed[20:], SCORES, src, 4)
    run()  # resumes from the stored offsets and state
    _files(spark, close, SCORES, src, 1)
    run()
    got = sorted((r.report_id, r.stop_attempt, r.reason) for r in live.read_batches(spark, out).collect())
    batch = spark.createDataFrame(rows, SCORES)
    stops = attempts.stop_points(attempts.streaks(batch, ["ts", "event_id"])).filter("stop_attempt is not null")
    assert got == sorted((r.report_id, r.stop_attempt, r.reason) for r in stops.collect())
    # 10, 20, 15, 12: the streak reaches two on the fourth attempt
    assert got == [(0, 4, "backoff"), (1, 4, "backoff"), (2, 4, "backoff")]


def test_idle_reports_leave_the_state(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    start = dt.datetime(2024, 1, 1)
    _files(spark, [(1, 1, start, 5.0), (2, 2, start + dt.timedelta(days=9), 5.0), (3, 3, start + dt.timedelta(days=30), 5.0)], SCORES, src, 1)

    def run():
        stream = live.backoff_stops(live.read_stream(spark, src, files_per_batch=1), "1 hour", idle_ms=24 * 3600 * 1000)
        q = live.write_batches(stream, out, state, "append")
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    assert run()[-1] == 1  # only the newest report is left


def test_reports_share_state_and_calls(spark, tmp_path):
    """Many reports, one without id, take as many cells of state and calls as there are slots; each stops on its own."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    start = dt.datetime(2024, 1, 1)
    rows = [(i or None, 10 * i + k, start + dt.timedelta(minutes=k), s) for i in range(200) for k, s in enumerate((5.0, 9.0, 8.0, 7.0 + 3 * (i % 2), 1.0))]
    _files(spark, rows, SCORES, src, 300)
    _files(spark, [(500, 9999, start + dt.timedelta(days=2), 1.0)], SCORES, src, 1)
    q = live.write_batches(live.backoff_stops(live.read_stream(spark, src, files_per_batch=1), "1 day", slots=8), out, state, "append")
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 8
    got = {r.report_id: (r.stop_attempt, r.reason) for r in live.read_batches(spark, out).collect()}
    assert got == {i or None: (4, "backoff") for i in range(0, 200, 2)}


def test_current_table_over_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = [(1, 1, "pending"), (2, 2, "pending"), (1, 3, "processing"), (2, 4, "failed"), (1, 5, "completed"), (3, 6, "pending"), (3, 7, "failed")]
    for part in (rows[:3], rows[3:]):  # a restart in between
        _files(spark, part, "report_id long, event_id long, status string", src, 1)
        events = live.read_stream(spark, src, files_per_batch=1).withColumn("ts", F.timestamp_seconds("event_id"))
        live.write_current(live.latest_status(events), out, state, "report_id").awaitTermination()
    assert sorted(d for d in os.listdir(out) if d.startswith("slot=")) == ["slot=0", "slot=1"]
    got = {r.report_id: r.status for r in live.read_current(spark, out).collect()}
    assert got == {1: "completed", 2: "failed", 3: "failed"}


def test_late_rows_are_dropped(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    mk = lambda *secs: spark.createDataFrame([(s,) for s in secs], "s long").select(F.timestamp_seconds("s").alias("ts"), F.lit("e").alias("event"))
    for n, part in enumerate((mk(10, 20), mk(5000), mk(15), mk(9000))):
        part.coalesce(1).write.mode("append").parquet(src)
        counts = live.windowed_counts(live.read_stream(spark, src, files_per_batch=1), "60 seconds", None, "100 seconds")
        live.write_batches(counts, out, state, "append").awaitTermination()
    rows = {r.start.timestamp(): r.n for r in live.read_batches(spark, out).collect()}
    assert rows[0.0] == 2  # the row at 15 s came after the watermark had passed its window


def test_binary_files_and_hashes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.json").write_bytes(b'{"b": [1, 2]}')
    files = ingest.file_table(spark, str(tmp_path), F.lit(1), F.lit("content"))
    rows = {r.filename: r for r in ingest.ingest(files).collect()}
    assert rows["a.txt"].text == "héllo" and rows["b.json"].text == '{"b":[1,2]}' and rows["a.txt"].bytes == 6
    hashes = {os.path.basename(r.path): r.sha256 for r in ingest.content_hashes(spark, str(tmp_path)).collect()}
    assert hashes["a.txt"] == hashlib.sha256("héllo".encode()).hexdigest()


def test_size_limit_fails_the_file_not_the_job(spark):
    df = spark.createDataFrame([(1, 1, "a.txt", "", "", "QUJD"), (1, 2, "b.txt", "", "", "QQ=="), (1, 3, "", "", "", "@@@")],
                               "job_id long, pos long, filename string, mime string, role string, payload string")
    rows = {r.pos: r for r in ingest.ingest(df, max_file_bytes=2).collect()}
    assert [rows[i].status for i in (1, 2, 3)] == ["failed", "processed", "failed"]
    assert rows[3].filename == "unnamed" and rows[1].text is None


def test_append_records_and_registry(spark, tmp_path):
    rules = spark.createDataFrame([(1, "x"), (2, "y")], "entity long, body_font string")
    path = str(tmp_path / "rules")
    for _ in range(2):
        # ids are drawn once per record table, so a retried task writes the same ids again
        stores.append(stores.rules_records(rules, F.lit("a.docx"), F.lit(" "), F.lit(None).cast("string")), path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.select("rules_id").distinct().count() == 4
    assert back.first().document_type == "generic" and back.first().status == "active"
    old = spark.createDataFrame([("a", "1.0.0", 1)], "template_id string, version string, n long")
    new = spark.createDataFrame([("a", "1.0.0", 2), ("a", "1.1.0", 3), ("a", "1.1.0", 4)], old.schema)
    assert [(r.version, r.n) for r in append_only(old, new, "n").collect()] == [("1.1.0", 3)]


def test_checkpoint_root_prefers_the_session():
    class Session:
        def __init__(self, value, master="spark://host:7077"):
            self.value, self.conf, self.sparkContext, self.master = value, self, self, master

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    assert checkpoint_root(Session("/shared/")) == "/shared"
    assert os.path.isdir(checkpoint_root(Session(None, "local[8]")))
    with pytest.raises(ValueError):
        checkpoint_root(Session(None))
