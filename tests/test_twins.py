"""Window, fold and join operators against plain loops on random input, including hot keys."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import quantiles, windows
from quire.operators import attempts, blocks, history, packing, presets, raster, similarity, sketches, styles
from quire.sources import ingest


def test_parents_and_numbers(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for doc in range(60):
        stack, counts = [(0, 0)], [0, 0, 0]
        for pos in range(1, 30):
            level = rng.choice([None, 1, 2, 3])
            title = rng.choice(["Alpha", "1.2 Given", "Beta"])
            rows.append((doc, pos, "heading" if level else "paragraph", level, title))
            if level is None:
                want[doc, pos] = (stack[-1][0], None)
                continue
            while len(stack) > 1 and stack[-1][1] >= level:
                stack.pop()
            parent = stack[-1][0]
            stack.append((pos, level))
            if re.match(r"^\d+(?:\.\d+)*\s+", title):
                label = title
            else:
                counts[level - 1] += 1
                counts[level:] = [0] * (3 - level)
                label = ".".join(str(n) for n in counts[:level] if n) + " " + title
            want[doc, pos] = (parent, label)
    df = spark.createDataFrame(rows, "doc_id long, block_no long, kind string, level int, text string")
    got = {(r.doc_id, r.block_no): r.parent_no for r in blocks.with_parents(df).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    heads = df.filter("kind = 'heading'").select("doc_id", F.col("block_no").alias("pos"), "level", F.col("text").alias("title"))
    numbered = {(r.doc_id, r.pos): r.numbered for r in blocks.heading_numbers(heads).collect()}
    assert numbered == {k: v[1] for k, v in want.items() if v[1]}


@pytest.mark.parametrize("segment", [1, 3, 8, 64, packing.SEGMENT])
def test_packing_and_repair(spark, segment):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(40):
        page, cursor, placed = 1, 0, []
        cap = rng.choice([1, 5, 9, 20])
        for pos in range(1, 40 if doc else 900):
            kind = rng.choice(["heading", "paragraph", "list_item", "image"])
            text = "x" * rng.randrange(0, 700)
            rows.append((cap, doc, pos, kind, text))
            width = {"paragraph": 90, "list_item": 70}.get(kind)
            cost = {"heading": 2, "image": 10}.get(kind) or max(1, -(-len(text) // width))
            if cursor + cost > cap:
                page, cursor = page + 1, 0
            placed.append([pos, kind, page, cursor, cost])
            cursor += cost
        want[doc] = placed
    df = spark.createDataFrame(rows, "capacity int, doc_id long, block_no long, kind string, text string")
    place = packing.pack(df, F.col("capacity"), ("capacity", "doc_id"), segment)
    got = sorted((r.doc_id, r.pos, r.page, r.line_start) for r in place.collect())
    assert got == sorted((d, p[0], p[2], p[3]) for d, ps in want.items() for p in ps)

    def repaired(placed):
        placed = [list(p) for p in placed]
        for _ in range(2):
            by_page = {}
            for i, p in enumerate(placed):
                by_page.setdefault(p[2], []).append((p[3], i))
            for page in sorted(by_page):
                last = max(by_page[page])[1]
                if placed[last][1] == "heading" and last + 1 < len(placed):
                    placed[last][2] += 1
                    placed[last + 1][2] += 1
                    break
            cursors = Counter()
            for p in placed:
                p[3] = cursors[p[2]]
                cursors[p[2]] += p[4]
        return placed

    fixed = sorted((r.doc_id, r.pos, r.page, r.line_start) for r in packing.repair(place).collect())
    assert fixed == sorted((d, p[0], p[2], p[3]) for d, ps in want.items() for p in repaired(ps))


def test_a_long_document_is_packed_and_repaired_over_many_tasks(spark):
    """Half a million blocks of one document: no task sees over a tenth of the placements, and all follow the rule."""
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = F.col("id")
        kind = F.when(n % 7 == 3, "heading").otherwise("paragraph")
        df = spark.range(1, 500_001, 1, 16).select(F.lit(20).alias("capacity"), F.lit(0).alias("doc_id"), n.alias("block_no"), kind.alias("kind"), F.repeat(F.lit("x"), (n * 37 % 500).cast("int")).alias("text"))
        place = packing.pack(df, F.col("capacity"), ("capacity", "doc_id"))
        got = place.select("pos", "page", "line_start", F.spark_partition_id().alias("task")).toPandas()
        fixed = packing.repair(place).select("pos", "page", F.spark_partition_id().alias("task")).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    page, cursor, want = 1, 0, []
    for pos in range(1, 500_001):
        cost = 2 if pos % 7 == 3 else max(1, -(-(pos * 37 % 500) // 90))
        if cursor + cost > 20:
            page, cursor = page + 1, 0
        want.append((page, cursor))
        cursor += cost
    got = got.sort_values("pos")
    assert list(zip(got.page, got.line_start)) == want
    assert got.task.value_counts().max() < 50_000 and fixed.task.value_counts().max() < 50_000
    moved = got.set_index("pos").page.ne(fixed.set_index("pos").page.sort_index())
    assert len(fixed) == 500_000 and 2 <= moved.sum() <= 4


@pytest.mark.parametrize("width", [1, 8, 61])
def test_ordered_equals_a_plain_loop_under_a_hot_key(spark, width):
    """Half of the rows share one key and some have none; a third have no time; values of the row before may be null."""
    rng = random.Random(11)
    rows = [(rng.choice([0, 0, 0, None, rng.randrange(1, 20)]), rng.choice([None, *range(40), *range(40)]), i, rng.choice([None, 1.0, 2.5])) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, t int, i long, v double").withColumns({"_key": F.lit("clash"), "piece": F.lit(3)})
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        pieces = windows.Ordered(df, ["k"], ["t", "i"])
        one = pieces.running(pieces.rows, sums={"n": F.lit(1)}, lasts={"seen": F.col("v")}, prevs={"before": F.col("v")})
        two = pieces.running(one, sums={"total": F.col("n") * 2}, prevs={"early": F.col("n")}).drop("_slot")
        assert two.columns == [*df.columns, "n", "seen", "before", "total", "early"]
        got = {r.i: (r.n, r.seen, r.before, r.total, r.early) for r in two.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    n, seen, before, total, want = Counter(), {}, {}, Counter(), {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n[k] += 1
        total[k] += 2 * n[k]
        if v is not None:
            seen[k] = v
        want[i] = (n[k], seen.get(k), before.get(k), total[k], n[k] - 1 or None)
        before[k] = v
    assert got == want


def test_ordered_pieces_of_a_hot_key_without_times(spark):
    """A third of all rows has one key and no time; no piece holds much more than a task's share."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4000 + 100).alias("k"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("t"), "id"
    )
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        sizes = [r["count"] for r in windows.Ordered(df, ["k"], ["t", "id"]).rows.groupBy("_slot").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sum(sizes) == 60_000 and max(sizes) <= 3 * 60_000 / 40 and len(sizes) >= 4000


def test_ordered_values_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t timestamp")
    assert windows.ordered(df, ["k"], ["t"], sums={"n": F.lit(1)}).count() == 0


def test_streaks_and_stops(spark):
    rng = random.Random(5)
    rows, stops, streaks = [], {}, {}
    for rid in range(50):
        prev = prev_delta = None
        streak, stop = 0, None
        for n in range(1, rng.randrange(2, 12)):
            score = rng.choice([10.0, 10.1, 50.0, 70.0, 70.2])
            rows.append((rid, n, score))
            delta = None if prev is None else round(score - prev, 2)
            streak = streak + 1 if delta is not None and delta <= 0 else 0
            streaks[rid, n] = streak
            stalled = n >= 3 and delta <= 0.2 and prev_delta <= 0.2
            if stop is None and (streak >= 2 or stalled):
                stop = (n, "backoff" if streak >= 2 else "unlikely")
            prev, prev_delta = score, delta
        stops[rid] = stop or (None, None)
    df = spark.createDataFrame(rows, "report_id long, n long, score double")
    out = attempts.streaks(df, ["n"]).cache()
    assert {(r.report_id, r.n): r.streak for r in out.collect()} == streaks
    got = {r.report_id: (r.stop_attempt, r.reason) for r in attempts.stop_points(out).collect()}
    assert got == stops


def test_similarity_join_is_exact(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    refs = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 25)))) for i in range(25)]
    corpus = [(i, rng.choice(refs)[1] if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(120)]
    corpus += [(1000 + i, refs[0][1]) for i in range(60)]
    left = spark.createDataFrame(corpus, "left_id long, text string")
    right = spark.createDataFrame(refs, "right_id long, text string")
    for t in (0.3, 0.6, 1.0):
        want = set()
        for i, a in corpus:
            for j, b in refs:
                ca, cb = Counter(a.split()), Counter(b.split())
                common = sum((ca & cb).values())
                if 2 * common >= t * (sum(ca.values()) + sum(cb.values())) - 1e-12:
                    want.add((i, j))
        got = {(r.left_id, r.right_id) for r in similarity.similarity_join(left, right, t, tile=7).collect()}
        assert got == want, t
    assert similarity.similarity_join(left, right.limit(0), 0.6).count() == 0


@pytest.mark.parametrize("tile", [3, 4096])
def test_similar_pairs_of_a_group_are_exact(spark, tile):
    """Each pair of different bags once, none across groups; a third of the rows is one text, an element is in every bag."""
    rng = random.Random(tile)
    words = [f"w{i}" for i in range(30)]
    base = [rng.choices(words, k=rng.randrange(2, 30)) for _ in range(12)]
    rows = []
    for i in range(150):
        toks = list(rng.choice(base)) if i % 3 else list(base[0])
        for _ in range(rng.randrange(3) if i % 3 else 0):
            toks[rng.randrange(len(toks))] = rng.choice(words)
        rng.shuffle(toks)
        rows.append((i, rng.choice(["en", "de", None]), " ".join(["the", *toks])))
    rows += [(500, "en", None), (501, "en", "  "), (502, None, "Only here"), (503, None, "only HERE")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("h", F.lit("clash"))
    kept = similarity.bag_rows(frame, "doc_id", F.col("lang"))
    first: dict = {}
    for i, lang, text in rows:
        if text and text.strip():
            first.setdefault((lang or "", tuple(sorted(text.lower().split()))), i)
    got = {r.doc_id: (r.grp, r.class_id) for r in similarity.bag_classes(kept, "doc_id").collect()}
    assert got == {i: (lang or "", first[lang or "", tuple(sorted(text.lower().split()))]) for i, lang, text in rows if text and text.strip()}
    for t in (0.82, 0.88, 0.5):
        want = {}
        for (g, a), i in first.items():
            for (o, b), k in first.items():
                if g == o and i < k:
                    common, total = sum((Counter(a) & Counter(b)).values()), len(a) + len(b)
                    if 200 * common >= round(t * 100) * total:
                        want[g, i, k] = 200 * common / total
        pairs = similarity.similar_pairs(kept, "doc_id", t, tile).collect()
        assert len(pairs) == len(want) and {(r.grp, r.left_id, r.right_id) for r in pairs} == set(want)
        assert all(abs(r.similarity - want[r.grp, r.left_id, r.right_id]) < 0.006 for r in pairs)


def test_sketches_rule_out_no_similar_pair():
    """Bags of 1 to 900 tokens, so of several widths, against counting; every pair once, shared elements exact."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(2000)]
    lists = [[rng.choice(words) for _ in range(int(2 ** rng.uniform(0, 9.8)))] for _ in range(60)]
    lists += [(x + rng.choices(words, k=len(x) // 8))[rng.randrange(1 + len(x) // 6) :] for x in lists]
    bags = sorted({tuple(sorted(x)) for x in lists}, key=len)
    counts, n, cut = [Counter(x) for x in bags], np.array([len(x) for x in bags]), len(bags) // 2
    column = pa.array([" ".join(x) for x in bags])
    made = sketches.sketched(column)
    common = {(i, j): sum((counts[i] & counts[j]).values()) for i in range(len(bags)) for j in range(i + 1, len(bags))}
    for least in (300, 5000, 8200, 10_000):
        want = {(i, j) for (i, j), c in common.items() if 2 * sketches.UNIT * c >= least * (n[i] + n[j])}
        got = [pair for i, j in sketches.near(n, made, n, made, least, True) for pair in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and want <= set(got) <= set(common)
        across = [pair for i, j in sketches.near(n[:cut], made[:cut], n[cut:], made[cut:], least, False) for pair in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(across) == len(set(across)) and {(i, j - cut) for i, j in want if i < cut <= j} <= set(across)
    i, j = np.array(sorted(common)).T
    assert sketches.Bags(column).shared(i, j).tolist() == [common[pair] for pair in sorted(common)]


def test_rows_of_similar_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """400 texts that all share their words, 20 of them near copies: what is written and moved is some rows a text."""
    rng = random.Random(8)
    texts = [rng.choices([f"w{i}" for i in range(90)], k=60) for _ in range(380)]
    texts += [[*x[:-2], "changed", "here"] for x in texts[:20]]
    kept, write = [], similarity.materialised
    monkeypatch.setattr(similarity, "materialised", lambda df, name, **more: kept.append(write(df, name, **more)) or kept[-1])
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    pairs = similarity.similar_pairs(similarity.bag_rows(frame, "doc_id"), "doc_id", 0.82)
    assert {(r.left_id, r.right_id) for r in pairs.collect()} >= {(i, 380 + i) for i in range(20)}

    def moved(plan) -> int:
        inner = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.plan() if "QueryStage" in plan.nodeName() else None
        own = plan.metrics().get("shuffleRecordsWritten")
        below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
        return (own.get().value() if own.isDefined() else 0) + sum(moved(x) for x in below)

    assert sum(x.count() for x in kept) + moved(pairs._jdf.queryExecution().executedPlan()) <= 8 * len(texts)


def test_gates_are_the_strictest_that_pass(spark):
    rows = spark.createDataFrame([(81.99,), (82.0,), (84.99,), (85.0,), (87.5,), (88.0,), (100.0,)], "s double")
    assert [r[0] for r in rows.select(similarity.gate(F.col("s"))).collect()] == [None, "high_range", "high_range", "balanced", "balanced", "strict", "strict"]


def test_bag_dice(spark):
    pairs = [(1, "a b c", "A  b\nd"), (2, "", ""), (3, "same text", "same text")]
    df = spark.createDataFrame(pairs, "doc_id long, source string, rendered string")
    dice = {r.doc_id: r.similarity for r in similarity.bag_dice(df).collect()}
    assert dice[2] == 100.0 and dice[3] == 100.0 and dice[1] == 66.67
    gone = spark.createDataFrame([(1, "a b", None, "a b")], "doc_id long, source string, x string, y string")
    row = similarity.bag_dice_all(gone, "source", {"x": "x", "y": "y"}).first()
    assert (row.x, row.y) == (0.0, 100.0)


def test_role_texts_equal_join_then_clip(spark):
    rng = random.Random(9)
    files = [
        (rng.randrange(3), i, f"f{i}.txt", "text/plain", rng.choice(["content", "reference"]), "processed", " " * rng.randrange(3) + "y" * rng.randrange(0, 60) + "\n")
        for i in range(200)
    ]
    df = spark.createDataFrame(files, "job_id long, pos long, filename string, mime string, role string, status string, text string")
    for clip in range(60, 140, 7):
        want = {}
        for job, _, name, _, role, _, text in files:
            want.setdefault((job, role), []).append(f"\n\n### Source File: {name}\n{text.strip()}\n")
        want = {k: "\n".join(v).strip()[:clip] for k, v in want.items()}
        got = {(r.job_id, r.role): r.text for r in ingest.role_texts(df, clip, df).collect()}
        assert got == want, clip


def test_rename_takes_the_smallest_free_suffix(spark):
    old = spark.createDataFrame([("a",), ("a (2)",), ("a (4)",), ("b",)], "name string")
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = sorted((r.name, r.origin, r.outcome) for r in presets.import_merge(old, new, "rename").collect())
    assert ("a (3)", "incoming", "renamed") in got and ("b (2)", "incoming", "renamed") in got
    assert ("c", "incoming", "imported") in got and len(got) == 7


def test_mode_tie_takes_first_seen(spark):
    rows = [(1, 0, "x"), (1, 1, "y"), (1, 2, "y"), (1, 3, "x"), (1, 4, None)]
    df = spark.createDataFrame(rows, "doc long, pos long, v string")
    assert styles.first_mode(df, ["doc"], "v", "pos").first().v == "x"


def test_stage_spans_pair_each_end_with_the_latest_start(spark):
    rows = [(1, 1, 0.0, "a_start"), (1, 2, 1.0, "a_start"), (1, 3, 1.5, "a_end"), (1, 4, 2.0, "b_end"), (2, 5, 3.0, "a_end"),
            (None, 6, 4.0, "a_start"), (None, 7, 9.25, "a_end"), (1, 8, 90_000.0, "a_end")]
    df = spark.createDataFrame(rows, "k long, event_id long, s double, event string").withColumn("ts", F.col("s").cast("timestamp"))
    df = df.withColumn("day", F.to_date("ts"))
    spans = history.stage_spans(df, "k", {"a": ("a_start", "a_end"), "b": ("b_start", "b_end")})
    assert sorted((str(r.k), r.stage, r.event_id, float(r.elapsed_ms)) for r in spans.collect()) == [
        ("1", "a", 3, 500.0), ("1", "a", 8, 89_999_000.0), ("None", "a", 7, 5250.0)
    ]
    assert {(str(r.k), r.runs, r.elapsed_ms) for r in history.report_stages(spans, "k").collect()} == {("1", 2, 89_999_500.0), ("None", 1, 5250.0)}


def test_baseline_failure_rows(spark):
    page = [float(i % 7) for i in range(64)]
    other = [float((i * 5) % 11) * 20 for i in range(64)]
    actual = spark.createDataFrame([("x", 1, page), ("x", 2, other), ("y", 1, page), ("z", 1, page)], "k string, page long, pixels array<double>")
    base = spark.createDataFrame([("x", 1, page), ("x", 2, page), ("x", 3, page), ("z", 1, page)], "k string, page long, pixels array<double>")
    got = sorted((r.k, r.page, r.reason) for r in raster.baseline_failures(actual, base, "k").collect())
    assert got == [("x", 0, "page_count_mismatch expected=3 actual=2"), ("x", 2, "ssim_below_threshold threshold=0.97"), ("y", 0, "baseline_missing")]


@pytest.mark.parametrize("width", [1, 8, 61])
def test_quantiles_equal_a_plain_sort_under_a_hot_key(spark, width):
    """Half of the rows share one key; values repeat, and are null, in one column for a whole group."""
    rng = random.Random(5)
    rows = [(k := rng.choice([0, 0, 0, None, rng.randrange(1, 9)]), rng.choice([None, *range(400)]), None if k == 3 else rng.gauss(0, 9), rng.randrange(1, 4)) for _ in range(8000)]
    rows += [(77, None, None, 1), (78, 5, None, 1)]
    df = spark.createDataFrame(rows, "k long, a int, b double, w int")
    wanted = {"a50": ("a", 0.5), "a95": ("a", 0.95), "b0": ("b", 0.0), "b50": ("b", 0.5), "b100": ("b", 1.0)}
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        for weight in (None, F.col("w")):
            got = {r.k: r for r in quantiles.quantiles(df, ["k"], wanted, weight).collect()}
            assert set(got) == {r[0] for r in rows} - {77}
            for k, r in got.items():
                for name, (column, p) in wanted.items():
                    at = 1 if column == "a" else 2
                    values = sorted(x[at] for x in rows if x[0] == k and x[at] is not None for _ in range(x[3] if weight is not None else 1))
                    if not values:
                        assert r[name] is None
                        continue
                    place = p * (len(values) - 1)
                    low, part = int(place), place - int(place)
                    want = values[low] * (1 - part) + values[min(low + 1, len(values) - 1)] * part
                    assert r[name] == pytest.approx(want)
        assert quantiles.quantiles(df.limit(0), ["k"], wanted).count() == 0
        one = {"a50": wanted["a50"]}
        counts = df.groupBy("k", "a").agg(F.count("*").alias("n"))
        plain, counted = quantiles.quantiles(df, ["k"], one), quantiles.quantiles(counts, ["k"], one, F.col("n"), counted=True)
        assert sorted(map(str, plain.collect())) == sorted(map(str, counted.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
