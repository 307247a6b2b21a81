"""Physical plans: what must and must not be in them."""

import re

import pytest

from quire.operators import blocks, history
from quire.plans import catalog, history_queries, layer_queries
from quire.sources import stores
from tools.check import compare, connect

QUERIES = catalog.queries()
STREAMS = ("h11_", "h12_", "h13_live", "h14_dedup", "h15_", "h16_")
QUANTILES = ("h10_stage_latency",)
BATCH = sorted(n for n in QUERIES if not n.startswith(STREAMS))


def plan(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_row_at_a_time_python(spark, sf, name):
    text = plan(spark, QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["b05_block_parents", "b08_section_bodies", "b09_headed_sections", "b14_flat_blocks"])
def test_one_exchange_below_the_explode(spark, sf, name):
    """Conversation text is moved once, as whole cells; line windows and group-bys reuse that distribution."""
    text = plan(spark, QUERIES[name](spark, sf))
    above, below = text.split("posexplode", 1)
    moved = [line for line in above.splitlines() if re.search(r"\bExchange\b", line)]
    assert len(re.findall(r"\bExchange\b", below)) == 1
    assert not moved


def test_packing_moves_text_and_segments_once(spark, sf):
    """The plan reads the segments twice; what has run scans and moves text once, and the segments' costs once."""
    df = QUERIES["p03_packing"](spark, sf)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan") == 1
    assert [m.group(1) for m in re.finditer(r"(?<!Reused)Exchange hashpartitioning\(([a-z_]+)", ran)] == ["capacity", "doc_id"]


@pytest.mark.parametrize("width", [8, 400])
@pytest.mark.parametrize("name", ["q28_streaks", "q29_delta_class", "h01_newest_first", "h02_illegal_steps", "h10_stage_gaps", "h13_batch_sessions", "l13_cover_sizes"])
def test_ordered_values_scan_and_move_the_rows_once(spark, sf, name, width):
    """One scan and one exchange to the pieces, with hot keys (of 400 pieces every user holds some) or without."""
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        if name == "h10_stage_gaps":  # the part of h10 that reads the events; the rest reads written counts
            text = plan(spark, history.stage_gaps(history_queries.events(spark, sf).withColumnRenamed("event_type", "event")))
        else:
            text = plan(spark, QUERIES[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert text.count("FileScan") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(_slot", text)) == 1
    if not name.startswith(("h02", "l13")):
        assert ("_bounds" in text) == (width == 400)


@pytest.mark.parametrize("name", QUANTILES)
def test_quantiles_need_no_buffer(spark, sf, name):
    text = plan(spark, QUERIES[name](spark, sf))
    assert "ObjectHashAggregate" not in text and "percentile" not in text and "median" not in text


def test_bucketed_documents_need_no_exchange(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    stores.save_documents(docs, "quire_test_documents", 4, str(tmp_path / "docs"))
    try:
        out = blocks.with_parents(blocks.blocks(spark.table("quire_test_documents"), placed=True))
        assert "Exchange" not in plan(spark, out)
        assert out.count() == blocks.blocks(docs).count()
    finally:
        spark.sql("DROP TABLE quire_test_documents")


def test_user_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(spark, QUERIES["s12_user_history"](spark, sf))
    assert "EqualTo(user_id,7)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "value" not in schema


def test_counts_are_combined_before_the_shuffle(spark, sf):
    text = plan(spark, QUERIES["h17_provider_outcomes"](spark, sf))
    assert text.count("HashAggregate") >= 2


@pytest.mark.parametrize("name", ["l01_layered_merge", "l05_rule_diff", "l08_effective_formatting"])
def test_rule_layers_are_merged_where_they_are(spark, sf, name):
    """Defaults are a constant map, never rows: nothing moves, and leaves are exploded only after the merge."""
    text = plan(spark, QUERIES[name](spark, sf))
    assert "Exchange" not in text and text.count("FileScan") == 1


@pytest.mark.parametrize("name", ["l01_layered_merge", "l05_rule_diff"])
def test_customers_of_a_long_split_are_dealt_before_they_become_leaves(spark, sf, monkeypatch, name):
    """150 customers in one split, a share of 40: at least four tasks, one move of customers and none of leaves, same rows."""
    monkeypatch.setattr(layer_queries, "SHARE", 40)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        df = QUERIES[name](spark, sf)
        text = plan(spark, df)
        assert df.rdd.getNumPartitions() >= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(re.findall(r"\bExchange\b", text)) == 1 and text.count("FileScan") == 1
    assert "Generate" not in text[text.index("Exchange hashpartitioning(c_custkey"):]
    assert compare(df.toArrow(), connect(sf).execute(catalog.oracle_sql()[name]).to_arrow_table()) is None


def test_customers_of_short_splits_stay_where_they_are(spark, tmp_path, monkeypatch):
    """The longest split decides, not the average; an empty table has none."""
    rows = "c_custkey long, c_name string, c_nationkey int"
    monkeypatch.setattr(layer_queries, "SHARE", 40)
    monkeypatch.setattr(layer_queries, "_customers", lambda spark, d: "dealt")
    for case, sizes, dealt in (("short", [30, 30, 30], False), ("uneven", [60, 1, 1], True), ("empty", [0], False)):
        spark.createDataFrame([], rows).coalesce(1).write.parquet(str(tmp_path / case / "customer.parquet"))
        for i, n in enumerate(sizes):
            made = [(100 * i + j, "Customer", j % 5) for j in range(n)]
            spark.createDataFrame(made, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / case / "customer.parquet"))
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a split per file
        try:
            assert (layer_queries._placed_customers(spark, str(tmp_path / case)) == "dealt") is dealt
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", ["l01_row_merge", "l02_priority_merge", "l04_range_validation", "l10_normalised_categories", "l20_confidence", "l21_inferred_fill", "l28_geometry", "h07_rules_lookup", "h08_rules_summary"])
def test_customers_are_dealt_before_they_become_rule_rows(spark, sf, name):
    """Rule rows are made behind the exchange of customers, however few splits their file has, and are never broadcast."""
    text = plan(spark, QUERIES[name](spark, sf))
    made = re.split(r"Generate explode\(array\((?!struct\()", text)[1:]
    assert made
    for tail in made:
        assert "Exchange hashpartitioning(c_custkey" in tail.split("FileScan")[0]
    assert not [x for x in text.split("BroadcastExchange")[1:] if "Generate explode(array(" in x.split("FileScan")[0]]


@pytest.mark.parametrize("name", ["l01_row_merge", "l02_priority_merge", "l04_range_validation", "l10_normalised_categories", "l20_confidence", "l21_inferred_fill", "l28_geometry", "h07_rules_lookup", "h08_rules_summary"])
def test_rule_values_are_computed_before_the_explosion(spark, sf, name):
    """The explosion of a long array is interpreted row by row, so it only reads columns."""
    text = plan(spark, QUERIES[name](spark, sf))
    made = re.split(r"Generate explode\(array\((?!struct\()", text)[1:]
    assert made and not [x for x in made if "CASE WHEN" in x.splitlines()[0]]


@pytest.mark.parametrize("name", ["l01_layered_merge", "l05_rule_diff"])
def test_no_map_as_long_as_the_defaults_is_built_per_row(spark, sf, name):
    text = plan(spark, QUERIES[name](spark, sf))
    assert "map_zip_with" not in text and "transform_values" not in text
