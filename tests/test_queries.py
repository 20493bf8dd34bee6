"""Registered queries against DuckDB at the smallest scale, and the shape of their plans.

`python tests/oracle_check.py 0.01` covers all of them at the scale of the driver.
"""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from alertloom.operators.ordering import top_per_group
from alertloom.plans import registry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "parse_hdfs_lines",
    "parse_trace_spans",
    "aiops_alerts",
    "load_ground_truth",
    "clean_documents",
    "valid_alerts",
    "alert_counts",
    "densest_window",
    "even_sample",
    "replay_envelopes",
    "text_vectors",
    "similarity_edges",
    "incidents",
    "fault_match",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_duckdb(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.oracle_sql())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_bound_reaches_the_scan(spark):
    text = plan(entry.queries()["time_bound"](spark, SF))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


@pytest.mark.parametrize("k", [3, 5000])
def test_top_k_is_cut_before_the_shuffle(spark, k):
    ranked = top_per_group(spark.range(0, 100_000, 1, 4).withColumn("g", F.col("id") % 3), "g", [F.col("id")], k)
    before_shuffle = plan(ranked).split("Exchange", 1)[1]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


@pytest.mark.parametrize("name", ["dedup_aiops_alerts", "connected_components", "similarity_edges"])
def test_no_cross_products(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_segmented_members_scan_the_events_once(spark):
    text = plan(registry.found_segmented(spark, SF).members)
    assert text.count("FileScan") == 1  # stored members
    narrow = plan(registry.correlation.scored_members(registry.fx.correlated_alerts(spark, SF), registry.fx.vectors(spark, SF), 7200, 0.3, max_span_sec=3600))
    assert narrow.count("events.parquet") == 1


def test_capped_lines_holds_every_line(spark, duck):
    read = entry.queries()["capped_lines"](spark, SF)
    assert compare(read, duck, entry.oracle_sql()["parse_hdfs_lines"]) is None
    assert entry.oracle_sql()["capped_lines"] == entry.oracle_sql()["parse_hdfs_lines"]
