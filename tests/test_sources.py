import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from alertloom import schema
from alertloom.sources import faults, logs, sinks, testbed


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_storage_lines(spark):
    rows = logs.parse_storage_lines(
        lines(
            spark,
            [
                "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_1",
                "prefix 081109 203518 143 WARN dfs.X: Exception",
                "081309 203518 143 INFO dfs.X: bad month",
                "081109 246061 143 INFO dfs.X: bad time",
                "not a log line",
                "700101 000000 1 INFO dfs.X: old: Connection reset",
                "680101 000000 1 INFO dfs.X: ",
            ],
        )
    ).collect()
    got = {r.message: (r.ts, r.severity, r.service) for r in rows}
    assert got["Receiving block blk_1"] == (dt.datetime(2008, 11, 9, 20, 35, 18), "INFO", "dfs.DataNode$DataXceiver")
    assert got["Exception"][1] == "WARN"
    assert got["old: Connection reset"][:2] == (dt.datetime(1970, 1, 1), "ERROR")
    assert got[""][0] == dt.datetime(2068, 1, 1)
    assert len(rows) == 4
    assert all(r.source == "hdfs" and r.event_id == "" and r.raw_line for r in rows)


def test_spark_lines(spark):
    rows = logs.parse_spark_lines(
        lines(spark, ["17/03/14 21:40:22 INFO executor.Backend: Got error", "17/02/30 21:40:22 INFO a: b", "x"])
    ).collect()
    assert [(r.ts, r.severity, r.service, r.message) for r in rows] == [
        (dt.datetime(2017, 3, 14, 21, 40, 22), "INFO", "executor.Backend", "Got error")
    ]


def test_read_lines_caps_scanned_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("17/03/14 21:40:22 INFO a: b\n" * 5 + "junk\n" * 5)
    assert logs.read_lines(spark, str(tmp_path / "a.log")).count() == 10
    assert logs.read_lines(spark, str(tmp_path / "a.log"), 7).count() == 7


def log_rows(spark, rows):
    return spark.createDataFrame(rows, schema.LOG_SCHEMA)


def test_service_logs(spark):
    rows = testbed.parse_service_logs(
        log_rows(
            spark,
            [
                ("1", "1647700000", "cart-0", "l", "SEVERITY: Crit, Message:  disk gone  "),
                ("2", "1647700000", "cart-0", "l", "severity: info"),
                ("3", "1647700000", "cart-0", "l", "  Unhandled exception "),
                ("4", "1647700000", "cart-0", "l", "x" * 501),
                ("5", "1647700000", "cart-0", "l", "y" * 500),
                ("6", "", "cart-0", "l", "error"),
                ("7", "12.5", "cart-0", "l", "error"),
                ("8", " 1647700000 ", None, "l", None),
            ],
        )
    ).collect()
    got = {r.event_id: r for r in rows}
    assert set(got) == {"1", "2", "3", "4", "5", "8"}
    assert (got["1"].severity, got["1"].message) == ("FATAL", "disk gone")
    assert (got["2"].severity, got["2"].message) == ("INFO", "severity: info")
    assert (got["3"].severity, got["3"].message) == ("ERROR", "Unhandled exception")
    assert got["4"].message == "x" * 497 + "..." and len(got["4"].raw_line) == 200
    assert got["5"].message == "y" * 500
    assert (got["8"].service, got["8"].message) == ("unknown", "")
    assert got["1"].ts == dt.datetime(2022, 3, 19, 14, 26, 40)


def test_gateway_logs(spark):
    value = '"GET /x HTTP/2" {} - via_upstream'
    rows = testbed.parse_gateway_logs(
        log_rows(
            spark,
            [
                ("1", "1647700000", "fe-0", "l", value.format(200)),
                ("2", "1647700000", "fe-0", "l", value.format(404)),
                ("3", "1647700000", "fe-0", "l", value.format(503) + "z" * 300),
                ("4", "1647700000", "fe-0", "l", "GET /x 500"),
                ("5", "bad", "fe-0", "l", value.format(500)),
            ],
        )
    ).collect()
    got = {r.event_id: r for r in rows}
    assert set(got) == {"2", "3"}
    assert got["2"].severity == "WARN" and got["3"].severity == "ERROR"
    assert got["2"].message == 'HTTP 404 on fe-0: "GET /x HTTP/2" 404 - via_upstream'
    assert len(got["3"].message) == len("HTTP 503 on fe-0: ") + 150


def span(i, took, code, at="1647700000123"):
    return (at, "cart-0", f"s{i}", "t" * 20, took, "rpc", code, "op", "")


def test_spans(spark):
    table = spark.createDataFrame(
        [
            span(1, "10", "2"),
            span(2, "5001", "0"),
            span(3, "5000", "0"),
            span(4, "9999", "13"),
            span(5, "9999", "x"),
            span(6, "9.5", "1"),
            span(7, "9999", "1", "bad"),
        ],
        schema.SPAN_SCHEMA,
    )
    got = {r.event_id: r for r in testbed.parse_spans(table).collect()}
    assert set(got) == {"s1", "s2", "s4"}
    assert got["s1"].severity == "ERROR" and got["s2"].severity == "WARN" and got["s4"].severity == "ERROR"
    assert got["s2"].message == f"Slow span (5001ms) on op [cart-0] trace={'t' * 16}"
    assert got["s1"].message == f"Span error (code=2) on op [cart-0] duration=10ms trace={'t' * 16}"
    assert got["s1"].ts == dt.datetime(2022, 3, 19, 14, 26, 40, 123000)
    stats = testbed.parse_stats(log_rows(spark, []), log_rows(spark, []), table).first()
    assert (stats.trace_spans, stats.bad_ts, stats.error, stats.warn) == (3, 1, 2, 1)


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


def test_directories(spark, tmp_path):
    header = "log_id,timestamp,cmdb_id,log_name,value\n"
    for layout in (
        "training_data_with_faults/training_data_with_faults/tar/2022-03-20-cloudbed1",
        "初赛评分数据/2022-05-01/cloudbed",
        "training_data_normal/cloudbed-2/cloudbed",
    ):
        write(tmp_path / layout / testbed.FILES["service"], header + '1,1647700000,cart-0,l,"severity: error, message: a"\n')
    rows = testbed.read_kind(spark, str(tmp_path), "service")
    got = {(r.dataset_type, r.label) for r in rows.select("dataset_type", "label").collect()}
    assert got == {("training_faults", "2022-03-20-cloudbed1"), ("scoring", "2022-05-01"), ("normal", "cloudbed-2")}
    assert testbed.parse_all(rows).count() == 3
    assert testbed.read_kind(spark, str(tmp_path), "trace") is None


def test_faults(spark, tmp_path):
    head = "timestamp,level,cmdb_id,failure_type\n"
    write(tmp_path / faults.CSV_FOLDERS[0] / "a.csv", head + "1647800000,service,cart,k8s容器cpu负载\n1647700000,node,node-1,odd\n")
    write(tmp_path / faults.CSV_FOLDERS[1] / "a.csv", head + "1647800000,pod,cart,k8s容器cpu负载\n")
    write(
        tmp_path / faults.JSON_FOLDER / "b.json",
        json.dumps(
            {
                "timestamp": [1647800000, 1647900000],
                "level": ["x", "pod"],
                "cmdb_id": ["cart", "pay-0"],
                "failure_type": ["k8s容器cpu负载", "node 内存消耗"],
            }
        ),
    )
    rows = faults.load_faults(spark, str(tmp_path)).collect()
    assert [(r.timestamp_epoch, r.level, r.cmdb_id, r.failure_type_en, r.source_file) for r in rows] == [
        (1647700000, "node", "node-1", "odd", "a.csv"),
        (1647800000, "service", "cart", "k8s container CPU overload", "a.csv"),
        (1647900000, "pod", "pay-0", "node memory exhaustion", "b.json"),
    ]
    assert faults.load_faults(spark, str(tmp_path / "none")) is None


def test_sinks_keep_time_order(spark, tmp_path):
    rows = spark.range(1000).select(
        F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(1000))).cast("timestamp_ntz").alias("ts"),
        *[F.lit("x").alias(c) for c in schema.ALERT_COLUMNS if c != "ts"],
    )
    sinks.write_alerts_csv(rows, str(tmp_path / "csv"))
    files = sorted((tmp_path / "csv").glob("part-*.csv"))
    stamps = [line.split(",")[0] for f in files for line in f.read_text().splitlines()[1:]]
    assert len(stamps) == 1000 and stamps == sorted(stamps)
