"""Microservice testbed data: service logs, gateway logs and trace spans as CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom import schema
from alertloom.functions import text
from alertloom.functions.time import epoch_millis, epoch_seconds, whole_number

# Severity and message inside a service log, status inside a gateway log.
SEVERITY_FIELD = r"(?i)severity:\s*(\w+)"
MESSAGE_FIELD = r"(?i)message:\s*([^\n]*)"
GATEWAY_STATUS = r'"[^"]*"\s+(\d{3})'

# Where the data lies below its root, one line per dataset type.
LAYOUTS = {
    "training_faults": "training_data_with_faults/training_data_with_faults/tar/*",
    "scoring": "初赛评分数据/*/cloudbed",
    "normal": "training_data_normal/*/cloudbed",
}
FILES = {
    "service": "log/all/log_filebeat-testbed-log-service.csv",
    "gateway": "log/all/log_filebeat-testbed-log-envoy.csv",
    "trace": "trace/all/trace_jaeger-span.csv",
}


def _stamped(rows: DataFrame, ts: Column) -> DataFrame:
    return rows.where(F.coalesce("timestamp", F.lit("")) != "").withColumn("ts", ts)


def _shortened(message: Column) -> Column:
    return F.when(F.length(message) > 500, F.concat(F.substring(message, 1, 497), F.lit("..."))).otherwise(message)


def graded_service_logs(logs: DataFrame) -> DataFrame:
    """Service logs with severity and message; `ts` is NULL where the epoch is unreadable."""
    value, field = F.col("_value"), F.col("_field")
    structured = field != ""
    has_message = F.regexp_like(value, F.lit(MESSAGE_FIELD))
    told = F.when(has_message, text.strip(F.regexp_extract(value, MESSAGE_FIELD, 1))).otherwise(value)
    message = F.when(structured, told).otherwise(text.strip(value))
    filled = _stamped(logs, epoch_seconds(F.col("timestamp"))).withColumn("_value", F.coalesce("value", F.lit("")))
    graded = text.computed_once(filled, _field=F.regexp_extract("_value", SEVERITY_FIELD, 1))
    return graded.withColumn("_message", message).select(
        "ts",
        F.lit("aiops").alias("source"),
        F.coalesce("cmdb_id", F.lit("unknown")).alias("service"),
        F.when(structured, text.normalize_severity(field)).otherwise(text.text_severity(value)).alias("severity"),
        _shortened(F.col("_message")).alias("message"),
        F.col("log_id").alias("event_id"),
        F.substring(value, 1, 200).alias("raw_line"),
    )


def graded_gateway_logs(logs: DataFrame) -> DataFrame:
    """Access log lines with status 400 and up."""
    value, code = F.col("_value"), F.col("_code")
    service, named = F.coalesce("cmdb_id", F.lit("unknown")), F.coalesce("cmdb_id", F.lit(""))
    filled = _stamped(logs, epoch_seconds(F.col("timestamp"))).withColumn("_value", F.coalesce("value", F.lit("")))
    return (
        text.computed_once(filled, _code=F.regexp_extract("_value", GATEWAY_STATUS, 1))
        .where(code >= "400")
        .select(
            "ts",
            F.lit("aiops").alias("source"),
            service.alias("service"),
            F.when(code >= "500", "ERROR").otherwise("WARN").alias("severity"),
            F.concat(F.lit("HTTP "), code, F.lit(" on "), named, F.lit(": "), F.substring(value, 1, 150)).alias("message"),
            F.col("log_id").alias("event_id"),
            F.substring(value, 1, 200).alias("raw_line"),
        )
    )


def graded_spans(spans: DataFrame, slow: int = schema.SLOW_SPAN) -> DataFrame:
    """Spans that failed, or else took longer than `slow`."""
    code, took = whole_number(F.col("status_code")), whole_number(F.col("duration"))
    service, named = F.coalesce("cmdb_id", F.lit("unknown")), F.coalesce("cmdb_id", F.lit(""))
    operation, trace, span = (F.coalesce(c, F.lit("")) for c in ("operation_name", "trace_id", "span_id"))
    failed = F.col("_code") != 0
    short = F.substring(trace, 1, 16)
    error = F.format_string(
        "Span error (code=%d) on %s [%s] duration=%dms trace=%s",
        F.col("_code"), operation, named, F.col("_took"), short,
    )
    lag = F.format_string("Slow span (%dms) on %s [%s] trace=%s", F.col("_took"), operation, named, short)
    raw = F.format_string(
        "trace=%s span=%s op=%s status=%d dur=%d",
        trace, span, operation, F.col("_code"), F.col("_took"),
    )
    return (
        _stamped(spans, epoch_millis(F.col("timestamp")))
        .withColumns({"_code": code, "_took": took})
        .where(failed | (F.col("_took") > slow))
        .where(F.col("_code").isNotNull() & F.col("_took").isNotNull())
        .select(
            "ts",
            F.lit("aiops").alias("source"),
            service.alias("service"),
            F.when(failed, "ERROR").otherwise("WARN").alias("severity"),
            F.when(failed, error).otherwise(lag).alias("message"),
            span.alias("event_id"),
            raw.alias("raw_line"),
        )
    )


def readable(graded: DataFrame) -> DataFrame:
    return graded.where(F.col("ts").isNotNull())


def parse_service_logs(logs: DataFrame) -> DataFrame:
    return readable(graded_service_logs(logs))


def parse_gateway_logs(logs: DataFrame) -> DataFrame:
    return readable(graded_gateway_logs(logs))


def parse_spans(spans: DataFrame, slow: int = schema.SLOW_SPAN) -> DataFrame:
    return readable(graded_spans(spans, slow))


def parse_all(service: DataFrame, gateway: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Union of the parsed kinds; gateway logs and spans may be left out."""
    parsed = parse_service_logs(service)
    if gateway is not None:
        parsed = parsed.unionByName(parse_gateway_logs(gateway))
    if spans is not None:
        parsed = parsed.unionByName(parse_spans(spans))
    return parsed


def parse_stats(service: DataFrame, gateway: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows per kind and per severity, and rows lost to an unreadable timestamp."""
    kinds = [
        ("service_logs", graded_service_logs(service)),
        ("gateway_logs", graded_gateway_logs(gateway)),
        ("trace_spans", graded_spans(spans)),
    ]
    tagged = None
    for kind, graded in kinds:
        part = graded.select(F.lit(kind).alias("kind"), "severity", "ts")
        tagged = part if tagged is None else tagged.unionByName(part)
    good = F.col("ts").isNotNull()
    return tagged.agg(
        *[F.count_if(good & (F.col("kind") == k)).alias(k) for k, _ in kinds],
        *[F.count_if(good & (F.col("severity") == s)).alias(s.lower()) for s in ("FATAL", "ERROR", "WARN", "INFO", "DEBUG")],
        F.count_if(~good).alias("bad_ts"),
    )


def _with_open_quotes(spark: SparkSession, path: str) -> list[str]:
    """Files of which a line has an odd number of quotes: a field goes on in the next line. At most all file names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return [r["file"] for r in lines.where(quotes % 2 == 1).select("file").distinct().collect()]


def _read_csv(spark: SparkSession, columns, path: str) -> DataFrame:
    """CSV rows with their `file`. Files are split among tasks; those with line feeds inside fields are read whole."""
    whole = _with_open_quotes(spark, path)
    reader = spark.read.schema(columns).option("header", True).option("escape", '"')
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    if not whole:
        return rows
    odd = reader.option("multiLine", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.where(~F.col("file").isin(whole)).unionByName(odd.where(F.col("file").isin(whole)))


def read_kind(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """All CSV files of one kind below the root, tagged with `dataset_type` and `label`."""
    columns = schema.SPAN_SCHEMA if kind == "trace" else schema.LOG_SCHEMA
    found = None
    for dataset, layout in LAYOUTS.items():
        try:
            rows = _read_csv(spark, columns, f"{root}/{layout}/{FILES[kind]}")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        depth = -4 if dataset == "training_faults" else -5
        # A large table may be a folder of parts, below the name of the file.
        folder = F.element_at(F.split(F.regexp_replace(F.url_decode("file"), r"(\.csv)/.*$", "$1"), "/"), depth)
        tags = [F.lit(dataset).alias("dataset_type"), folder.alias("label")]
        rows = rows.select(*[c for c in rows.columns if c != "file"], *tags)
        found = rows if found is None else found.unionByName(rows)
    return found
