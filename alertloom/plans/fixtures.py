"""The driver's tables seen as alerts, logs, spans and faults.

Every function reads whole tables. Conditions on `value` only decide what a row
looks like (a bad timestamp, a line that is no log line), never which rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom import schema
from alertloom.functions.time import micros
from alertloom.operators import alerts as A
from alertloom.sources import faults as gt

def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def as_alerts(rows: DataFrame, n_vectors: int) -> DataFrame:
    """Events as alerts; users share the vectors out, in turn."""
    error = F.col("event_type") == "error"
    source = F.when(F.col("user_id") % 3 == 0, "hdfs").when(F.col("user_id") % 3 == 1, "spark").otherwise("aiops")
    severity = (
        F.when(error & (F.col("value") >= 150), "FATAL")
        .when(error, "ERROR")
        .when(F.col("event_type").isin("signup", "purchase"), "WARN")
        .otherwise("INFO")
    )
    return rows.select(
        F.col("event_id").alias("alert_id"),
        "ts",
        micros(F.col("ts")).alias("ts_us"),
        source.alias("source"),
        _cat("svc", _s(F.col("user_id") % 12), "-", _s(F.col("event_id") % 3)).alias("service"),
        severity.alias("severity"),
        _cat(F.col("event_type"), " failed for blk_", _s("event_id"), " at 10.0.", _s(F.col("user_id") % 256), ".7:50010 ", F.col("props")).alias("message"),
        (F.col("user_id") % n_vectors).alias("vec_id"),
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return as_alerts(events(spark, sf), vectors(spark, sf).count())


def correlated_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """What correlation runs on: alert severities only, with cleaned messages."""
    return A.with_cleaned_message(A.severity_filter(alerts(spark, sf)), unicode=False)


def document_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as warnings, a minute apart, with their whole texts as messages."""
    at = F.timestamp_seconds(F.col("doc_id") * 60 + 1_704_067_200).cast("timestamp_ntz")
    rows = documents(spark, sf).select(
        (-1 - F.col("doc_id")).alias("alert_id"),
        at.alias("ts"),
        micros(at).alias("ts_us"),
        F.lit("aiops").alias("source"),
        _cat(F.col("source"), "-", _s(F.col("doc_id") % 3)).alias("service"),
        F.lit("WARN").alias("severity"),
        F.col("text").alias("message"),
    )
    return A.with_cleaned_message(rows, unicode=False)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _body() -> Column:
    kind = F.col("event_type")
    block = _cat("blk_", _s("event_id"))
    host = _cat("10.0.", _s(F.col("user_id") % 256), ".7:50010")
    return (
        F.when(kind == "error", _cat("Exception in receiveBlock for block ", block))
        .when(kind == "click", _cat("Unexpected packet for ", block, " from ", host))
        .when(kind == "signup", _cat("Received block ", block, " of size ", _s("user_id"), " from ", host))
        .when(kind == "purchase", _cat("Connection reset by ", host))
        .otherwise(_cat("Verification succeeded for ", block))
    )


def _no_log_line() -> Column:
    return _cat("  at frame ", _s("event_id"))


def storage_lines(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type") == "view", "WARN").otherwise("INFO")
    line = _cat(F.date_format("ts", "yyMMdd HHmmss"), " ", _s("user_id"), " ", level, " dfs.node", _s(F.col("user_id") % 12), ": ", _body())
    return events(spark, sf).select(
        F.when(F.col("value") >= 100, _no_log_line())
        .when(F.col("value") >= 80, F.regexp_replace(line, r"^(\d\d)\d\d", "$113"))
        .otherwise(line)
        .alias("value")
    )


def spark_lines(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARN").otherwise("INFO")
    line = _cat(F.date_format("ts", "yy/MM/dd HH:mm:ss"), " ", level, " executor.Node", _s(F.col("user_id") % 12), ": ", _body())
    return events(spark, sf).select(F.when(F.col("value") >= 100, _no_log_line()).otherwise(line).alias("value"))


def _epoch_text() -> Column:
    seconds = F.call_function("div", micros(F.col("ts")), F.lit(1_000_000))
    return F.when(F.col("value") >= 150, "n/a").when(F.col("value") >= 120, "").otherwise(_s(seconds))


def service_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Structured lines from events, free-form text from documents."""
    kind = F.col("event_type")
    word = F.when(kind == "error", "critical").when(kind == "purchase", "Warning").when(kind == "click", "finest").otherwise("notice")
    rendered = F.when(kind == "view", _body()).otherwise(_cat("severity: ", word, ", message:  ", _body(), " "))
    structured = events(spark, sf).select(
        _cat("e", _s("event_id")).alias("log_id"),
        _epoch_text().alias("timestamp"),
        _cat("svc", _s(F.col("user_id") % 12), "-", _s(F.col("event_id") % 3)).alias("cmdb_id"),
        F.lit("service").alias("log_name"),
        rendered.alias("value"),
    )
    free = documents(spark, sf).select(
        _cat("d", _s("doc_id")).alias("log_id"),
        _s(F.col("doc_id") * 60 + 1_704_067_200).alias("timestamp"),
        _cat(F.col("source"), "-", _s(F.col("doc_id") % 3)).alias("cmdb_id"),
        F.lit("service").alias("log_name"),
        F.col("text").alias("value"),
    )
    return structured.unionByName(free)


def _service_or_none() -> Column:
    """A service name, or null as CSV reads an empty field."""
    return F.when(F.col("event_id") % 7 != 0, _cat("svc", _s(F.col("user_id") % 12), "-", _s(F.col("event_id") % 3)))


def gateway_logs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    code = F.when(kind == "error", _s(F.col("user_id") % 4 + 500)).when(kind == "signup", "404").when(kind == "purchase", "301").otherwise("200")
    request = _cat('"POST /shop.', kind, '/Get HTTP/2" ', code, " - via_upstream ", F.col("props"))
    return events(spark, sf).select(
        _cat("g", _s("event_id")).alias("log_id"),
        _epoch_text().alias("timestamp"),
        _service_or_none().alias("cmdb_id"),
        F.lit("gateway").alias("log_name"),
        F.when(kind == "click", _cat("connection opened ", code)).otherwise(request).alias("value"),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    millis = F.call_function("div", micros(F.col("ts")), F.lit(1000))
    return events(spark, sf).select(
        F.when(F.col("value") >= 150, "n/a").otherwise(_s(millis)).alias("timestamp"),
        _service_or_none().alias("cmdb_id"),
        F.when(F.col("event_id") % 13 != 0, _cat("s", _s("event_id"))).alias("span_id"),
        F.when(F.col("event_id") % 17 != 0, F.md5(_s("event_id"))).alias("trace_id"),
        _s(F.floor(F.col("value") * 100)).alias("duration"),
        F.lit("rpc").alias("type"),
        F.when(kind == "error", _s(F.col("user_id") % 3)).when(kind == "view", "x").otherwise("0").alias("status_code"),
        F.when(F.col("event_id") % 11 != 0, _cat("shop/", kind)).alias("operation_name"),
        F.lit("").alias("parent_span"),
    )


def _fault_columns() -> dict[str, Column]:
    kinds = F.array(*[F.lit(k) for k in gt.FAILURE_TYPES], F.lit("unlisted fault"))
    seconds = F.call_function("div", micros(F.col("ts")), F.lit(1_000_000))
    node = F.col("user_id") % 3 == 0
    return {
        "timestamp": _s(seconds),
        "level": F.when(node, "node").when(F.col("user_id") % 3 == 1, "service").otherwise("pod"),
        "cmdb_id": F.when(node, _cat("node-", _s(F.col("user_id") % 6))).otherwise(
            _cat("svc", _s(F.col("user_id") % 12), "-", _s(F.col("event_id") % 3))
        ),
        "failure_type": F.element_at(kinds, (F.col("event_id") % 16 + 1).cast("int")),
    }


def _order(folder: int, file: str, at: Column) -> dict[str, Column]:
    place = F.struct(F.lit(folder).alias("folder"), F.lit(file).alias("file"), at.cast("long").alias("at"))
    return {"source_file": F.lit(file), "input_order": place}


def fault_csv(spark: SparkSession, sf: str) -> DataFrame:
    """One label row per event that is neither a view nor a purchase."""
    rows = events(spark, sf).where("event_type NOT IN ('view', 'purchase')")
    columns = {**_fault_columns(), **_order(0, "faults.csv", F.col("event_id"))}
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def fault_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object of parallel arrays per view or purchase; its second entry repeats the first with another level."""
    columns = _fault_columns()
    twice = {n: F.array(c, F.lit("pod") if n == "level" else c) for n, c in columns.items()}
    text = F.to_json(F.struct(*[c.alias(n) for n, c in twice.items()]))
    objects = events(spark, sf).where("event_type IN ('view', 'purchase')").select(
        "event_id", F.from_json(text, schema.FAULT_JSON_SCHEMA).alias("o")
    )
    rows = gt.explode_arrays(objects.select("event_id", "o.*"))
    return rows.withColumns(_order(2, "faults.json", F.col("event_id") * 2 + F.col("_at")))


def faults(spark: SparkSession, sf: str) -> DataFrame:
    merged = gt.merge_faults(fault_csv(spark, sf), fault_json(spark, sf))
    key = F.concat_ws("|", _s("timestamp_epoch"), "cmdb_id", "failure_type")
    return merged.withColumn("fault_id", key).withColumn("ts_us", F.col("timestamp_epoch") * 1_000_000)
