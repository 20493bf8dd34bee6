"""Plain-text logs: storage (HDFS) and Spark lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alertloom.functions import text
from alertloom.functions.time import century
from alertloom.operators.ordering import running_sum
from alertloom.session import durable

# Date, time, process, severity, service, message.
STORAGE_LINE = r"(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+(\S+?):\s+([^\n]*)"
# Date, time, severity, service, message.
SPARK_LINE = r"(\d{2}/\d{2}/\d{2})\s+(\d{2}:\d{2}:\d{2})\s+([A-Z]+)\s+(\S+?):\s+([^\n]*)"


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Text lines as `value`; with max_lines (None or 0: all) the first ones, by file path and place in the file."""
    lines = spark.read.text(path)
    return first_lines(lines, max_lines) if max_lines else lines


def first_lines(lines: DataFrame, most: int) -> DataFrame:
    """The first `most` lines of a table that is read from text files, in order of path and place.

    Files are read in splits, whose lines are counted; a running count over the splits finds the one where the cap
    falls. Splits before it are taken whole, by a filter on their position; only in that one split are lines numbered,
    in the order in which its task reads them. So no task holds more than one split.
    """
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    splits = placed.groupBy("path", "start").agg(F.count("*").alias("n"))
    reached = running_sum(durable(splits), [], ["path", "start"], F.col("n"), "upto").where(F.col("upto") >= most)
    edge = reached.agg(F.min(F.struct("path", "start", "n", "upto")).alias("edge")).first().edge
    if edge is None:
        return lines
    path, start = F.col("path"), F.col("start")
    whole = placed.where((path < edge.path) | ((path == edge.path) & (start < edge.start))).select("value")
    cut = placed.where((path == edge.path) & (start == edge.start)).withColumn("_at", F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy("path", "start").orderBy("_at"))
    return whole.unionByName(cut.withColumn("_no", number).where(F.col("_no") <= most - (edge.upto - edge.n)).select("value"))


def g(i: int) -> Column:
    """Capture group i of the line, counted from 0."""
    return F.get("g", F.lit(i))


def _alerts(parsed: DataFrame, ts: Column, source: str, service: Column, severity: Column, message: Column):
    return (
        parsed.withColumn("ts", ts.cast("timestamp_ntz"))
        .where(F.col("ts").isNotNull())
        .select(
            "ts",
            F.lit(source).alias("source"),
            service.alias("service"),
            severity.alias("severity"),
            message.alias("message"),
            F.lit("").alias("event_id"),
            F.col("value").alias("raw_line"),
        )
    )


def _stamp(date: Column, time: Column, layout: str) -> Column:
    full = F.concat(century(F.substring(date, 1, 2)), date, F.lit(" "), time)
    return F.try_to_timestamp(full, F.lit(layout))


def parse_storage_lines(lines: DataFrame) -> DataFrame:
    """Lines without the pattern or with an impossible date are dropped."""
    parsed = text.computed_once(lines, g=text.regex_groups(F.col("value"), STORAGE_LINE, 6)).where(F.size("g") == 6)
    severity = text.storage_severity(g(3), g(5))
    return _alerts(parsed, _stamp(g(0), g(1), "yyyyMMdd HHmmss"), "hdfs", g(4), severity, g(5))


def parse_spark_lines(lines: DataFrame) -> DataFrame:
    parsed = text.computed_once(lines, g=text.regex_groups(F.col("value"), SPARK_LINE, 5)).where(F.size("g") == 5)
    return _alerts(parsed, _stamp(g(0), g(1), "yyyy/MM/dd HH:mm:ss"), "spark", g(3), g(2), g(4))
