"""Filtering, filling, de-duplication and statistics of the alert table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import schema
from alertloom.functions import text


def severity_filter(alerts: DataFrame, severities: Sequence[str] = schema.ALERT_SEVERITIES) -> DataFrame:
    return alerts.where(F.col("severity").isin(list(severities)))


def time_bound(alerts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep [start, end). A date alone is a bound at midnight. Reaches the scan as a range filter."""
    if start:
        alerts = alerts.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        alerts = alerts.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return alerts


def fill_unknown(alerts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return alerts.withColumns({c: text.fill_unknown(F.col(c)) for c in columns})


def valid_alerts(alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """Drop rows without a readable timestamp or without any message text."""
    message = F.coalesce(F.when(F.col("cleaned_message") != "", F.col("cleaned_message")), F.col("message"))
    readable = F.col(ts).cast("string").try_cast("timestamp_ntz").isNotNull()
    return alerts.where(readable & ~text.is_blank(message))


def dedup_first(alerts: DataFrame, key: Sequence[str], order: Column | str) -> DataFrame:
    """Keep the first row of each key.

    One aggregation: copies collapse in the map tasks, so a key that holds a
    third of all rows ships one row per task.
    """
    payload = [c for c in alerts.columns if c not in key]
    order = F.col(order) if isinstance(order, str) else order
    first = alerts.groupBy(*key).agg(F.min_by(F.struct(*payload), order).alias("_first"))
    return first.select(*[F.col(c) if c in key else F.col("_first")[c].alias(c) for c in alerts.columns])


def dedup_log_alerts(alerts: DataFrame, order: Column | str = "alert_id") -> DataFrame:
    """Equal timestamp and message, whatever the service."""
    return dedup_first(alerts, ["ts", "message"], order)


def dedup_aiops_alerts(alerts: DataFrame, order: Column | str = "alert_id") -> DataFrame:
    """As above, but replicas that log the same line in the same second stay apart."""
    return dedup_first(alerts, ["ts", "service", "message"], order)


def combined(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def with_cleaned_message(alerts: DataFrame, unicode: bool = True) -> DataFrame:
    return alerts.withColumn("cleaned_message", text.clean_message(F.col("message"), unicode))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Counts by source and by severity in one pass."""
    return (
        alerts.groupingSets([["source"], ["severity"]], "source", "severity")
        .agg(F.grouping("source").alias("g"), F.count("*").alias("n"))
        .select(
            F.when(F.col("g") == 0, "source").otherwise("severity").alias("dimension"),
            F.coalesce("source", "severity").alias("value"),
            "n",
        )
    )


def top_services(alerts: DataFrame, k: int = 10) -> DataFrame:
    counts = alerts.groupBy("service").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "service").limit(k)


def time_range(alerts: DataFrame) -> DataFrame:
    span = alerts.agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("*").alias("n"))
    seconds = (F.unix_micros(F.col("latest").cast("timestamp")) - F.unix_micros(F.col("earliest").cast("timestamp")))
    return span.withColumn("span_sec", seconds / 1e6)


def per_minute(alerts: DataFrame, source: str | None = None) -> DataFrame:
    if source:
        alerts = alerts.where(F.col("source") == source)
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return alerts.groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))


#: log2 of the registers of a template sketch, and three standard errors of its counts.
SKETCH_BITS = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def template_sketches(cleaned: DataFrame) -> DataFrame:
    """(hour, service, alerts, sketch): mergeable distinct counts of templates, one row an hour and service.

    A sketch takes a few KB, whatever it has seen, and is combined in the map tasks. To be stored and added to: sketches
    of any parts of the alerts merge into one of all of them, within the same error.
    """
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    sketch = F.hll_sketch_agg("cleaned_message", F.lit(SKETCH_BITS)).alias("sketch")
    return cleaned.groupBy(hour, "service").agg(F.count("*").alias("alerts"), sketch)


def sketched_templates(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., alerts, templates): about how many templates the rows of each group have, from their merged sketches."""
    merged = sketches.groupBy(*by).agg(F.sum("alerts").alias("alerts"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("templates"))


def template_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(
        F.count("*").alias("alerts"), F.countDistinct("cleaned_message").alias("templates")
    )
