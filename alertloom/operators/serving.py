"""Tables a dashboard reads: light incidents, capped members, texts and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import schema
from alertloom.functions import text
from alertloom.functions.time import clock
from alertloom.operators.ordering import top_per_group


# The wording of explanations and prompts.
EXPLANATION = (
    "Correlation collapsed %s alerts on %s into a single incident spanning %s. Root candidate: %s — %s.%s"
)
SPREAD = " Alerts also correlated from: %s."
PROMPT = """You are an expert Site Reliability Engineer analyzing a cluster of alerts. 
Below are the top %d root cause alerts extracted from the incident cluster:

%s

In exactly 2 concise sentences, explain what the root cause likely is and what failed. 
Use plain English. Do not hallucinate details not present in the logs.
"""
PROMPT_LINE = "[%s] %s (%s): %s"


def tags(service: Column, severity: Column) -> Column:
    level = F.upper(F.coalesce(F.when(severity != "", severity), F.lit("ERROR")))
    name = F.coalesce(F.when(service != "", service), F.lit("unknown"))
    priority = F.when(level.isin("FATAL", "ERROR"), "P1").otherwise("P2")
    return F.array(F.upper(text.base_service(name)), level, F.lit("AIOPS"), priority)


def explanation(incidents: DataFrame, services: DataFrame) -> DataFrame:
    """Add `explanation`, a sentence or two built from the incident's figures."""
    seconds = F.greatest(
        F.lit(1).cast("long"), F.call_function("div", F.col("end_us") - F.col("start_us"), F.lit(1_000_000))
    )
    minutes = F.call_function("div", seconds, F.lit(60))
    duration = F.when(
        seconds >= 60, F.format_string("%dm %ds", minutes, seconds - minutes * 60)
    ).otherwise(F.format_string("%ds", seconds))
    others = F.slice(F.array_remove(F.col("services"), F.col("root_service")), 1, 4)
    spread = F.when(F.size(others) > 0, F.format_string(SPREAD, F.array_join(others, ", "))).otherwise("")
    sentence = F.format_string(
        EXPLANATION,
        F.format_number("member_count", 0),
        F.col("root_service"),
        duration,
        F.col("root_severity"),
        F.substring(text.strip(F.col("root_message")), 1, 140),
        spread,
    )
    return incidents.join(services, "component_id").withColumn("explanation", sentence)


def prompts(incidents: DataFrame) -> DataFrame:
    """One prompt per incident from its candidates. Only the text; nothing is sent anywhere."""
    lines = F.transform(
        "candidates",
        lambda c: F.format_string(PROMPT_LINE, clock(c["ts"]), c["severity"], c["service"], c["message"]),
    )
    prompt = F.format_string(PROMPT, F.size("candidates"), F.array_join(lines, "\n"))
    return incidents.select("incident_id", prompt.alias("prompt"))


LIGHT_COLUMNS = [
    "incident_id",
    "title",
    "root_alert_id",
    "root_ts",
    "root_service",
    "root_severity",
    "root_message",
    "confidence",
    "span_start",
    "span_end",
    "suppressed_count",
    "member_count",
    "status",
]


def light(incidents: DataFrame) -> DataFrame:
    """The list view: everything but the members."""
    return incidents.select(*LIGHT_COLUMNS)


def capped_members(members: DataFrame, incidents: DataFrame, cap: int = schema.DETAIL_MEMBERS) -> DataFrame:
    """The first `cap` members of each incident by time, with row ids and the true count."""
    kept = top_per_group(members, "component_id", [F.col("ts_us"), F.col("alert_id")], cap, "_rn")
    row = F.col("_rn") - 1
    named = kept.join(incidents.select("component_id", "incident_id", "member_count"), "component_id")
    return named.select(
        "component_id",
        "incident_id",
        row.alias("row"),
        F.concat("incident_id", F.lit("_a"), row.cast("string")).alias("id"),
        "alert_id",
        "ts",
        "service",
        "severity",
        "message",
        "member_count",
    )


def root_member_id(capped: DataFrame, incidents: DataFrame) -> DataFrame:
    """The id of the first listed member that equals the root alert, else `<incident>_root`."""
    key = ["component_id", "ts", "service", "message"]
    firsts = capped.groupBy(*key).agg(F.min("row").alias("row"))
    roots = incidents.select(
        "component_id",
        "incident_id",
        F.col("root_ts").alias("ts"),
        F.col("root_service").alias("service"),
        F.col("root_message").alias("message"),
    )
    found = F.concat("incident_id", F.lit("_a"), F.col("row").cast("string"))
    return roots.join(firsts, key, "left").select(
        "incident_id",
        F.coalesce(found, F.concat("incident_id", F.lit("_root"))).alias("root_id"),
    )


def detail_timeline(capped: DataFrame, k: int = schema.DETAIL_TIMELINE_ROWS) -> DataFrame:
    """The first k members of an incident."""
    return capped.where(F.col("row") < k).select(
        "incident_id",
        "row",
        clock(F.col("ts")).alias("t"),
        F.concat("severity", F.lit(" · "), F.substring("message", 1, 90)).alias("d"),
        (F.col("row") == 0).alias("now"),
    )


def confidence_percent(confidence: Column) -> Column:
    return F.round(F.when(confidence <= 1, confidence * 100).otherwise(confidence)).cast("long")


def queue(incidents: DataFrame) -> DataFrame:
    """All incidents but the first, as the side list shows them."""
    return incidents.where(F.col("incident_no") > 1).select(
        F.col("incident_id").alias("id"),
        "title",
        confidence_percent(F.col("confidence")).alias("confidence"),
        F.col("suppressed_count").alias("alerts"),
        F.concat(((F.col("incident_no") - 1) * 3).cast("string"), F.lit("m")).alias("age"),
        text.base_service(F.col("root_service")).alias("host"),
    )


def reduction_metrics(incidents: DataFrame) -> DataFrame:
    totals = incidents.agg(
        F.coalesce(F.sum("member_count"), F.lit(0)).alias("total_alerts"),
        F.count("*").alias("total_incidents"),
        F.coalesce(F.sum("suppressed_count"), F.lit(0)).alias("suppressed"),
    )
    whole = F.col("total_alerts")
    return totals.withColumns(
        {
            "noise_reduction": F.when(whole == 0, F.lit(0.0)).otherwise(
                F.round(100.0 * F.col("suppressed") / whole, 1)
            ),
            "reduction_kpi": F.when(whole == 0, F.lit(0.0)).otherwise(
                F.round(100.0 - F.col("total_incidents") / whole * 100.0, 1)
            ),
        }
    )


def display_rows(alerts: DataFrame) -> DataFrame:
    """Alerts as the live list shows them."""
    return alerts.select(
        "alert_id",
        clock(F.col("ts")).alias("time"),
        F.coalesce("severity", F.lit("WARN")).alias("sev"),
        F.coalesce("service", F.lit("unknown")).alias("src"),
        F.substring(F.coalesce("message", F.lit("")), 1, 120).alias("msg"),
        F.coalesce(F.col("severity").isin("FATAL", "ERROR"), F.lit(False)).alias("focus"),
    )
