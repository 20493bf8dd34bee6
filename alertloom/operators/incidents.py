"""Root-cause ranking and incident assembly.

Per-component figures come from (component, vector) counts, not from alert pairs:
alerts that share a vector share their cohesion. Only components with two or more
distinct vectors need vector arithmetic at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertloom import schema
from alertloom.functions import text
from alertloom.functions.time import bucket, clock, from_micros
from alertloom.functions.vectors import dot, unit_vectors
from alertloom.operators.ordering import ranked, top_per_group
from alertloom.session import durable

GROUP_COLUMNS = ["start_us", "end_us", "members", "cohesion"]


def group_figures(counts: DataFrame, vectors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start, end and size per component, cohesion per (component, vector).

    `counts`: by..., component_id, vec_id, n, first_us, last_us; several rows per key are fine.
    Cohesion is the mean cosine of an alert with the other members, 1 for a single
    alert. With S the sum of the unit vectors it is (u.S - u.u) / (n - 1).
    """
    group = [*by, "component_id"]
    per_vec = counts.groupBy(*group, "vec_id").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    )
    totals = per_vec.groupBy(*group).agg(
        F.min("first_us").alias("start_us"),
        F.max("last_us").alias("end_us"),
        F.sum("n").alias("members"),
        F.count("*").alias("_vecs"),
    )
    # Written once: three branches below read it.
    sized = durable(per_vec.drop("first_us", "last_us").join(totals, group))
    plain = sized.where("_vecs = 1").withColumn("cohesion", F.lit(1.0))
    mixed = sized.where("_vecs > 1").join(unit_vectors(vectors), "vec_id")
    # Written, so that its real size is known: where components are few, their members' vectors are not shuffled to meet it.
    sums = durable(
        mixed.groupBy(*group).agg(
            vector_to_array(Summarizer.sum(array_to_vector("unit"), F.col("n").cast("double"))).alias("_sum")
        )
    )
    pulled = mixed.join(sums, group).withColumn(
        "cohesion",
        (dot(F.col("unit"), F.col("_sum")) - dot(F.col("unit"), F.col("unit")))
        / (F.col("members") - 1),
    )
    out = [*group, "vec_id", *GROUP_COLUMNS]
    return plain.select(*out).unionByName(pulled.select(*out))


def candidate_score(severity: Column, seconds_after_start: Column, cohesion: Column) -> Column:
    """Earliest first, then severity, then closeness to the rest of the component."""
    earliness = 1.0 / (1.0 + seconds_after_start / 60.0)
    return 0.45 * earliness + 0.30 * text.severity_rank(severity) / 4.0 + 0.25 * cohesion


def score_members(labelled: DataFrame, vectors: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Labelled alerts with the figures of their component and their own `score`."""
    if not set(GROUP_COLUMNS) <= set(labelled.columns):
        if figures is None:
            counts = labelled.groupBy("component_id", "vec_id").agg(
                F.count("*").alias("n"),
                F.min("ts_us").alias("first_us"),
                F.max("ts_us").alias("last_us"),
            )
            figures = group_figures(counts, vectors)
        labelled = labelled.join(figures, ["component_id", "vec_id"], "left")
    # Alerts without a usable vector are components of their own.
    alone = labelled.withColumns(
        {
            "start_us": F.coalesce("start_us", "ts_us"),
            "end_us": F.coalesce("end_us", "ts_us"),
            "members": F.coalesce("members", F.lit(1).cast("long")),
            "cohesion": F.coalesce("cohesion", F.lit(1.0)),
        }
    )
    seconds = (F.col("ts_us") - F.col("start_us")) / 1e6
    return alone.withColumn("score", candidate_score(F.col("severity"), seconds, F.col("cohesion")))


def candidates(members: DataFrame, k: int = 3) -> DataFrame:
    """The k best members per component, with `rn` and their share of the k scores.

    Scores are compared to 9 digits, so that equal ones fall to the earlier alert.
    """
    order = [F.desc(F.round("score", 9)), F.col("ts_us"), F.col("alert_id")]
    return top_per_group(members, "component_id", order, k)


def with_confidence(top: DataFrame) -> DataFrame:
    totals = top.groupBy("component_id").agg(F.sum("score").alias("_total"))
    share = F.col("score") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total"))
    return top.join(totals, "component_id").withColumn("confidence", F.round(share, 3)).drop("_total")


def title(service: Column, cleaned: Column, message: Column) -> Column:
    body = text.strip(F.coalesce(F.when(cleaned != "", cleaned), message, F.lit("")))
    body = text.clip(F.when(body != "", body).otherwise(F.coalesce(message, F.lit(""))), 60)
    known = service.isNotNull() & (service != "") & (service != "unknown")
    return F.when(known, F.concat(service, F.lit(": "), body)).when(body != "", body).otherwise("incident")


def status(confidence: Column, members: Column) -> Column:
    sure = (confidence >= schema.CONFIDENCE_FLOOR) & (members >= schema.MIN_INCIDENT_SIZE)
    return F.when(sure, "confirmed").otherwise("needs_review")


def incident_id(number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit("inc_"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


ROOT_FIELDS = ["alert_id", "ts", "source", "service", "severity", "message", "cleaned_message"]


def incident_heads(members: DataFrame) -> DataFrame:
    """One row per component: root cause, figures, status and the three candidates.

    Built from the three best members, which carry all figures of their component.
    """
    top = candidates(members)
    root = F.col("rn") == 1
    picked = F.struct("rn", "alert_id", "ts", "severity", "service", "message", "score")
    heads = top.groupBy("component_id").agg(
        *[F.max(F.when(root, F.col(c))).alias(f"root_{c}") for c in ROOT_FIELDS],
        F.max(F.when(root, F.round("cohesion", 3))).alias("confidence"),
        F.first("start_us").alias("start_us"),
        F.first("end_us").alias("end_us"),
        F.first("members").alias("member_count"),
        F.array_sort(F.collect_list(picked)).alias("_top"),
    )
    total = F.aggregate("_top", F.lit(0.0), lambda s, c: s + c["score"])
    ranked = F.transform(
        "_top",
        lambda c: F.struct(
            c["alert_id"].alias("alert_id"),
            c["ts"].alias("ts"),
            c["severity"].alias("severity"),
            c["service"].alias("service"),
            c["message"].alias("message"),
            F.round(c["score"] / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")), 3).alias("confidence"),
        ),
    )
    return (
        heads.withColumn("_total", total)
        .withColumn("candidates", ranked)
        .withColumns(
            {
                "suppressed_count": F.col("member_count") - 1,
                "status": status(F.col("confidence"), F.col("member_count")),
                "title": title(F.col("root_service"), F.col("root_cleaned_message"), F.col("root_message")),
                "span_start": from_micros(F.col("start_us")),
                "span_end": from_micros(F.col("end_us")),
            }
        )
        .drop("_top", "_total")
    )


def number_incidents(heads: DataFrame) -> DataFrame:
    """Number incidents by first alert, from 1, without sorting them in one task."""
    numbered = ranked(heads, ["start_us", "component_id"], "_idx")
    number = F.col("_idx") + 1
    return numbered.withColumn("incident_no", number).withColumn("incident_id", incident_id(number)).drop("_idx")


def member_services(labelled: DataFrame) -> DataFrame:
    """The distinct services of a component, sorted. Bounded by the number of services."""
    return labelled.groupBy("component_id").agg(F.array_sort(F.collect_set("service")).alias("services"))


def run_summaries(alerts: DataFrame, cells: DataFrame) -> DataFrame:
    """What incident heads need of each run of cells (window_us, vec_id, bucket, run), by severity.

    (window_us, vec_id, run, rank, n, first_us, last_us, first, services): of alerts with one vector and severity, the
    earliest scores best in whatever component the run falls, so `first` (ts_us, alert_id, severity, service) stands
    for all of them. Alerts are combined map-side, once for each window.
    """
    windows = [r[0] for r in cells.select("window_us").distinct().collect()]  # as many as were asked for
    grid = F.array(*[F.lit(w).cast("long") for w in sorted(windows)]).cast("array<bigint>")
    timed = alerts.withColumn("window_us", F.explode(grid))
    rank = text.severity_rank(F.col("severity"))
    keys = ["window_us", "vec_id"]
    by_cell = (
        timed.groupBy(*keys, bucket(F.col("ts_us"), F.col("window_us")).alias("bucket"), rank.alias("rank"))
        .agg(
            F.count("*").alias("n"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.min(F.struct("ts_us", "alert_id", "severity", "service")).alias("first"),
            F.collect_set("service").alias("services"),
        )
        .join(cells.select(*keys, "bucket", "run"), [*keys, "bucket"])
    )
    return by_cell.groupBy(*keys, "run", "rank").agg(
        F.sum("n").alias("n"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min("first").alias("first"),
        F.array_distinct(F.flatten(F.collect_set("services"))).alias("services"),
    )


def run_heads(runs: DataFrame, figures: DataFrame) -> DataFrame:
    """(component_id, start_us, end_us, member_count, root_service, services) from labelled `run_summaries`."""
    seconds = (F.col("first.ts_us") - F.col("start_us")) / 1e6
    score = candidate_score(F.col("first.severity"), seconds, F.col("cohesion"))
    order = F.struct((-F.round(score, 9)).alias("score"), F.col("first.ts_us"), F.col("first.alert_id"), F.col("first.service"))
    heads = (
        runs.select("component_id", "vec_id", "first")
        .join(figures, ["component_id", "vec_id"])
        .groupBy("component_id")
        .agg(
            F.first("start_us").alias("start_us"),
            F.first("end_us").alias("end_us"),
            F.first("members").alias("member_count"),
            F.min(order)["service"].alias("root_service"),
        )
    )
    services = runs.select("component_id", F.explode("services").alias("service"))
    return heads.join(member_services(services), "component_id", "left").withColumn(
        "services", F.coalesce("services", F.array().cast("array<string>"))
    )


def lone_heads(alerts: DataFrame) -> DataFrame:
    """As run_heads, for alerts (setting, ...) that are incidents of their own."""
    return alerts.select(
        F.struct("setting", F.col("alert_id").alias("component_id")).alias("component_id"),
        F.col("ts_us").alias("start_us"),
        F.col("ts_us").alias("end_us"),
        F.lit(1).cast("long").alias("member_count"),
        F.col("service").alias("root_service"),
        F.array_compact(F.array("service")).alias("services"),
    )


def timeline(members: DataFrame, roots: DataFrame, k: int = schema.TIMELINE_ROWS) -> DataFrame:
    """The latest k alerts of each incident, latest first."""
    latest = top_per_group(members, "component_id", [F.desc("ts_us"), F.col("alert_id")], k, "row")
    joined = latest.join(roots.select("component_id", "incident_id", "root_alert_id"), "component_id")
    return joined.select(
        "incident_id",
        "row",
        clock(F.col("ts")).alias("t"),
        F.concat("severity", F.lit(" · "), text.clip(F.col("message"), 60)).alias("d"),
        (F.col("alert_id") == F.col("root_alert_id")).alias("now"),
    )


def audit(labelled: DataFrame, incidents: DataFrame) -> DataFrame:
    """Every member with its incident, its role and, for the root, the top confidence."""
    heads = incidents.select(
        "component_id", "incident_id", "root_alert_id", F.col("candidates")[0]["confidence"].alias("_top")
    )
    is_root = F.col("alert_id") == F.col("root_alert_id")
    return labelled.join(heads, "component_id").select(
        "alert_id",
        "incident_id",
        F.when(is_root, "root").otherwise("member").alias("role"),
        F.when(is_root, F.col("_top")).alias("candidate_conf"),
        "ts",
        "source",
        "service",
        "severity",
        "message",
    )


def size_distribution(incidents: DataFrame) -> DataFrame:
    """Alerts, incidents, noise reduction, and min / upper median / max size.

    The median is read off the cumulative counts of the distinct sizes, of which
    there are at most sqrt(2 * alerts).
    """
    sizes = incidents.groupBy("member_count").agg(F.count("*").alias("n"))
    upto = W.partitionBy(F.lit(0)).orderBy("member_count").rowsBetween(W.unboundedPreceding, 0)
    counted = sizes.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "total", F.sum("n").over(W.partitionBy(F.lit(0)))
    )
    middle = F.call_function("div", F.col("total"), F.lit(2))
    alerts = F.sum(F.col("member_count") * F.col("n"))
    return counted.agg(
        alerts.alias("alerts"),
        F.sum("n").alias("incidents"),
        F.round(100.0 * (alerts - F.sum("n")) / alerts, 1).alias("noise_reduction"),
        F.min("member_count").alias("min_size"),
        F.min(F.when(F.col("upto") > middle, F.col("member_count"))).alias("median_size"),
        F.max("member_count").alias("max_size"),
    )


def status_counts(incidents: DataFrame) -> DataFrame:
    return (
        incidents.groupingSets([["status"], ["root_severity"]], "status", "root_severity")
        .agg(F.grouping("status").alias("g"), F.count("*").alias("n"))
        .select(
            F.when(F.col("g") == 0, "status").otherwise("root_severity").alias("dimension"),
            F.coalesce("status", "root_severity").alias("value"),
            "n",
        )
    )
