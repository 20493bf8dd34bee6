"""Writers. Every one is a distributed write; time order is kept by range partitioning."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom import schema

#: The file that makes the tables of a run visible.
MANIFEST = "manifest"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, root: str, run: str, writers: Mapping[str, Callable[[str], None]]) -> None:
    """Write tables of one run so that readers see all of them or none, and a rerun neither doubles nor mixes them.

    Every attempt writes into a folder of its own, `<root>/<run>/<attempt>/<table>`. Only when all tables are there, one
    line with the attempt's name is written beside it and renamed to `manifest`. A run that has a manifest is left as
    it is; an attempt that dies leaves a folder that no reader looks at.
    """
    if committed(spark, root, run):
        return
    attempt = uuid.uuid4().hex
    for name, write in writers.items():
        write(f"{root}/{run}/{attempt}/{name}")
    staged, files = _hadoop(spark, f"{root}/{run}/staged-{attempt}")
    out = files.create(staged, True)
    out.write(bytearray(attempt.encode()))
    out.close()
    final, _ = _hadoop(spark, f"{root}/{run}/{MANIFEST}")
    # Of two attempts at once, one manifest remains, and with it the tables of one attempt.
    if not files.rename(staged, final):
        files.delete(staged, False)


def committed(spark: SparkSession, root: str, run: str) -> str | None:
    """The folder of a run's tables, None as long as the run is not committed."""
    final, files = _hadoop(spark, f"{root}/{run}/{MANIFEST}")
    if not files.exists(final):
        return None
    attempt = spark.read.text(f"{root}/{run}/{MANIFEST}").first().value
    return f"{root}/{run}/{attempt}"


def write_correlation(spark: SparkSession, root: str, run: str, alerts: DataFrame, incidents: DataFrame, audit_rows: DataFrame) -> None:
    """The artifacts of one correlation run, committed together: alerts in time order, incidents, audit."""
    commit(
        spark,
        root,
        run,
        {
            "alerts": lambda path: write_alerts_csv(alerts, path, "ts", "alert_id"),
            "incidents": lambda path: write_incidents_json(incidents, path),
            "audit": lambda path: write_audit_csv(audit_rows, path),
        },
    )


def time_ordered(alerts: DataFrame, *order: str) -> DataFrame:
    """Files in time order, and rows in time order within each file."""
    order = order or ("ts",)
    return alerts.repartitionByRange(*order).sortWithinPartitions(*order)


def write_alerts_csv(alerts: DataFrame, path: str, *order: str) -> None:
    columns = [c for c in alerts.columns if c in (*schema.ALERT_COLUMNS, "cleaned_message")]
    time_ordered(alerts, *(order or ("ts",))).select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def write_incidents_json(incidents: DataFrame, path: str) -> None:
    """One incident per line. Members are a table of their own, see write_members."""
    incidents.repartitionByRange("incident_no").sortWithinPartitions("incident_no").write.mode("overwrite").json(path)


def write_members(members: DataFrame, path: str) -> None:
    """Members of the incidents as JSON lines, those of one incident next to each other."""
    ordered = members.repartitionByRange("incident_id", "row").sortWithinPartitions("incident_id", "row")
    ordered.write.mode("overwrite").json(path)


def write_audit_csv(audit: DataFrame, path: str) -> None:
    ordered = audit.repartitionByRange("incident_id", "ts", "alert_id").sortWithinPartitions("incident_id", "ts", "alert_id")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def write_evaluation(metrics: DataFrame, matched: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    matched.write.mode("overwrite").json(f"{path}/details")


def summary_lines(metrics: DataFrame, incidents: DataFrame, k: int = 5) -> DataFrame:
    """A Markdown summary, one line per row in order of `line`: the rates and the first k incidents."""
    def row(label: str, column: str, unit: str = "%"):
        return F.concat(F.lit(f"| {label} | "), F.col(column).cast("string"), F.lit(f"{unit} |"))

    head = metrics.select(
        F.posexplode(
            F.array(
                F.lit("## Evaluation against labelled faults"),
                F.lit(""),
                F.lit("| Metric | Value |"),
                F.lit("|---|---|"),
                row("Labelled faults", "total_faults", ""),
                row("Detection rate (any incident nearby)", "detection_rate"),
                row("Detection rate (service-matched)", "detection_rate_service_matched"),
                row("Service localization", "localization_rate"),
                row("Root cause accuracy", "root_cause_accuracy"),
            )
        ).alias("line", "value")
    )
    first = incidents.orderBy("incident_no").limit(k)
    body = first.select(
        (F.col("incident_no") * 100).alias("base"),
        F.posexplode(
            F.array(
                F.lit(""),
                F.concat(F.lit("### "), F.col("incident_id"), F.lit(": "), F.col("title")),
                F.concat(F.lit("- Status: "), F.col("status")),
                F.concat(F.lit("- Confidence: "), F.col("confidence").cast("string")),
                F.concat(F.lit("- Members: "), F.col("member_count").cast("string"), F.lit(" alerts")),
                F.concat(F.lit("- Time span: "), F.col("span_start").cast("string"), F.lit(" → "), F.col("span_end").cast("string")),
                F.concat(F.lit("- Root cause: "), F.col("root_service"), F.lit(" — "), F.substring("root_message", 1, 100)),
            )
        ).alias("at", "value"),
    )
    lines = head.select(F.col("line").cast("long"), "value").unionByName(
        body.select((F.col("base") + F.col("at")).alias("line"), "value")
    )
    total = incidents.agg(F.count("*").cast("string").alias("n"))
    return lines.unionByName(
        total.select(F.lit(-1).cast("long").alias("line"), F.concat(F.lit("**Total incidents:** "), "n").alias("value"))
    ).orderBy("line")


def write_summary(metrics: DataFrame, incidents: DataFrame, path: str) -> None:
    """A few dozen lines, hence one file."""
    summary_lines(metrics, incidents).coalesce(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)
