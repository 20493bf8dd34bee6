"""End-to-end plans: alerts to members and incidents."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from alertloom import schema
from alertloom.functions.vectors import linkable
from alertloom.operators import alerts as A, components as C, embedding, evaluation, forest, incidents as I, segments
from alertloom.session import durable


class Correlated(NamedTuple):
    """`members`: every alert with its component and score; `incidents`: one numbered row per component."""

    members: DataFrame
    incidents: DataFrame


def scored_members(
    alerts: DataFrame,
    vectors: DataFrame,
    window_sec: float = schema.WINDOW_SEC,
    threshold: float = schema.SIMILARITY,
    cross_threshold: float | None = None,
    max_gap_sec: float | None = None,
    max_span_sec: float | None = None,
) -> DataFrame:
    """Alerts (alert_id, ts, ts_us, service, vec_id, ...) with component, figures and score.

    Components are cut in time if a largest gap or span is given; the other of the two then has its default.
    """
    cells = C.component_cells(alerts, vectors, window_sec, threshold, cross_threshold)
    if max_gap_sec is not None or max_span_sec is not None:
        # Cut on narrow rows, stored once; the alerts themselves are read and joined a single time.
        narrow = durable(C.label_alerts(alerts.select("alert_id", "ts_us", "vec_id"), cells, window_sec))
        gap = schema.MAX_GAP_SEC if max_gap_sec is None else max_gap_sec
        cut = durable(segments.segmented(narrow, gap, schema.MAX_SPAN_SEC if max_span_sec is None else max_span_sec))
        counts = cut.groupBy("component_id", "vec_id").agg(
            F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
        )
        labelled = alerts.join(cut.select("alert_id", "component_id"), "alert_id")
        return I.score_members(labelled, vectors, I.group_figures(counts, vectors))
    # Cells carry counts, so all figures come from them and alerts are joined once.
    figures = I.group_figures(cells, vectors)
    scored = cells.join(figures, ["component_id", "vec_id"])
    return I.score_members(C.label_alerts(alerts, scored, window_sec, I.GROUP_COLUMNS), vectors)


def correlate(alerts: DataFrame, vectors: DataFrame, **settings) -> Correlated:
    """As scored_members, written once, with the incidents built on it."""
    members = durable(scored_members(alerts, vectors, **settings))
    return Correlated(members, I.number_incidents(I.incident_heads(members)))


def testbed_alerts(parsed: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parsed testbed rows to the cleaned alert table: severity, time, blanks, copies, templates."""
    kept = A.time_bound(A.severity_filter(parsed), start, end)
    filled = A.fill_unknown(kept, ["source", "service", "severity", "message", "event_id", "raw_line"])
    once = A.dedup_aiops_alerts(filled, F.struct("event_id", "raw_line"))
    return A.with_cleaned_message(once)


def correlate_text(cleaned: DataFrame, **settings) -> Correlated:
    """Cleaned alerts without vectors: embed their service-tagged templates, then correlate."""
    # Both written once: templates and vectors are dear, and cells, figures and members read them.
    alerts = durable(embedding.tag_alerts(cleaned).drop("tagged"))
    vectors = durable(embedding.text_vectors(embedding.tag_alerts(alerts)).drop("tagged"))
    return correlate(alerts, vectors, **settings)


def parameter_sweep(
    alerts: DataFrame,
    vectors: DataFrame,
    faults: DataFrame,
    settings: Sequence[tuple[int, float, float]],
    tolerance_sec: float = schema.FAULT_TOLERANCE_SEC,
) -> DataFrame:
    """Noise reduction and accuracy of each (setting, window_sec, threshold), in one run.

    Alerts are grouped once for each window; a setting is a cut of the window's forest (`operators/forest.py`), and
    what follows works on runs. Only alerts without a usable vector, incidents of their own, have a row for each setting.
    """
    whole = forest.window_forest(alerts, vectors, settings)
    summaries = durable(I.run_summaries(alerts, whole.cells))
    labels = forest.cut(whole, settings).withColumn("component_id", F.struct("setting", "component_id"))
    named = durable(labels.join(summaries, ["window_us", "vec_id", "run"]))
    figures = I.group_figures(named, vectors)
    every = F.array(*[F.lit(s) for s, _, _ in settings])
    alone = alerts.join(linkable(vectors).select("vec_id"), "vec_id", "left_anti")
    heads = I.run_heads(named, figures).unionByName(I.lone_heads(alone.withColumn("setting", F.explode(every))))
    incidents = durable(
        heads.withColumns(
            {
                "setting": F.col("component_id.setting"),
                "incident_no": F.struct("start_us", "component_id"),
                "incident_id": F.col("component_id.component_id"),
            }
        )
    )
    asked = durable(faults.select("fault_id", "ts_us", "cmdb_id")).withColumn("setting", F.explode(every))
    matched = evaluation.fault_match(asked, incidents, tolerance_sec, by=["setting"])
    accuracy = matched.groupBy("setting").agg(*evaluation.counters())
    sizes = incidents.groupBy("setting").agg(
        F.sum("member_count").alias("alerts"), F.count("*").alias("incidents")
    )
    chosen = F.array(
        *[F.struct(F.lit(s).alias("setting"), F.lit(float(w)).alias("w"), F.lit(float(t)).alias("t")) for s, w, t in settings]
    )
    named_settings = F.element_at(F.filter(chosen, lambda c: c["setting"] == F.col("setting")), 1)
    return (
        sizes.join(accuracy, "setting")
        .withColumn("_c", named_settings)
        .select(
            F.col("setting").cast("long").alias("setting"),
            F.col("_c.w").alias("window_sec"),
            F.col("_c.t").alias("threshold"),
            "alerts",
            "incidents",
            F.round(100.0 * (F.col("alerts") - F.col("incidents")) / F.col("alerts"), 1).alias("noise_reduction"),
            evaluation.percent("detected", "total").alias("detection_rate"),
            evaluation.percent("root_localized", "detected").alias("root_cause_accuracy"),
        )
    )
