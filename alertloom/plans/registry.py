"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.functions import text
from alertloom.functions.vectors import l2_normalize
from alertloom.operators import (
    alerts as A,
    components as C,
    embedding,
    evaluation as E,
    incidents as I,
    linking,
    sampling,
    segments,
    serving,
)
from alertloom.plans import correlation, fixtures as fx
from alertloom.session import durable, prepare
from alertloom.sources import faults as gt, logs, sinks, testbed
from alertloom.streaming import feeds
from alertloom.streaming.densest import live_densest_window as live_densest
from alertloom.streaming.live import LiveCorrelation

# Settings of the registered queries; the test vectors are random, so the library's own would link little.
WINDOW, THRESHOLD, CROSS = 7200, 0.3, 0.4
GAP, SPAN = 3600, 14400
SWEEP = [(0, 3600, 0.3), (1, 3600, 0.4), (2, 7200, 0.3), (3, 7200, 0.4)]
TEXT_WINDOW, TEXT_THRESHOLD = 1800, 0.62
LIVE_THRESHOLD = 0.7
SAMPLE = 2000
SLICES = 5
REPLAY = 3000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return build(prepare(spark), sf)

    QUERIES[build.__name__] = run
    return build


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- sources -----------------------------------------------------------------------------------

LINE = ["ts", "source", "service", "severity", "message", "raw_line"]
PARSED = [*LINE[:-1], "event_id", "raw_line"]


@query
def parse_hdfs_lines(spark, sf):
    return logs.parse_storage_lines(fx.storage_lines(spark, sf)).select(LINE)


@query
def testbed_folder(spark, sf):
    """Service logs written as the testbed's CSV files and read back from its folders."""
    root = feeds.scratch(spark, "testbed")
    layout = testbed.LAYOUTS["normal"].replace("*", "day-1")
    fx.service_logs(spark, sf).write.option("header", True).option("escape", '"').csv(f"{root}/{layout}/{testbed.FILES['service']}")
    rows = testbed.read_kind(spark, root, "service")
    labels = rows.select("log_id", "dataset_type", "label")
    return testbed.parse_service_logs(rows).select("ts", "service", "severity", "message", "event_id").join(
        labels, F.col("event_id") == F.col("log_id")
    ).drop("log_id")


@query
def capped_lines(spark, sf):
    """Lines written as text files and read back up to a cap that holds them all: their number."""
    root = feeds.scratch(spark, "lines")
    fx.storage_lines(spark, sf).write.text(root)
    most = logs.read_lines(spark, root).count()
    return logs.parse_storage_lines(logs.read_lines(spark, root, most)).select(LINE)


@query
def parse_spark_lines(spark, sf):
    return logs.parse_spark_lines(fx.spark_lines(spark, sf)).select(LINE)


@query
def parse_service_logs(spark, sf):
    return testbed.parse_service_logs(fx.service_logs(spark, sf)).select(PARSED)


@query
def parse_gateway_logs(spark, sf):
    return testbed.parse_gateway_logs(fx.gateway_logs(spark, sf)).select(PARSED)


@query
def parse_trace_spans(spark, sf):
    return testbed.parse_spans(fx.spans(spark, sf)).select(PARSED)


@query
def aiops_alerts(spark, sf):
    parsed = testbed.parse_all(fx.service_logs(spark, sf), fx.gateway_logs(spark, sf), fx.spans(spark, sf))
    return correlation.testbed_alerts(parsed, "2024-01-02", "2024-01-25").select("ts", "service", "severity", "message", "event_id")


@query
def parse_stats(spark, sf):
    return testbed.parse_stats(fx.service_logs(spark, sf), fx.gateway_logs(spark, sf), fx.spans(spark, sf))


@query
def load_ground_truth(spark, sf):
    return gt.merge_faults(fx.fault_csv(spark, sf), fx.fault_json(spark, sf))


@query
def ground_truth_counts(spark, sf):
    return E.fault_counts(fx.faults(spark, sf))


@query
def translate_failure_type(spark, sf):
    return gt.translate_failure_type(fx.fault_csv(spark, sf)).select("timestamp", "cmdb_id", "failure_type", "failure_type_en")


# --- rows and text -----------------------------------------------------------------------------


@query
def severity_filter(spark, sf):
    return A.severity_filter(fx.alerts(spark, sf)).select("alert_id", "ts", "source", "service", "severity", "message")


@query
def infer_severity_hdfs(spark, sf):
    body = F.col("text")
    return fx.documents(spark, sf).select("doc_id", text.storage_severity(F.lit("INFO"), body).alias("severity"))


@query
def infer_severity_text(spark, sf):
    return fx.documents(spark, sf).select("doc_id", text.text_severity(F.col("text")).alias("severity"))


@query
def normalize_severity(spark, sf):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", " critical ")
        .when(kind == "click", "Err")
        .when(kind == "view", "warning")
        .when(kind == "signup", "finest")
        .otherwise("notice")
    )
    return fx.events(spark, sf).select("event_id", text.normalize_severity(raw).alias("severity"))


@query
def time_bound(spark, sf):
    return A.time_bound(fx.alerts(spark, sf), "2024-01-10", "2024-01-20T12:00:00").select("alert_id", "ts", "severity")


@query
def fill_unknown(spark, sf):
    blank = (
        fx.alerts(spark, sf)
        .withColumn("service", F.when(F.col("severity") == "INFO", "  ").otherwise(F.col("service")))
        .withColumn("source", F.when(F.col("source") == "spark", None).otherwise(F.col("source")))
    )
    return A.fill_unknown(blank, ["source", "service", "message"]).select("alert_id", "source", "service", "message")


@query
def valid_alerts(spark, sf):
    rough = fx.correlated_alerts(spark, sf).select(
        "alert_id",
        F.when(F.col("severity") == "FATAL", "yesterday").otherwise(F.col("ts").cast("string")).alias("ts_text"),
        F.when(F.col("source") == "hdfs", "").otherwise(F.col("cleaned_message")).alias("cleaned_message"),
        F.when(F.col("severity") == "WARN", " \t").otherwise(F.col("message")).alias("message"),
    )
    return A.valid_alerts(rough, ts="ts_text").select("alert_id", "cleaned_message")


@query
def clean_message(spark, sf):
    return A.with_cleaned_message(fx.alerts(spark, sf), unicode=False).select("alert_id", "cleaned_message")


@query
def clean_documents(spark, sf):
    return fx.documents(spark, sf).select("doc_id", text.clean_message(F.col("text"), unicode=False).alias("cleaned"))


@query
def base_service(spark, sf):
    return fx.alerts(spark, sf).select("alert_id", text.base_service(F.col("service")).alias("base"))


@query
def service_tagged_text(spark, sf):
    cleaned = fx.correlated_alerts(spark, sf)
    service = F.when(F.col("severity") == "FATAL", "unknown").otherwise(F.col("service"))
    return cleaned.select("alert_id", text.service_tagged_text(service, F.col("cleaned_message")).alias("tagged"))


@query
def display_rows(spark, sf):
    return serving.display_rows(fx.alerts(spark, sf))


def hourly(spark, sf) -> DataFrame:
    """Alerts with copies: the same kind of event within an hour reads the same."""
    return fx.alerts(spark, sf).withColumns(
        {
            "ts": F.date_trunc("hour", "ts").cast("timestamp_ntz"),
            "message": F.concat(F.element_at(F.split("message", " "), 1), F.lit(" failed")),
        }
    )


@query
def dedup_log_alerts(spark, sf):
    return A.dedup_log_alerts(hourly(spark, sf)).select("alert_id", "ts", "service", "message", "severity")


@query
def dedup_aiops_alerts(spark, sf):
    return A.dedup_aiops_alerts(hourly(spark, sf)).select("alert_id", "ts", "service", "message", "severity")


@query
def combined_alerts(spark, sf):
    both = A.combined(
        logs.parse_storage_lines(fx.storage_lines(spark, sf)), logs.parse_spark_lines(fx.spark_lines(spark, sf))
    )
    filled = A.fill_unknown(A.severity_filter(both), ["source", "service", "severity", "message", "event_id", "raw_line"])
    return A.dedup_log_alerts(filled, F.struct("source", "raw_line")).select(PARSED)


# --- statistics and samples --------------------------------------------------------------------


@query
def alert_counts(spark, sf):
    return A.alert_counts(A.severity_filter(fx.alerts(spark, sf)))


@query
def top_services(spark, sf):
    return A.top_services(A.severity_filter(fx.alerts(spark, sf)))


@query
def alert_time_range(spark, sf):
    return A.time_range(A.severity_filter(fx.alerts(spark, sf)))


@query
def alerts_per_minute(spark, sf):
    return A.per_minute(fx.alerts(spark, sf), "hdfs")


@query
def template_counts(spark, sf):
    return A.template_counts(fx.correlated_alerts(spark, sf))


@query
def template_estimates(spark, sf):
    """Templates per service, from hourly sketches that were stored and merged, beside the exact number."""
    cleaned = fx.correlated_alerts(spark, sf)
    about = A.sketched_templates(durable(A.template_sketches(cleaned)), "service")
    exact = cleaned.groupBy("service").agg(F.countDistinct("cleaned_message").alias("exact"))
    close = F.abs(F.col("templates") - F.col("exact")) <= F.ceil(A.SKETCH_ERROR * F.col("exact"))
    return about.join(exact, "service").select("service", "alerts", F.col("exact").alias("templates"), close.alias("within_bound"))


@query
def densest_window(spark, sf):
    return sampling.densest_window(fx.alerts(spark, sf), 60, "hdfs")


@query
def stratified_sample(spark, sf):
    cleaned = fx.correlated_alerts(spark, sf)
    busiest = durable(sampling.densest_window(cleaned, 60 * 24 * 10, "hdfs"))
    spread = sampling.stratified_sample(cleaned, busiest, target=SAMPLE + 1000)
    return spread.select("alert_id", "source", "cleaned_message")


@query
def even_sample(spark, sf):
    return sampling.even_sample(A.severity_filter(fx.alerts(spark, sf)), SAMPLE).select("alert_id", "idx")


@query
def replay_sample(spark, sf):
    return sampling.replay_sample(A.severity_filter(fx.alerts(spark, sf)), REPLAY)


@query
def replay_page(spark, sf):
    return sampling.replay_page(sampling.replay_sample(A.severity_filter(fx.alerts(spark, sf)), REPLAY), 100, 120)


@query
def replay_envelopes(spark, sf):
    """A page inside the feed, and one past its end."""
    feed = durable(sampling.replay_sample(A.severity_filter(fx.alerts(spark, sf)), REPLAY))
    pages = [sampling.replay_envelope(feed, cursor, 120).withColumn("cursor", F.lit(cursor).cast("long")) for cursor in (100, 10**9)]
    ids = F.array_join(F.transform("items", lambda i: i["id"]), ",")
    return pages[0].unionByName(pages[1]).select("cursor", ids.alias("ids"), "next_cursor", "total")


# --- vectors and the graph ---------------------------------------------------------------------


@query
def l2_normalize_vectors(spark, sf):
    unit = fx.vectors(spark, sf).select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return unit.select("vec_id", F.col("dim").cast("long").alias("dim"), r6("x").alias("x"))


@query
def embedding_sync_check(spark, sf):
    return embedding.sync_check(fx.alerts(spark, sf).withColumn("vec_id", F.col("alert_id")), fx.vectors(spark, sf))


@query
def text_vectors(spark, sf):
    tagged = embedding.tag_alerts(fx.correlated_alerts(spark, sf))
    one = embedding.text_vectors(tagged).select("vec_id", "tagged", F.posexplode("embedding").alias("dim", "x")).where("x != 0")
    return one.select("vec_id", "tagged", F.col("dim").cast("long").alias("dim"), r6("x").alias("x"))


@query
def similarity_edges(spark, sf):
    edges = linking.similarity_edges(fx.correlated_alerts(spark, sf), fx.vectors(spark, sf), WINDOW, THRESHOLD)
    return edges.withColumn("sim", r6("sim"))


@query
def cross_service_edges(spark, sf):
    edges = linking.cross_service_edges(fx.correlated_alerts(spark, sf), fx.vectors(spark, sf), WINDOW, THRESHOLD, CROSS)
    return edges.withColumn("sim", r6("sim"))


@query
def connected_components(spark, sf):
    return C.connected_components(fx.correlated_alerts(spark, sf), fx.vectors(spark, sf), WINDOW, THRESHOLD)


@query
def cross_service_components(spark, sf):
    return C.connected_components(fx.correlated_alerts(spark, sf), fx.vectors(spark, sf), WINDOW, THRESHOLD, CROSS)


@query
def graph_size(spark, sf):
    alerts, vectors = fx.correlated_alerts(spark, sf), fx.vectors(spark, sf)
    edges = linking.similarity_edges(alerts, vectors, WINDOW, THRESHOLD).agg(F.sum("n_links").alias("n"))
    found = C.connected_components(alerts, vectors, WINDOW, THRESHOLD)
    return found.agg(F.count("*").alias("alerts"), F.countDistinct("component_id").alias("components")).withColumn(
        "edges", edges.scalar()
    )


def labelled(spark, sf) -> DataFrame:
    alerts = fx.correlated_alerts(spark, sf)
    return C.label_alerts(alerts, C.component_cells(alerts, fx.vectors(spark, sf), WINDOW, THRESHOLD), WINDOW)


@query
def gap_segments(spark, sf):
    return segments.gap_segments(labelled(spark, sf), GAP).select("alert_id", "component_id", "gap_no")


@query
def span_segments(spark, sf):
    cut = segments.span_segments(labelled(spark, sf), GAP, SPAN)
    return cut.select("alert_id", "component_id", "gap_no", "span_no")


# --- ranking and incidents ---------------------------------------------------------------------


def members(spark, sf) -> DataFrame:
    return correlation.scored_members(
        fx.correlated_alerts(spark, sf), fx.vectors(spark, sf), window_sec=WINDOW, threshold=THRESHOLD
    )


def found(spark, sf) -> correlation.Correlated:
    return correlation.correlate(
        fx.correlated_alerts(spark, sf), fx.vectors(spark, sf), window_sec=WINDOW, threshold=THRESHOLD
    )


def found_segmented(spark, sf) -> correlation.Correlated:
    return correlation.correlate(
        fx.correlated_alerts(spark, sf),
        fx.vectors(spark, sf),
        window_sec=WINDOW,
        threshold=THRESHOLD,
        cross_threshold=CROSS,
        max_gap_sec=GAP,
        max_span_sec=SPAN,
    )


@query
def cohesion(spark, sf):
    return members(spark, sf).select("alert_id", "component_id", r6("cohesion").alias("cohesion"))


@query
def candidate_scores(spark, sf):
    return members(spark, sf).select("alert_id", "component_id", r6("score").alias("score"))


@query
def root_cause_top3(spark, sf):
    top = I.with_confidence(I.candidates(members(spark, sf)))
    return top.select("component_id", "rn", "alert_id", "confidence")


@query
def incident_status(spark, sf):
    return I.incident_heads(members(spark, sf)).select("component_id", "root_alert_id", "confidence", "status")


@query
def incident_summary(spark, sf):
    scored = members(spark, sf)
    heads = I.incident_heads(scored).join(I.member_services(scored), "component_id")
    return heads.select(
        "component_id",
        "span_start",
        "span_end",
        "member_count",
        "suppressed_count",
        F.array_join("services", ",").alias("services"),
    )


@query
def incident_ids(spark, sf):
    return found(spark, sf).incidents.select("component_id", "incident_no", "incident_id")


@query
def incident_title(spark, sf):
    return I.incident_heads(members(spark, sf)).select("component_id", "title")


@query
def incidents(spark, sf):
    return found(spark, sf).incidents.select(
        *serving.LIGHT_COLUMNS,
        F.array_join(
            F.transform("candidates", lambda c: F.concat_ws(":", c["alert_id"], c["confidence"])), "|"
        ).alias("candidates"),
    )


@query
def incidents_from_text(spark, sf):
    """Event alerts and whole documents, each from its text alone to ranked incidents."""
    both = fx.correlated_alerts(spark, sf).drop("vec_id").unionByName(fx.document_alerts(spark, sf))
    return correlation.correlate_text(both, window_sec=TEXT_WINDOW, threshold=TEXT_THRESHOLD).incidents.select(*serving.LIGHT_COLUMNS)


@query
def segmented_incidents(spark, sf):
    return found_segmented(spark, sf).incidents.select(*serving.LIGHT_COLUMNS)


@query
def incident_timeline(spark, sf):
    both = found(spark, sf)
    return I.timeline(both.members, both.incidents)


@query
def cluster_audit(spark, sf):
    both = found(spark, sf)
    return I.audit(both.members, both.incidents)


@query
def committed_artifacts(spark, sf):
    """Alerts, incidents and audit written as one run, twice, and read back from what is committed."""
    both = found(spark, sf)
    root = feeds.scratch(spark, "artifacts")
    for _ in range(2):
        sinks.write_correlation(spark, root, "run-1", both.members, both.incidents, I.audit(both.members, both.incidents))
    folder = sinks.committed(spark, root, "run-1")
    audit = spark.read.option("header", True).csv(f"{folder}/audit")
    incidents = spark.read.json(f"{folder}/incidents").select("incident_id", "title", "member_count")
    return audit.join(incidents, "incident_id").select(F.col("alert_id").cast("long").alias("alert_id"), "incident_id", "role", "title", "member_count")


@query
def cluster_sizes(spark, sf):
    return I.size_distribution(I.incident_heads(members(spark, sf)))


@query
def status_counts(spark, sf):
    return I.status_counts(I.incident_heads(members(spark, sf)))


# --- serving -----------------------------------------------------------------------------------


@query
def incidents_light(spark, sf):
    return serving.light(found(spark, sf).incidents)


@query
def incident_queue(spark, sf):
    return serving.queue(found(spark, sf).incidents)


@query
def incident_tags(spark, sf):
    heads = I.incident_heads(members(spark, sf))
    tags = serving.tags(F.col("root_service"), F.col("root_severity"))
    return heads.select("component_id", F.array_join(tags, ",").alias("tags"))


@query
def incident_explanation(spark, sf):
    scored = members(spark, sf)
    explained = serving.explanation(I.incident_heads(scored), I.member_services(scored))
    return explained.select("component_id", "explanation")


@query
def explanation_prompts(spark, sf):
    return serving.prompts(found(spark, sf).incidents)


def capped(spark, sf):
    both = found(spark, sf)
    return serving.capped_members(both.members, both.incidents), both.incidents


@query
def capped_members(spark, sf):
    return capped(spark, sf)[0].drop("component_id")


@query
def root_member_id(spark, sf):
    return serving.root_member_id(*capped(spark, sf))


@query
def incident_detail_timeline(spark, sf):
    return serving.detail_timeline(capped(spark, sf)[0])


@query
def reduction_metrics(spark, sf):
    return serving.reduction_metrics(I.incident_heads(members(spark, sf)))


# --- evaluation --------------------------------------------------------------------------------


def matched(spark, sf) -> DataFrame:
    both = found_segmented(spark, sf)
    # Both are read twice.
    cases = durable(both.incidents.join(I.member_services(both.members), "component_id"))
    return E.fault_match(durable(fx.faults(spark, sf)), cases)


@query
def fault_match(spark, sf):
    return matched(spark, sf).select(
        "fault_id",
        "ts",
        "cmdb_id",
        "level",
        "failure_type_en",
        "detected",
        "localized",
        "root_localized",
        "matched_incident",
        "matched_root_service",
        "matched_cluster_size",
    )


@query
def evaluation_metrics(spark, sf):
    return E.evaluation_metrics(matched(spark, sf))


@query
def eval_by_type(spark, sf):
    return E.breakdown(matched(spark, sf), "failure_type_en")


@query
def eval_by_level(spark, sf):
    return E.breakdown(matched(spark, sf), "level")


@query
def undetected_faults(spark, sf):
    return E.undetected(matched(spark, sf))


@query
def parameter_sweep(spark, sf):
    return correlation.parameter_sweep(
        fx.correlated_alerts(spark, sf), fx.vectors(spark, sf), fx.faults(spark, sf), SWEEP
    )


# --- streams, run over everything present ------------------------------------------------------


def stream(spark, sf) -> DataFrame:
    """The events, arriving in SLICES stretches of time, each a batch of its own."""
    events = fx.events(spark, sf)
    folder = feeds.in_slices(events, "ts", SLICES, feeds.scratch(spark, "arrivals"))
    events = feeds.file_stream(spark, folder, events, files_per_batch=feeds.SLICE_FILES)
    return fx.as_alerts(events, fx.vectors(spark, sf).count()).withColumn("event_time", F.col("ts").cast("timestamp"))


@query
def live_alert_rows(spark, sf):
    return feeds.append_all(serving.display_rows(stream(spark, sf)), feeds.scratch(spark, "rows"))


@query
def live_dedup(spark, sf):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    coarse = stream(spark, sf).withColumns({"ts": hour, "message": F.element_at(F.split("message", " "), 1)})
    once = feeds.without_copies(coarse.select("event_time", "ts", "service", "message"), delay="2 hours")
    return feeds.append_all(once.drop("event_time"), feeds.scratch(spark, "once"))


@query
def live_rates(spark, sf):
    return feeds.latest_all(feeds.rates(stream(spark, sf)), ["window_start", "window_end"], feeds.scratch(spark, "rates"))


@query
def live_sliding_rates(spark, sf):
    sliding = feeds.rates(stream(spark, sf), "60 minutes", "1 minute")
    return feeds.latest_all(sliding, ["window_start", "window_end"], feeds.scratch(spark, "sliding"))


@query
def live_densest_window(spark, sf):
    return live_densest(stream(spark, sf), feeds.scratch(spark, "densest"), 60, "hdfs")


def text_stream(spark, sf) -> DataFrame:
    return A.with_cleaned_message(A.severity_filter(stream(spark, sf)).drop("event_time", "vec_id"))


@query
def live_text_components(spark, sf):
    """Alerts correlated as they arrive, with vectors made from the templates that each batch brings."""
    live = LiveCorrelation(None, feeds.scratch(spark, "live-text"), TEXT_WINDOW, LIVE_THRESHOLD)
    live.run(text_stream(spark, sf))
    return live.components(spark)


@query
def live_components(spark, sf):
    live = LiveCorrelation(fx.vectors(spark, sf), feeds.scratch(spark, "live"), WINDOW, THRESHOLD)
    live.run(A.severity_filter(stream(spark, sf)).drop("event_time"))
    return live.components(spark)
