"""Densest window and the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from alertloom import schema
from alertloom.functions.time import from_micros, micros
from alertloom.operators.alerts import per_minute
from alertloom.operators.ordering import position, ranked

MINUTE_US = 60_000_000


def densest_window(alerts: DataFrame, window_minutes: int = 30, source: str | None = "hdfs") -> DataFrame:
    """The [start, start + window) with most alerts; the earliest one on a tie.

    Alerts shrink to minute counts first. Each minute is then copied into its own
    stretch of `window_minutes` and the one before, so every start finds its whole
    window inside one stretch and no task sees more than two stretches. A window's
    total is the running count at its end less the one before its start.
    """
    minutes = per_minute(alerts, source).select(
        F.call_function("div", micros(F.col("minute")), F.lit(MINUTE_US)).alias("m"), "n"
    )
    own = F.floor(F.col("m") / window_minutes)
    marks = F.array(
        F.struct(own.alias("stretch"), F.col("m").alias("at"), F.lit(0).alias("kind"), F.col("n").alias("add")),
        F.struct((own - 1).alias("stretch"), F.col("m").alias("at"), F.lit(2).alias("kind"), F.col("n").alias("add")),
        F.struct(
            own.alias("stretch"),
            (F.col("m") + (window_minutes - 1)).alias("at"),
            F.lit(3).alias("kind"),
            F.lit(0).cast("long").alias("add"),
        ),
    )
    # kind: 0 = a start, 2 = a minute of the next stretch, 3 = the end of a window.
    along = W.partitionBy("stretch").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    running = minutes.select("m", F.inline(marks)).withColumn("upto", F.sum("add").over(along))
    before_start = F.when(F.col("kind") == 0, F.col("add") - F.col("upto"))
    best = (
        running.where("kind != 2")
        .groupBy("m")
        .agg(F.sum(F.coalesce(before_start, F.col("upto"))).alias("alerts"))
        .orderBy(F.desc("alerts"), "m")
        .limit(1)
    )
    return best.select(
        from_micros(F.col("m") * MINUTE_US).alias("window_start"),
        from_micros((F.col("m") + window_minutes) * MINUTE_US).alias("window_end"),
        "alerts",
    )


def stratified_sample(
    cleaned: DataFrame,
    window: DataFrame,
    target: int = schema.SAMPLE_TARGET,
    whole: str = "spark",
    sampled: str = "hdfs",
) -> DataFrame:
    """Every alert of one source, plus each template's share of the other inside `window`."""
    kept = cleaned.where(F.col("source") == whole)
    budget = F.greatest(F.lit(target) - kept.agg(F.count("*")).scalar(), F.lit(0))
    inside = cleaned.where(
        (F.col("source") == sampled)
        & (F.col("ts") >= window.select("window_start").scalar())
        & (F.col("ts") < window.select("window_end").scalar())
    )
    sizes = inside.groupBy("cleaned_message").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    share = F.floor(F.col("_n") / total * budget)
    quotas = sizes.select(
        "cleaned_message", F.least(F.col("_n"), F.greatest(F.lit(1), share)).alias("_quota")
    )
    # Templates are texts: they are ranked by their hashes.
    key = F.md5("cleaned_message")
    narrow = inside.select("ts", "alert_id", key.alias("_template"))
    picked = (
        position(narrow, ["ts", "alert_id"], "_pos", group=["_template"])
        .join(quotas.select(key.alias("_template"), "_quota"), "_template")
        .where(F.col("_pos") < F.col("_quota"))
    )
    picked = inside.join(picked.select("ts", "alert_id"), ["ts", "alert_id"], "left_semi")
    return kept.unionByName(picked.select(*kept.columns))


def even_sample(alerts: DataFrame, k: int) -> DataFrame:
    """Rows floor(i * n / k) for i < k of the time-ordered table; all rows when n <= k."""
    total = alerts.agg(F.count("*")).scalar()
    step = total.cast("double") / F.lit(float(k))
    near = F.floor(F.col("idx") / step)

    def is_row(i):
        return (i < k) & (F.floor(i.cast("double") * step) == F.col("idx"))

    return ranked(alerts, ["ts", "alert_id"], keep=(total <= k) | is_row(near) | is_row(near + 1))


def replay_sample(alerts: DataFrame, target: int = schema.REPLAY_TARGET) -> DataFrame:
    """Every n-th alert in time order, numbered densely for the replay feed."""
    step = F.greatest(F.lit(1), F.floor(alerts.agg(F.count("*")).scalar() / target))
    kept = ranked(alerts, ["ts", "alert_id"], keep=F.col("idx") % step == 0).withColumn("_step", step)
    row = F.call_function("div", F.col("idx"), F.col("_step"))
    return kept.select(
        row.alias("row"),
        F.concat(F.lit("s"), row.cast("string")).alias("id"),
        "ts",
        "severity",
        "service",
        F.substring("message", 1, 200).alias("message"),
    )


def replay_envelope(replay: DataFrame, cursor: int = 0, limit: int = 50) -> DataFrame:
    """One row: the page's `items` (at most `limit`), `next_cursor` (0 after the end) and `total`, for any cursor."""
    cursor = max(0, cursor)
    item = F.struct("row", "id", "ts", "severity", "service", "message")
    inside = (F.col("row") >= cursor) & (F.col("row") < cursor + limit)
    end = F.lit(cursor + limit).cast("long")
    return replay.agg(
        F.array_sort(F.collect_list(F.when(inside, item))).alias("items"), F.count("*").alias("total")
    ).withColumn("next_cursor", F.when(end < F.col("total"), end).otherwise(F.lit(0).cast("long")))


def replay_page(replay: DataFrame, cursor: int = 0, limit: int = 50) -> DataFrame:
    """Rows [cursor, cursor + limit) with the next cursor (0 after the end) and the total."""
    cursor = max(0, cursor)
    total = replay.agg(F.count("*")).scalar()
    end = F.least(F.lit(cursor + limit).cast("long"), F.greatest(total, F.lit(cursor)))
    return replay.where((F.col("row") >= cursor) & (F.col("row") < cursor + limit)).withColumns(
        {"next_cursor": F.when(end < total, end).otherwise(F.lit(0)), "total": total}
    )
