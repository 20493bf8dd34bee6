"""Cut components in time, so that a chronic error stream does not become one incident.

Gap: a component splits where neighbouring members are more than `max_gap` apart.
Span: a segment ends where the next alert would make it last longer than
`max_span`, and that alert begins the next one. Taken literally this is one
ordered pass over a component. Here every alert time points to the first one that
its own segment would not hold, and pointers are doubled: after k rounds the first
2^k segments of every piece have their begins, and pointers skip 2^k segments. A
round is an equality join, so a long component is spread over tasks, and it takes
as many rounds as the logarithm of its segments. Pieces within the bound take none.

Gaps are found on (component, bucket) cells, at most (time range / max_gap) per
component; alerts only look their cell up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from alertloom import schema
from alertloom.functions.time import bucket, long_lit
from alertloom.operators.linking import window_micros
from alertloom.operators.ordering import running_sum
from alertloom.session import durable


def gap_segments(labelled: DataFrame, max_gap_sec: float = schema.MAX_GAP_SEC) -> DataFrame:
    """Add `gap_no` (from 0) and `gap_start_us`, the piece of the component the alert is in."""
    gap = window_micros(max_gap_sec)
    bucketed = labelled.withColumn("_cell", bucket(F.col("ts_us"), long_lit(gap)))
    along = W.partitionBy("component_id").orderBy("_cell")
    cells = (
        bucketed.groupBy("component_id", "_cell")
        .agg(F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"))
        .withColumn("_before", F.lag("_last").over(along))
        .withColumn("_cut", F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap))
    )
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    pieces = cells.select(
        "component_id",
        "_cell",
        (F.sum(F.col("_cut").cast("long")).over(upto) - 1).alias("gap_no"),
        F.max(F.when(F.col("_cut"), F.col("_first"))).over(upto).alias("gap_start_us"),
    )
    return bucketed.join(pieces, ["component_id", "_cell"]).drop("_cell")


PIECE = ["component_id", "gap_no"]


def segment_begins(times: DataFrame, span_us: int) -> DataFrame:
    """(component_id, gap_no, ts_us, pos, begins): distinct alert times of a piece, and whether a segment begins there."""
    marks = F.array(
        F.struct(F.col("ts_us").alias("at"), F.lit(0).alias("kind")),
        F.struct((F.col("ts_us") + span_us).alias("at"), F.lit(1).alias("kind")),
    )
    marked = times.select(*PIECE, "ts_us", F.inline(marks))
    # kind: 0 = a time, 1 = "how many times up to the end of my segment".
    counted = running_sum(marked, PIECE, ["at", "kind", "ts_us"], F.when(F.col("kind") == 0, 1).otherwise(0), "upto")
    upto = [F.max(F.when(F.col("kind") == k, F.col("upto"))) for k in (0, 1)]
    placed = durable(counted.groupBy(*PIECE, "ts_us").agg(upto[0].alias("pos"), (upto[1] + 1).alias("next")))
    sizes = placed.groupBy(*PIECE).agg(F.max("pos").alias("_n"))
    jumps = durable(placed.join(sizes, PIECE).where(F.col("next") <= F.col("_n")).select(*PIECE, "pos", "next"))
    begins = sizes.select(*PIECE, F.lit(1).cast("long").alias("pos"))
    while True:
        found = durable(begins.join(jumps, [*PIECE, "pos"]).select(*PIECE, F.col("next").alias("pos")))
        if found.isEmpty():
            break
        begins = begins.unionByName(found)
        beyond = jumps.select(*PIECE, F.col("pos").alias("next"), F.col("next").alias("_next"))
        jumps = durable(jumps.join(beyond, [*PIECE, "next"]).select(*PIECE, "pos", F.col("_next").alias("next")))
    marked = placed.select(*PIECE, "ts_us", "pos").join(begins.withColumn("begins", F.lit(1)), [*PIECE, "pos"], "left")
    return marked.withColumn("begins", F.coalesce("begins", F.lit(0)))


def span_segments(
    labelled: DataFrame,
    max_gap_sec: float = schema.MAX_GAP_SEC,
    max_span_sec: float = schema.MAX_SPAN_SEC,
) -> DataFrame:
    """Add `gap_no`, `gap_start_us` and `span_no` (from 0 in each piece)."""
    span = window_micros(max_span_sec)
    gapped = durable(gap_segments(labelled, max_gap_sec))
    long = gapped.groupBy(*PIECE).agg((F.max("ts_us") - F.min("ts_us")).alias("_lasts")).where(F.col("_lasts") > span)
    times = durable(gapped.join(long.select(*PIECE), PIECE, "left_semi").select(*PIECE, "ts_us").distinct())
    none = F.lit(0).cast("long")
    if times.isEmpty():
        return gapped.withColumn("span_no", none)
    numbered = running_sum(segment_begins(times, span), PIECE, ["ts_us"], F.col("begins"), "span_no")
    numbers = numbered.select(*PIECE, "ts_us", (F.col("span_no") - 1).alias("span_no"))
    found = gapped.join(numbers, [*PIECE, "ts_us"], "left")
    return found.select(*gapped.columns, F.coalesce("span_no", none).alias("span_no"))


def segmented(labelled: DataFrame, max_gap_sec: float, max_span_sec: float) -> DataFrame:
    """Labelled alerts whose `component_id` is replaced by their segment's smallest alert id."""
    keys = ["component_id", "gap_no", "span_no"]
    cut = span_segments(labelled, max_gap_sec, max_span_sec)
    firsts = cut.groupBy(*keys).agg(F.min("alert_id").alias("_segment"))
    return (
        cut.join(firsts, keys)
        .withColumn("component_id", F.col("_segment"))
        .drop("_segment", "gap_no", "span_no", "gap_start_us")
    )
