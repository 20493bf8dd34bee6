"""Scoring incidents against labelled faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import schema
from alertloom.functions.text import base_service
from alertloom.functions.time import bucket, long_lit
from alertloom.operators.linking import window_micros

# Added to the distance (in half microseconds) of an incident that lacks the faulted service.
STRANGER_PENALTY = 2 * 100_000 * 1_000_000


def _mentions(service: Column, cmdb: Column) -> Column:
    """The service name holds the faulted id or its base; an id always holds its base."""
    return F.contains(service, base_service(cmdb))


#: Levels of dyadic buckets; base buckets are a second or more, so 2^36 of them are some 2,000 years.
LEVELS = 36


def dyadic(lo: Column, hi: Column) -> Column:
    """[(level, b)]: the fewest aligned buckets [b * 2^level, (b + 1) * 2^level) that make up base buckets lo to hi.

    From level 0 up, an odd left end and an even right end are buckets of their own; what is between goes on at half
    the resolution.
    """
    start = F.struct(lo.alias("lo"), hi.alias("hi"), F.expr("cast(array() as array<struct<level:int,b:bigint>>)").alias("out"))

    def level(s: Column, k: Column) -> Column:
        low, high = s["lo"], s["hi"]
        none = F.expr("cast(array() as array<struct<level:int,b:bigint>>)")
        one = lambda b: F.array(F.struct(k.cast("int").alias("level"), b.alias("b")))
        odd = (low <= high) & (low.bitwiseAND(F.lit(1)) == 1)
        even = (low <= high) & (high.bitwiseAND(F.lit(1)) == 0) & ~((low == high) & odd)
        found = F.concat(s["out"], F.when(odd, one(low)).otherwise(none), F.when(even, one(high)).otherwise(none))
        next_lo = F.call_function("shiftright", low + F.when(odd, 1).otherwise(0), F.lit(1))
        next_hi = F.call_function("shiftright", high - F.when(even, 1).otherwise(0), F.lit(1))
        over = low > high
        return F.struct(F.when(over, low).otherwise(next_lo).alias("lo"), F.when(over, high).otherwise(next_hi).alias("hi"), found.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, level, lambda s: s["out"])


def fault_match(
    faults: DataFrame,
    incidents: DataFrame,
    tolerance_sec: float = schema.FAULT_TOLERANCE_SEC,
    by: Sequence[str] = (),
) -> DataFrame:
    """Each fault with its best incident in time, or none.

    `faults`: fault_id, ts_us, cmdb_id and descriptive columns. `incidents`:
    incident_no, incident_id, start_us, end_us, root_service, services, member_count.
    `by` names columns of both that have to be equal.

    The base buckets with faults look in one time bucket of every level, where a bucket of
    level k is 2^k base buckets wide; there are as many of them as time has buckets,
    however many faults. An incident stands in the fewest aligned buckets that make
    up its widened interval, at most two a level (`dyadic`): a chronic incident of
    thousands of base buckets is a few dozen rows. So that join is an equality on
    (level, bucket). Faults then meet the incidents of their base bucket, each pair once,
    and travel once. The best incident is an aggregate, taken in the same tasks that find
    the candidates. `faults` are read three times.
    """
    slack = window_micros(tolerance_sec)
    width = long_lit(max(2 * slack, 1_000_000))
    covering = incidents.select(*by, "incident_no", "start_us", "end_us", "services").withColumns(
        {"_lo": bucket(F.col("start_us") - slack, width), "_hi": bucket(F.col("end_us") + slack, width)}
    )
    covering = covering.select("*", F.inline(dyadic(F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")
    at = faults.select(*by, "fault_id", "ts_us", "cmdb_id").withColumn("_b", bucket(F.col("ts_us"), width))
    held = at.select(*by, "_b").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    standing = held.withColumn("b", F.expr("shiftright(_b, level)")).join(covering, [*by, "level", "b"]).drop("level", "b")
    twice_off = F.abs(2 * F.col("ts_us") - F.col("start_us") - F.col("end_us"))
    near = (F.col("ts_us") >= F.col("start_us") - slack) & (F.col("ts_us") <= F.col("end_us") + slack)
    best = (
        at.join(standing, [*by, "_b"])
        .where(near)
        .withColumn("hit", F.exists("services", lambda s: _mentions(s, F.col("cmdb_id"))))
        .withColumn("off", F.when(F.col("hit"), twice_off).otherwise(twice_off + STRANGER_PENALTY))
        .groupBy(*by, "fault_id")
        .agg(F.min(F.struct("off", "incident_no", "hit")).alias("best"))
        .select(*by, "fault_id", F.col("best.incident_no").alias("incident_no"), F.col("best.hit").alias("_hit"))
    )
    named = incidents.select("incident_no", "incident_id", "root_service", "member_count")
    found = best.join(named, "incident_no")
    return faults.join(found, [*by, "fault_id"], "left").withColumns(
        {
            "detected": F.col("incident_no").isNotNull(),
            "localized": F.coalesce("_hit", F.lit(False)),
            "root_localized": F.coalesce(_mentions(F.col("root_service"), F.col("cmdb_id")), F.lit(False)),
        }
    ).drop("_hit", "incident_no").withColumnsRenamed(
        {
            "incident_id": "matched_incident",
            "root_service": "matched_root_service",
            "member_count": "matched_cluster_size",
        }
    )


def counters() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if("detected").alias("detected"),
        F.count_if(F.col("detected") & F.col("localized")).alias("service_matched_detected"),
        F.count_if("localized").alias("localized"),
        F.count_if("root_localized").alias("root_localized"),
    ]


def percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.col(part) / F.col(whole), 1))


def evaluation_metrics(matched: DataFrame) -> DataFrame:
    """Detection rates are over all faults, localization and root cause over the detected ones."""
    return matched.agg(*counters()).select(
        F.col("total").alias("total_faults"),
        "detected",
        "service_matched_detected",
        "localized",
        "root_localized",
        percent("detected", "total").alias("detection_rate"),
        percent("service_matched_detected", "total").alias("detection_rate_service_matched"),
        percent("localized", "detected").alias("localization_rate"),
        percent("root_localized", "detected").alias("root_cause_accuracy"),
    )


def breakdown(matched: DataFrame, by: str) -> DataFrame:
    """The same counters per failure type or level."""
    return matched.groupBy(by).agg(*counters()).orderBy(F.desc("total"), by)


def undetected(matched: DataFrame, k: int = 10) -> DataFrame:
    missed = matched.where(~F.col("detected"))
    return missed.orderBy("ts_us", "fault_id").limit(k).select("fault_id", "ts", "cmdb_id", "failure_type_en")


def fault_counts(faults: DataFrame, k: int = 8) -> DataFrame:
    """Faults by level, and the k most frequent failure types."""
    levels = faults.groupBy(F.col("level").alias("value")).agg(F.count("*").alias("n"))
    types = faults.groupBy(F.col("failure_type_en").alias("value")).agg(F.count("*").alias("n"))
    top = types.orderBy(F.desc("n"), "value").limit(k)
    return levels.select(F.lit("level").alias("dimension"), "value", "n").unionByName(
        top.select(F.lit("failure_type").alias("dimension"), "value", "n")
    )
