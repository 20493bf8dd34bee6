"""The densest window of a stream of alerts, kept up to date by a stateful operator.

Time is cut into stretches as wide as the window. A window that starts in a stretch ends in that one or the next, so a
stretch needs the minute counts of two stretches and nothing else: its state is one row of 2 * width counts, and stretches
are spread over tasks. Alerts shrink to minute counts inside each Arrow batch, before they are shuffled, so a minute with
a third of all alerts costs a few rows a task. Every batch emits the best window of each stretch it touched; the best of
those is the densest window so far, and after the last batch the one that the batch plan finds.

A stretch's state goes when the watermark (the newest minute less `delay`) passes the end of the next stretch. Alerts of
minutes up to the watermark are late: Spark leaves them out before they reach the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from alertloom.functions.time import from_micros, micros
from alertloom.streaming.feeds import latest_all

MINUTE_US = 60_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by("m").aggregate([("m", "count")])
        yield pa.RecordBatch.from_arrays([found["m"].combine_chunks(), pc.cast(found["m_count"].combine_chunks(), pa.int64())], names=["m", "n"])


def _processor(width: int):
    """Made inside a function, so that executors need not have this package installed."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Stretch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.counts = handle.getValueState("counts", "n array<long>")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            (stretch,) = key
            if self.counts.exists():
                counts = np.array(self.counts.get()[0], np.int64)
            else:
                counts = np.zeros(2 * width, np.int64)
                self.handle.registerTimer((int(stretch) + 2) * width * 60_000)
            for frame in rows:
                np.add.at(counts, frame["m"].to_numpy() - stretch * width, frame["n"].to_numpy())
            self.counts.update((counts.tolist(),))
            upto = np.concatenate([[0], np.cumsum(counts)])
            # Windows start at minutes with alerts; the earliest of equal ones.
            total = np.where(counts[:width] > 0, upto[width : 2 * width] - upto[:width], 0)
            at = int(total.argmax())
            if total[at]:
                yield pd.DataFrame({"stretch": [stretch], "m": [stretch * width + at], "n": [total[at]]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            self.counts.clear()
            yield from ()

        def close(self) -> None:
            pass

    return Stretch()


def stretch_windows(alerts: DataFrame, window_minutes: int, source: str | None = "hdfs", delay: str = "10 minutes") -> DataFrame:
    """(stretch, m, n), updating: the best window [m, m + window_minutes) that starts in each stretch. Needs `ts`.

    Rows without a time are left out. The session's state store must be RocksDB (STATE_STORE).
    """
    kept = alerts if source is None else alerts.where(F.col("source") == source)
    minute = F.call_function("div", micros(F.col("ts")), F.lit(MINUTE_US))
    # Times before 1970 divide towards zero.
    minute = minute - F.when((micros(F.col("ts")) < 0) & (micros(F.col("ts")) % MINUTE_US != 0), 1).otherwise(0)
    counted = kept.where("ts IS NOT NULL").select(minute.alias("m")).mapInArrow(_counted, "m long, n long")
    timed = counted.withColumn("at", F.timestamp_seconds(F.col("m") * 60)).withWatermark("at", delay)
    own = F.floor(F.col("m") / window_minutes)
    placed = timed.select("m", "n", "at", F.explode(F.array(own, own - 1)).alias("stretch"))
    return placed.groupBy("stretch").transformWithStateInPandas(
        _processor(window_minutes), "stretch long, m long, n long", "update", "eventTime"
    )


def live_densest_window(alerts: DataFrame, root: str, window_minutes: int = 30, source: str | None = "hdfs", delay: str = "10 minutes") -> DataFrame:
    """Run the stream over all data present; one row as `sampling.densest_window` gives it, none without alerts."""
    spark = alerts.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        best = latest_all(stretch_windows(alerts, window_minutes, source, delay), ["stretch"], root)
    finally:
        spark.conf.set(name, before)
    top = best.orderBy(F.desc("n"), "m").limit(1)
    return top.select(
        from_micros(F.col("m") * MINUTE_US).alias("window_start"),
        from_micros((F.col("m") + window_minutes) * MINUTE_US).alias("window_end"),
        F.col("n").alias("alerts"),
    )
