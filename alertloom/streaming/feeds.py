"""Streams of alerts: the live list, duplicate removal, rates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.session import run_dir


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100, glob: str | None = None) -> DataFrame:
    """New parquet files of a folder, in the schema of `like`."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


#: Files of one slice, and so of one batch, in `in_slices`.
SLICE_FILES = 4


def in_slices(rows: DataFrame, ts: str, slices: int, folder: str) -> str:
    """Write rows as files that arrive slice by slice, in even stretches of `ts`; returns the folder."""
    at = F.col(ts).cast("timestamp").cast("double")
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    if lo is None:
        rows.write.parquet(folder)
        return folder
    number = F.least(F.floor((at - F.lit(lo)) * slices / F.lit(max(hi - lo, 1.0))), F.lit(slices - 1))
    for n in range(slices):
        rows.where(number == n).repartition(SLICE_FILES).write.mode("append").parquet(folder)
    return folder


def without_copies(alerts: DataFrame, key: Sequence[str] = ("ts", "service", "message"), delay: str = "10 minutes") -> DataFrame:
    """The first arrival of each key. State is kept for `delay` of event time; later copies count as late."""
    return alerts.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(key))


def rates(alerts: DataFrame, width: str = "1 minute", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Alerts per tumbling or, with `slide`, sliding window."""
    slot = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    counted = alerts.withWatermark("event_time", delay).groupBy(slot.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n",
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def append_all(stream: DataFrame, root: str) -> DataFrame:
    """Run the stream over all files present, into an exactly-once parquet sink, and read that."""
    run_to_end(
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/progress")
        .option("path", f"{root}/rows")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def latest_all(stream: DataFrame, key: Sequence[str], root: str) -> DataFrame:
    """Run an updating stream over all files present and read the last version of each key.

    A batch writes its own folder, so running it again after a failure replaces it.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/{number}")

    each_batch(stream, keep, root, "update")
    versions = stream.sparkSession.read.parquet(f"{root}/rows/*")
    values = [c for c in stream.columns if c not in key]
    last = versions.groupBy(*key).agg(F.max_by(F.struct(*values), "_batch").alias("_last"))
    return last.select(*key, "_last.*")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> None:
    run_to_end(
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{root}/progress")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
