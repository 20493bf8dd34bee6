"""Labelled faults from CSV rows and JSON objects of parallel arrays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom import schema
from alertloom.functions.time import epoch_seconds, whole_number

# English names of the failure types.
FAILURE_TYPES = {
    "k8s容器cpu负载": "k8s container CPU overload",
    "k8s容器内存负载": "k8s container memory overload",
    "k8s容器读io负载": "k8s container read I/O overload",
    "k8s容器写io负载": "k8s container write I/O overload",
    "k8s容器网络丢包": "k8s container network packet loss",
    "k8s容器网络延迟": "k8s container network latency",
    "k8s容器网络资源包损坏": "k8s container network packet corruption",
    "k8s容器网络资源包重复发送": "k8s container network packet retransmission",
    "k8s容器进程中止": "k8s container process killed",
    "node节点CPU故障": "node CPU fault",
    "node节点CPU爬升": "node CPU ramp-up",
    "node 内存消耗": "node memory exhaustion",
    "node 磁盘读IO消耗": "node disk read I/O exhaustion",
    "node 磁盘写IO消耗": "node disk write I/O exhaustion",
    "node 磁盘空间消耗": "node disk space exhaustion",
}

# Where the labels lie below the data root, in reading order.
CSV_FOLDERS = [
    "training_data_with_faults/training_data_with_faults_groundtruth",
    "training_data_with_faults/training_data_with_faults/groundtruth",
]
JSON_FOLDER = "初赛评分数据/groundtruth"


def translate_failure_type(rows: DataFrame) -> DataFrame:
    """Add `failure_type_en`; unknown types keep their name."""
    names = F.create_map(*[F.lit(x) for pair in FAILURE_TYPES.items() for x in pair])
    return rows.withColumn("failure_type_en", F.coalesce(F.try_element_at(names, F.col("failure_type")), "failure_type"))


def explode_arrays(objects: DataFrame) -> DataFrame:
    """One row per position of the four parallel arrays of each object."""
    rest = [c for c in objects.columns if c not in schema.FAULT_FIELDS]
    zipped = F.arrays_zip(*schema.FAULT_FIELDS)
    return objects.select(*rest, F.posexplode(zipped).alias("_at", "_row")).select(
        *rest, "_at", *[F.col(f"_row.{c}").alias(c) for c in schema.FAULT_FIELDS]
    )


def merge_faults(*parts: DataFrame) -> DataFrame:
    """Union of the parts without repeated (time, id, type); the first by `input_order` stays."""
    key = ["timestamp_epoch", "cmdb_id", "failure_type"]
    kept = ["level", "source_file"]
    rows = None
    for part in parts:
        part = part.withColumn("timestamp_epoch", whole_number(F.col("timestamp"))).select(*key, *kept, "input_order")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*kept), F.col("input_order")).alias("_first"))
    named = translate_failure_type(first.select(*key, "_first.*"))
    return named.withColumn("ts", epoch_seconds(F.col("timestamp_epoch").cast("string"))).select(
        "ts", "timestamp_epoch", "level", "cmdb_id", "failure_type", "failure_type_en", "source_file"
    )


def _ordered(rows: DataFrame, folder: int, *position) -> DataFrame:
    path = F.col("_metadata.file_path")
    name = F.url_decode(F.element_at(F.split(path, "/"), -1))
    return rows.withColumn("source_file", name).withColumn(
        "input_order", F.struct(F.lit(folder).alias("folder"), name.alias("file"), *position)
    )


def load_faults(spark: SparkSession, root: str) -> DataFrame | None:
    """All labels below the data root, in time order."""
    parts = []
    for i, folder in enumerate(CSV_FOLDERS):
        rows = _read(spark.read.schema(schema.FAULT_CSV_SCHEMA).option("header", True).csv, f"{root}/{folder}/*.csv")
        if rows is not None:
            parts.append(_ordered(rows, i, F.monotonically_increasing_id().alias("at")))
    objects = _read(
        spark.read.schema(schema.FAULT_JSON_SCHEMA).option("multiLine", True).option("primitivesAsString", True).json,
        f"{root}/{JSON_FOLDER}/*.json",
    )
    if objects is not None:
        tagged = explode_arrays(_ordered(objects, len(CSV_FOLDERS)))
        order = F.struct("input_order.folder", "input_order.file", F.col("_at").cast("long").alias("at"))
        parts.append(tagged.withColumn("input_order", order))
    return merge_faults(*parts).orderBy("timestamp_epoch") if parts else None


def _read(reader, path: str) -> DataFrame | None:
    try:
        return reader(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
