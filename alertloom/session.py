"""Session settings, durable lineage cuts and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: UTC arithmetic and adaptive, skew-splitting joins."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Top-k per group keeps k rows per group and task before its shuffle, up to this k.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's own, or a scratch one in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to storage shared by all executors")
    scratch = tempfile.mkdtemp(prefix="alertloom-")
    sc.setCheckpointDir(scratch)
    return scratch


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/alertloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what this application has stored below the shared folder; call it when the results are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, so that a lost executor can neither change nor undo what was
    computed, and gives later joins a real size to plan with. `release` empties the
    folder once the results built on it are stored.
    """
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
