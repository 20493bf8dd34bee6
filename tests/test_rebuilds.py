"""Committed artifacts, sketches and dyadic intervals."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import alerts as A, evaluation as E
from alertloom.sources import sinks


def test_a_rerun_neither_doubles_nor_mixes(spark, tmp_path):
    root = str(tmp_path)
    first, second = spark.range(5), spark.range(100, 107)
    write = lambda df: {"rows": lambda path: df.write.parquet(path), "copy": lambda path: df.write.parquet(path)}

    def dies(path):
        raise OSError("disk full")

    with pytest.raises(OSError):
        sinks.commit(spark, root, "a", {**write(first), "last": dies})
    assert sinks.committed(spark, root, "a") is None  # half a run is no run
    sinks.commit(spark, root, "a", write(second))
    sinks.commit(spark, root, "a", write(first))  # committed already
    for name in ("rows", "copy"):
        got = spark.read.parquet(f"{sinks.committed(spark, root, 'a')}/{name}")
        assert sorted(r.id for r in got.collect()) == list(range(100, 107))
    assert sinks.committed(spark, root, "b") is None


def test_sketches_of_parts_merge_to_that_of_all(spark):
    rows = spark.range(0, 60_000, 1, 6).select(
        F.timestamp_seconds(F.col("id") % 90_000).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("service"),
        F.concat(F.lit("template "), F.col("id") % 20_000).alias("cleaned_message"),
    )
    parts = A.template_sketches(rows.where("id < 30000")).unionByName(A.template_sketches(rows.where("id >= 30000")))
    merged = A.sketched_templates(parts).first()
    assert merged.alerts == 60_000 and abs(merged.templates - 20_000) <= A.SKETCH_ERROR * 20_000
    whole = A.sketched_templates(A.template_sketches(rows)).first()  # merged in another order: another estimate
    assert whole.alerts == 60_000 and abs(whole.templates - merged.templates) <= A.SKETCH_ERROR * 20_000
    by = {r.service: r.templates for r in A.sketched_templates(parts, "service").collect()}
    exact = {r.service: r.n for r in rows.groupBy("service").agg(F.countDistinct("cleaned_message").alias("n")).collect()}
    assert all(abs(by[s] - n) <= A.SKETCH_ERROR * n for s, n in exact.items())
    assert A.sketched_templates(A.template_sketches(rows.limit(0))).first().templates == 0


def test_dyadic_buckets_make_up_the_interval(spark):
    rng = random.Random(1)
    pairs = [(0, 0), (1, 1), (-1, 0), (-9, -3), (5, 4 + 2**20), (0, 2**35)]
    pairs += [(a, a + rng.randrange(200)) for a in (rng.randrange(-300, 300) for _ in range(200))]
    df = spark.createDataFrame(pairs, "lo long, hi long")
    for r in df.select("lo", "hi", E.dyadic(F.col("lo"), F.col("hi")).alias("d")).collect():
        assert len(r.d) <= 2 * (r.hi - r.lo + 1).bit_length()
        spans = sorted((x.b << x.level, (x.b + 1) << x.level) for x in r.d)
        assert spans[0][0] == r.lo and spans[-1][1] == r.hi + 1
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
