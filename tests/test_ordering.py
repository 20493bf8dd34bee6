import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators.ordering import position, running_sum
from alertloom.operators import alerts as A, sampling


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", rng.randrange(50), i, rng.randrange(5)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, i int, v int")


def test_running_sum_splits_hot_groups(spark):
    rows, df = skewed(spark)
    got = {r.i: r.s for r in running_sum(df, ["k"], ["t", "i"], F.col("v"), "s").collect()}
    totals, expected = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        totals[k] = totals.get(k, 0) + v
        expected[i] = totals[k]
    assert got == expected


def test_position_is_dense_and_global(spark):
    rows, df = skewed(spark)
    got = {r.i: r.idx for r in position(df, ["t", "i"]).collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


@pytest.mark.parametrize("n,k", [(100, 7), (100, 99), (97, 33), (10, 10), (5, 9), (1000, 333)])
def test_even_sample(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("alert_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    got = sorted(r.alert_id for r in sampling.even_sample(df, k).collect())
    assert got == (list(range(n)) if n <= k else [int(i * (n / k)) for i in range(k)])


def test_replay_pages_cover_the_sample_once(spark):
    df = spark.range(1000).select(
        F.col("id").alias("alert_id"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"),
        *[F.lit("x").alias(c) for c in ("severity", "service", "message")],
    )
    replay = sampling.replay_sample(df, target=300).cache()
    assert [r.ts.second for r in replay.orderBy("row").limit(3).collect()] == [0, 3, 6]
    cursor, seen = 0, []
    while True:
        page = sampling.replay_page(replay, cursor, 120).orderBy("row").collect()
        seen += [r.id for r in page]
        assert {r.total for r in page} == {334}
        cursor = page[-1].next_cursor
        if cursor == 0:
            break
    assert seen == [f"s{i}" for i in range(334)]


def test_dedup_keeps_first_of_hot_key(spark):
    rows = [(i, "2024-01-01 00:00:00" if i % 3 else f"2024-01-01 00:00:{i % 60:02d}", f"s{i % 2}", "m") for i in range(900)]
    df = spark.createDataFrame(rows, "alert_id long, ts string, service string, message string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for dedup, key in ((A.dedup_log_alerts, (1, 3)), (A.dedup_aiops_alerts, (1, 2, 3))):
        first = {}
        for r in rows:
            first.setdefault(tuple(r[c] for c in key), r[0])
        assert sorted(r.alert_id for r in dedup(df).collect()) == sorted(first.values())


def test_densest_window_prefers_the_earliest(spark):
    minutes = [0, 1, 1, 40, 41, 41, 100, 129, 130]
    rows = [(i, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:30", "hdfs") for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "alert_id int, t string, source string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    best = sampling.densest_window(df, 30).first()
    assert (best.window_start.minute, best.window_end.minute, best.alerts) == (0, 30, 3)
    # [1, 42) holds minutes 1, 1, 40, 41, 41.
    assert sampling.densest_window(df, 41).first().alerts == 5
    assert sampling.densest_window(df, 30, "none").count() == 0


def test_stratified_sample_quota(spark):
    rows = [(i, "hdfs", f"t{0 if i < 80 else i}", i) for i in range(100)] + [(1000 + i, "spark", "z", i) for i in range(10)]
    df = spark.createDataFrame(rows, "alert_id long, source string, cleaned_message string, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    window = spark.range(1).select(
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("window_start"),
        F.lit("1970-01-01 00:10:00").cast("timestamp_ntz").alias("window_end"),
    )
    got = [r.alert_id for r in sampling.stratified_sample(df, window, target=60).collect()]
    # 50 left after the 10 whole ones: int(0.8 * 50) of the big template, one of each single one.
    assert sorted(got) == [*range(40), *range(80, 100), *range(1000, 1010)]
