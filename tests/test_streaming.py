import random
from collections import Counter
from datetime import UTC

from pyspark.sql import functions as F

from alertloom.operators import components as C, embedding, sampling
from alertloom.streaming import densest, feeds
from alertloom.streaming.live import LiveCorrelation
from helpers import SECOND, alert_rows, alerts_df, brute_edges, union_find, vector_rows, vectors_df


def in_files(spark, rows, folder, parts):
    """One file per slice of time, in that order."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    size = -(-len(rows) // parts)
    for n in range(parts):
        piece = alerts_df(spark, rows[n * size : (n + 1) * size])
        piece.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_live_correlation_equals_batch(spark, tmp_path):
    rows, vecs = alert_rows(11), vector_rows(11)
    folder = str(tmp_path / "in")
    like = in_files(spark, rows, folder, 5)
    stream = feeds.file_stream(spark, folder, like, files_per_batch=1)
    live = LiveCorrelation(vectors_df(spark, vecs), str(tmp_path / "live"), 60, 0.3, delay_sec=0)
    live.run(stream)
    got = {r.alert_id: r.component_id for r in live.components(spark).collect()}
    assert live.late(spark) == 0
    edges = [(a, b) for a, b, _, _ in brute_edges(rows, vecs, 60, 0.3)]
    assert got == union_find([r[0] for r in rows], edges)
    assert (tmp_path / "live" / "open" / "4").exists()


def test_late_alerts_are_counted_and_left_out(spark, tmp_path):
    rows = [(i, i * 100 * SECOND, "s-0", "WARN", "m", 0) for i in range(20)]
    folder = str(tmp_path / "in")
    alerts_df(spark, rows).coalesce(1).write.parquet(folder)
    late = [(100, 0, "s-0", "WARN", "m", 0), (101, 1850 * SECOND, "s-0", "WARN", "m", 0)]
    like = spark.read.parquet(folder)
    live = LiveCorrelation(vectors_df(spark, [(0, [1.0])]), str(tmp_path / "live"), 60, 0.5, delay_sec=120)
    live.run(feeds.file_stream(spark, folder, like, 1))
    alerts_df(spark, late).coalesce(1).write.mode("append").parquet(folder)
    live.run(feeds.file_stream(spark, folder, like, 1))
    got = {r.alert_id: r.component_id for r in live.components(spark).collect()}
    assert live.late(spark) == 1 and 100 not in got
    # 1850 s reaches both 1800 s and 1900 s.
    assert got[101] == got[18] == got[19] == 18 and got[17] == 17


def test_rerun_of_a_batch_changes_nothing(spark, tmp_path):
    rows, vecs = alert_rows(12), vector_rows(12)
    live = LiveCorrelation(vectors_df(spark, vecs), str(tmp_path / "live"), 60, 0.3)
    first = alerts_df(spark, rows[:60]), alerts_df(spark, rows[60:])
    live.batch(first[0], 0)
    live.batch(first[1], 1)
    before = sorted(live.components(spark).collect())
    live.batch(first[1], 1)
    assert sorted(live.components(spark).collect()) == before


def test_stream_dedup_and_rates_equal_batch(spark, tmp_path):
    # Spark's watermark starts at the epoch, so events lie after it.
    rows = [(i, (3600 + (i // 4) * 30) * SECOND, f"s-{i % 2}", "WARN", "m", 0) for i in range(200)]
    folder = str(tmp_path / "in")
    like = in_files(spark, rows, folder, 4)
    stream = feeds.file_stream(spark, folder, like, 1).withColumn("event_time", F.col("ts").cast("timestamp"))
    once = feeds.append_all(feeds.without_copies(stream).select("ts", "service", "message"), str(tmp_path / "once"))
    assert sorted(once.collect()) == sorted(like.select("ts", "service", "message").distinct().collect())
    counted = feeds.latest_all(feeds.rates(stream), ["window_start", "window_end"], str(tmp_path / "rates"))
    assert {r.n for r in counted.collect()} == {8} and counted.count() == 25
    sliding = feeds.latest_all(feeds.rates(stream, "5 minutes", "1 minute"), ["window_start", "window_end"], str(tmp_path / "sliding"))
    assert sliding.agg(F.sum("n")).first()[0] == 200 * 5


def texts_of(rows, seed):
    """Rows with messages whose words come up little by little."""
    rng = random.Random(seed)
    words = "disk full on node cannot reach peer timeout while reading block retry later leader lost".split()
    out = []
    for i, (alert, ts, service, severity, _, vec) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        out.append((alert, ts, service, severity, " ".join(rng.choice(words[: 3 + i // 10]) for _ in range(rng.randrange(0, 5))), vec))
    return out


def test_live_vectors_of_new_templates_equal_a_batch_with_those_vectors(spark, tmp_path):
    rows = texts_of(alert_rows(13), 13)
    folder = str(tmp_path / "in")
    like = in_files(spark, rows, folder, 5)
    live = LiveCorrelation(None, str(tmp_path / "live"), 60, 0.6, delay_sec=0)
    live.run(feeds.file_stream(spark, folder, like, files_per_batch=1).drop("vec_id"))
    got = {r.alert_id: r.component_id for r in live.components(spark).collect()}
    known = live.made.upto(spark, 5)
    assert known.count() == known.select("vec_id").distinct().count()
    assert {r.batch for r in known.collect()} == {0, 1, 2, 3, 4}
    tagged = embedding.tag_alerts(alerts_df(spark, rows).drop("vec_id"))
    batch = C.connected_components(tagged, known.select("vec_id", "embedding"), 60, 0.6)
    assert got == {r.alert_id: r.component_id for r in batch.collect()}
    # The first batch's vectors are those of a batch plan over its own texts; frequencies then go on counting.
    first = embedding.tag_alerts(alerts_df(spark, rows[:24]).drop("vec_id"))
    plain = {r.vec_id: r.embedding for r in embedding.text_vectors(first).collect()}
    assert plain == {r.vec_id: r.embedding for r in known.where("batch = 0").collect()}
    held = {r.dim: r.df for r in spark.read.parquet(str(tmp_path / "live" / "held" / "4")).collect()}
    whole = embedding.term_counts(tagged.select("vec_id", "tagged").distinct())
    assert held == {None: known.count()} | {r.dim: r["count"] for r in whole.groupBy("dim").count().collect()}


def test_rerun_of_a_batch_leaves_its_vectors(spark, tmp_path):
    rows = texts_of(alert_rows(14), 14)
    live = LiveCorrelation(None, str(tmp_path / "live"), 60, 0.6)
    first, second = (alerts_df(spark, part).drop("vec_id") for part in (rows[:60], rows[60:]))
    live.batch(first, 0)
    live.batch(second, 1)
    before = sorted(live.components(spark).collect()), sorted(live.made.upto(spark, 2).collect())
    live.batch(second, 1)
    assert (sorted(live.components(spark).collect()), sorted(live.made.upto(spark, 2).collect())) == before


def windows(times, width):
    minutes = Counter(t // (60 * SECOND) for t in times)
    total = {m: sum(minutes.get(m + k, 0) for k in range(width)) for m in minutes}
    return min(total.items(), key=lambda x: (-x[1], x[0]))


def test_densest_window_of_a_stream_after_each_batch(spark, tmp_path):
    rng = random.Random(6)
    times = sorted(rng.choice([rng.randrange(0, 40_000), rng.randrange(9_000, 9_600), 20_000]) * SECOND for _ in range(600))
    rows = [(i, t, "s-0", "WARN", "m", 0) for i, t in enumerate(times)]
    folder = str(tmp_path / "in")
    for width in (1, 7, 60):
        root = str(tmp_path / f"densest{width}")
        for n in range(4):
            alerts_df(spark, rows[n * 150 : (n + 1) * 150]).coalesce(1).write.mode("append").parquet(f"{folder}{width}")
            stream = feeds.file_stream(spark, f"{folder}{width}", alerts_df(spark, rows), 1)
            found = densest.live_densest_window(stream, root, width, None, delay="1 minute").collect()
            m, total = windows(times[: (n + 1) * 150], width)
            assert [(r.window_start.replace(tzinfo=UTC).timestamp(), r.alerts) for r in found] == [(m * 60, total)]
    batch = sampling.densest_window(alerts_df(spark, rows), 60, None).collect()
    assert batch == found


def test_densest_window_leaves_late_rows_out_and_lets_state_go(spark, tmp_path):
    rows = [(i, i * 600 * SECOND, "s-0", "WARN", "m", 0) for i in range(40)]
    folder, root = str(tmp_path / "in"), str(tmp_path / "densest")
    stream = lambda: feeds.file_stream(spark, folder, alerts_df(spark, rows), 1)
    for part in (rows[:20], rows[20:], [(100 + i, 60 * SECOND, "s-0", "WARN", "m", 0) for i in range(9)]):
        alerts_df(spark, part).coalesce(1).write.mode("append").parquet(folder)
        found = densest.live_densest_window(stream(), root, 10, None, delay="0 seconds").collect()
    assert [r.alerts for r in found] == [1]  # nine alerts came some six hours late
    # What is left of the state are the stretches that the watermark has not passed, the last ones of 40.
    state = spark.read.format("statestore").option("stateVarName", "counts").load(f"{root}/progress")
    assert 0 < state.count() <= 3


def test_densest_window_without_alerts(spark, tmp_path):
    folder = str(tmp_path / "in")
    alerts_df(spark, [(1, 60 * SECOND, "s-0", "WARN", "m", 0)]).coalesce(1).write.parquet(folder)
    stream = feeds.file_stream(spark, folder, spark.read.parquet(folder), 1)
    assert densest.live_densest_window(stream, str(tmp_path / "d"), 30, "no such source").collect() == []
