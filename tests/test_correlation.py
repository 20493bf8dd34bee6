import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators import components as C, embedding, evaluation, forest, incidents as I, linking, segments
from alertloom.plans import correlation
from helpers import SECOND, alert_rows, alerts_df, brute_edges, similarity, union_find, vector_rows, vectors_df

CASES = [(seed, window, threshold) for seed, window, threshold in ((1, 60, 0.3), (2, 240, 0.75), (3, 30, 0.05), (4, 120, 1.0))]


def tables(spark, seed):
    rows, vecs = alert_rows(seed), vector_rows(seed)
    return rows, vecs, alerts_df(spark, rows), vectors_df(spark, vecs)


def unpack(rows, packed):
    """All pairs behind the packed edges, by their definition."""
    by_vec = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by_vec.setdefault(r[5], []).append(r[0])
    for e in packed:
        ids = by_vec[e.vec_b]
        lo, hi = ids.index(e.first_dst), ids.index(e.last_dst)
        assert hi - lo + 1 == e.n_links
        yield from ((e.src, d) for d in ids[lo : hi + 1])


@pytest.mark.parametrize("seed,window,threshold", CASES)
def test_packed_edges_equal_all_pairs(spark, seed, window, threshold):
    rows, vecs, alerts, vectors = tables(spark, seed)
    packed = linking.similarity_edges(alerts, vectors, window, threshold).collect()
    assert sorted(unpack(rows, packed)) == sorted((a, b) for a, b, _, _ in brute_edges(rows, vecs, window, threshold))


@pytest.mark.parametrize("seed,window,threshold", CASES)
def test_components_equal_union_find(spark, seed, window, threshold):
    rows, vecs, alerts, vectors = tables(spark, seed)
    got = {r.alert_id: r.component_id for r in C.connected_components(alerts, vectors, window, threshold).collect()}
    edges = [(a, b) for a, b, _, _ in brute_edges(rows, vecs, window, threshold)]
    assert got == union_find([r[0] for r in rows], edges)


@pytest.mark.parametrize("seed", [5, 6])
def test_cross_service_threshold(spark, seed):
    rows, vecs, alerts, vectors = tables(spark, seed)
    expected = brute_edges(rows, vecs, 60, 0.1, cross=0.6)
    got = {r.alert_id: r.component_id for r in C.connected_components(alerts, vectors, 60, 0.1, 0.6).collect()}
    assert got == union_find([r[0] for r in rows], [(a, b) for a, b, _, _ in expected])
    counts = linking.cross_service_edges(alerts, vectors, 60, 0.1, 0.6).agg(F.sum("n_links")).first()[0]
    assert counts == len(expected)


def test_blocks_split_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 7)
    rng = np.random.default_rng(0)
    vecs = [(v, [float(x) for x in rng.normal(size=3)]) for v in range(60)]
    rows = [(i, i * SECOND, "s-1", "WARN", "m", i) for i in range(60)]
    alerts, vectors = alerts_df(spark, rows), vectors_df(spark, vecs)
    got = {r.alert_id: r.component_id for r in C.connected_components(alerts, vectors, 5, 0.9).collect()}
    assert got == union_find(range(60), [(a, b) for a, b, _, _ in brute_edges(rows, vecs, 5, 0.9)])


def test_connected_cells_are_not_compared_again():
    """One dense group and 15 others: comparisons follow the cells, not their square."""
    rng = np.random.default_rng(1)
    n, made = 6000, []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            made.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    axis = np.eye(16)[np.where(np.arange(n) < 60, np.arange(n) % 16, 0)]
    rows = {
        "embedding": np.array([*(axis + rng.normal(scale=0.05, size=(n, 16)))] + [None], dtype=object)[:-1],
        "vec_id": np.arange(n), "node": np.arange(n), "block": np.zeros(n, int), "ahead": (np.arange(n) >= n // 2).astype(int),
        "i": np.zeros(n, int), "j": np.zeros(n, int), "first_us": np.zeros(n, int), "last_us": np.zeros(n, int),
        "window_us": np.full(n, 10), "min_sims": np.array([[0.5, 0.8]] * n),
    }
    units = linking._units
    linking._units = lambda: lambda v: units()(v).view(Counted)
    try:
        found = [np.concatenate(c) for c in zip(*linking._forest_edges()(rows), strict=True)]
    finally:
        linking._units = units
    assert len(found[0]) == n - 16 and set(found[2]) == {0.8}
    assert (axis[found[0]] == axis[found[1]]).all() and sum(made) < 0.05 * n * n


def block_rows(vecs, n_left, **more):
    """Rows of one pair of blocks: the first n_left cells are of a bucket, the rest of the next one."""
    n = len(vecs)
    cells = {
        "embedding": np.array([*np.asarray(vecs, float), None], dtype=object)[:-1], "vec_id": np.arange(n), "node": np.arange(n),
        "block": np.zeros(n, int), "ahead": (np.arange(n) >= n_left).astype(int), "i": np.zeros(n, int), "j": np.zeros(n, int),
        "first_us": np.zeros(n, int), "last_us": np.zeros(n, int), "window_us": np.full(n, 10), "anchor": np.zeros(n, int),
    }
    return cells | more


def test_components_of_blocks_are_stars():
    """A level hangs what was a component at the level before on the smallest node."""
    turn = np.repeat([0.0, 2.0, 2.3, 4.0], 10) + np.arange(40) * 1e-3
    rows = block_rows(np.stack([np.cos(turn), np.sin(turn)], axis=1), 35, min_sims=np.array([[0.9, 0.99]] * 40))
    found = [np.concatenate(c) for c in zip(*linking._forest_edges()(rows), strict=True)]
    assert sorted(zip(*found, strict=True)) == sorted(
        [(10 * (x // 10), x, 0.99) for x in range(40) if x % 10] + [(10, 20, 0.9)]
    )


def test_cells_are_compared_in_32_bits_and_decided_in_64(monkeypatch):
    """Cosines beside the threshold, nearer than 32 bits tell apart, fall on their side of it."""
    turn = np.arccos(0.6) + np.array([*[1e-9] * 5, *[-1e-9] * 5])
    vecs = np.stack([np.cos([0, *turn]), np.sin([0, *turn])], axis=1)
    kinds, units = set(), linking._units()

    class Noted(np.ndarray):
        def __matmul__(self, other):
            kinds.add(self.dtype)
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(linking, "_units", lambda: lambda v: units(v).view(Noted))
    rows = block_rows(vecs, 1, min_sim=np.full(11, 0.6))
    found = [np.concatenate(c) for c in zip(*linking._forest_edges()(rows), strict=True)]
    assert found[1].tolist() == [6, 7, 8, 9, 10] and kinds == {np.dtype(np.float32)}


def test_cells_of_one_base_link_at_their_own_threshold():
    """Both thresholds in one comparison: far cells link inside a base only, and cells without a base have none in common."""
    turn = np.array([0.0, 0.1, 0.8, 0.9, 1.6, 1.7, 2.4, 2.5])
    base = np.array(["x", "x", "x", "y", "y", "z", None, None], dtype=object)
    rows = block_rows(np.stack([np.cos(turn), np.sin(turn)], axis=1), 8, base=base, min_sim=np.full(8, 0.99), base_sim=np.full(8, 0.6))
    found = [np.concatenate(c) for c in zip(*linking._forest_edges()(rows), strict=True)]
    near = [(0, 1, 0.99), (2, 3, 0.99), (4, 5, 0.99), (6, 7, 0.99)]
    assert sorted(zip(*found, strict=True)) == sorted([*near, (0, 2, 0.6), (0, 4, 0.6)])


def test_few_components_meet_their_members_without_a_shuffle_of_vectors(spark):
    vectors = vectors_df(spark, [(v, [1.0, float(v)]) for v in range(6)])
    counts = spark.createDataFrame([(v % 2, v, 2, 0, 1) for v in range(6)], "component_id long, vec_id long, n long, first_us long, last_us long")
    figures = I.group_figures(counts, vectors)
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(component_id" not in plan
    unit = {v: np.array([1.0, v]) / np.hypot(1.0, v) for v in range(6)}
    for row in figures.collect():
        whole = 2 * sum(unit[v] for v in range(6) if v % 2 == row.component_id)
        assert row.members == 6 and abs(row.cohesion - (unit[row.vec_id] @ whole - 1) / 5) < 1e-12


def test_graph_rows_of_blocks_compare_what_time_allows(monkeypatch):
    """Cells of one alert each: half of the pairs lie too early or too late, and are not multiplied."""
    rng = np.random.default_rng(3)
    n, half, window = 2000, 1000, 1_000_000
    at = np.concatenate([rng.integers(0, window, half), rng.integers(window, 2 * window, half)])
    lists = lambda v: np.array([*[[int(x)] for x in v], None], dtype=object)[:-1]
    vecs = rng.normal(size=(n, 8))
    more = {"times": lists(at), "ids": lists(np.arange(n)), "crowded": np.zeros(n, bool), "window_us": np.full(n, window)}
    made, units = [], linking._units()

    class Counted(np.ndarray):
        def __matmul__(self, other):
            made.append((self.shape[0] * other.shape[1], self.dtype))
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(linking, "_units", lambda: lambda v: units(v).view(Counted))
    monkeypatch.setattr(linking, "TILE", 1 << 14)
    rows = block_rows(vecs, half, **more)
    found = [np.concatenate(c) for c in zip(*linking._cell_spans(0.5, None, True)(rows), strict=True)]
    sims = units(rows["embedding"]) @ units(rows["embedding"]).T
    gap = at[None, :] - at[:, None]
    later = (gap > 0) | ((gap == 0) & (np.arange(n)[None, :] > np.arange(n)[:, None]))
    src, dst = np.nonzero((sims >= 0.5) & later & (gap <= window) & (np.arange(n) < half)[:, None])
    assert sorted(zip(found[0], found[1], strict=True)) == sorted(zip(src, dst, strict=True))
    order = np.lexsort((found[1], found[0]))
    assert np.allclose(np.asarray(found[2])[order], sims[src, dst], rtol=0, atol=1e-12) and (found[5] == 1).all()
    assert sum(m for m, _ in made) < 0.55 * half * n and {k for _, k in made} == {np.dtype(np.float32)}


@pytest.fixture
def crowded(monkeypatch):
    """Blocks are tiny, so that every bucket takes several."""
    monkeypatch.setattr(linking, "BLOCK", 3)


@pytest.mark.parametrize("seed,window,threshold", CASES[:3])
def test_small_blocks_give_the_same_components(spark, crowded, seed, window, threshold):
    rows, vecs, alerts, vectors = tables(spark, seed)
    got = {r.alert_id: r.component_id for r in C.connected_components(alerts, vectors, window, threshold).collect()}
    edges = [(a, b) for a, b, _, _ in brute_edges(rows, vecs, window, threshold)]
    assert got == union_find([r[0] for r in rows], edges)


def test_small_blocks_with_services_and_settings(spark, crowded):
    rows, vecs, alerts, vectors = tables(spark, 5)
    ids = [r[0] for r in rows]
    got = {r.alert_id: r.component_id for r in C.connected_components(alerts, vectors, 60, 0.1, 0.6).collect()}
    assert got == union_find(ids, [(a, b) for a, b, _, _ in brute_edges(rows, vecs, 60, 0.1, cross=0.6)])
    settings = [(0, 30, 0.2), (1, 300, 0.7)]
    cells = forest.setting_cells(alerts, vectors, settings)
    for s, window, threshold in settings:
        one = cells.where(F.col("setting") == s)
        got = {r.alert_id: r.component_id for r in C.label_alerts(alerts, one, window).collect()}
        assert got == union_find(ids, [(a, b) for a, b, _, _ in brute_edges(rows, vecs, window, threshold)])


def test_many_distinct_vectors_link_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 40)
    rng = np.random.default_rng(0)
    vecs = [(v, [float(x) for x in rng.normal(size=3)]) for v in range(150)]
    rows = [(i, (i // 3) * SECOND, "s-1", "WARN", "m", i) for i in range(150)]
    alerts, vectors = alerts_df(spark, rows), vectors_df(spark, vecs)
    got = {r.alert_id: r.component_id for r in C.connected_components(alerts, vectors, 20, 0.97).collect()}
    assert got == union_find(range(150), [(a, b) for a, b, _, _ in brute_edges(rows, vecs, 20, 0.97)])


@pytest.mark.parametrize("seed", [1, 5])
def test_small_blocks_give_the_same_edges(spark, crowded, seed):
    rows, vecs, alerts, vectors = tables(spark, seed)
    packed = linking.similarity_edges(alerts, vectors, 60, 0.3).collect()
    assert sorted(unpack(rows, packed)) == sorted((a, b) for a, b, _, _ in brute_edges(rows, vecs, 60, 0.3))
    counts = linking.cross_service_edges(alerts, vectors, 60, 0.1, 0.6).agg(F.sum("n_links")).first()[0]
    assert counts == len(brute_edges(rows, vecs, 60, 0.1, cross=0.6))


@pytest.mark.parametrize("most", [0, 3, 20])
def test_crowded_cells_give_the_same_edges(spark, monkeypatch, most):
    monkeypatch.setattr(linking, "CROWD", most)
    rows, vecs, alerts, vectors = tables(spark, 5)
    packed = linking.similarity_edges(alerts, vectors, 60, 0.3).collect()
    assert sorted(unpack(rows, packed)) == sorted((a, b) for a, b, _, _ in brute_edges(rows, vecs, 60, 0.3))
    assert len({(e.src, e.vec_b) for e in packed}) == len(packed)
    counts = linking.cross_service_edges(alerts, vectors, 60, 0.1, 0.6).agg(F.sum("n_links")).first()[0]
    assert counts == len(brute_edges(rows, vecs, 60, 0.1, cross=0.6))


def test_edges_of_repeated_rows(spark):
    """Vectors that come twice, alerts that come twice, and an id at two places give no copies of links."""
    rows, vecs, alerts, vectors = tables(spark, 5)
    once = linking.similarity_edges(alerts, vectors, 60, 0.3).collect()
    assert sorted(linking.similarity_edges(alerts, vectors.unionByName(vectors), 60, 0.3).collect()) == sorted(once)
    moved = alerts.where("alert_id = 3").withColumn("ts_us", F.col("ts_us") + 5 * SECOND)
    again = linking.similarity_edges(alerts.unionByName(alerts.where("alert_id < 5")).unionByName(moved), vectors, 60, 0.3).collect()
    pairs = {(e.src, e.vec_b) for e in again}
    assert len(pairs) == len(again) and {(e.src, e.vec_b) for e in once if e.src != 3} <= pairs


def test_edges_are_not_stored(spark, monkeypatch):
    """Many similar vectors in one bucket: what is stored follows the alerts, not their links."""
    from alertloom.operators import ordering

    written, keep = [], linking.durable

    def counted(df, *args):
        out = keep(df, *args)
        written.append(out.count())
        return out

    monkeypatch.setattr(ordering, "durable", counted)
    monkeypatch.setattr(linking, "durable", counted)
    rows = [(i, i * SECOND, "s-1", "WARN", "m", i) for i in range(300)]
    vecs = [(v, [1.0, 0.001 * v]) for v in range(300)]
    packed = linking.similarity_edges(alerts_df(spark, rows), vectors_df(spark, vecs), 1000, 0.9)
    assert packed.count() == 300 * 299 // 2 and sum(written) <= len(rows)


def test_vectors_that_never_meet_make_no_rows(spark, monkeypatch):
    """Similar vectors, each active in 20 minutes of its own: what is written follows alerts and edges."""
    written = []

    def counted(df, *args):
        out = keep(df, *args)
        written.append(out.count())
        return out

    from alertloom.operators import ordering

    keep = ordering.durable
    monkeypatch.setattr(ordering, "durable", counted)
    rows = [(i, (i // 20 * 1200 + i % 20 * 60) * SECOND, "s-1", "WARN", "m", i // 20) for i in range(2000)]
    vecs = [(v, [1.0, 0.001 * v]) for v in range(100)]
    packed = linking.similarity_edges(alerts_df(spark, rows), vectors_df(spark, vecs), 60, 0.9).collect()
    assert sum(e.n_links for e in packed) == 2000 - 1
    assert sum(written) <= 4 * (len(rows) + len(packed))


def test_equal_texts_link(spark):
    """A storm of one message is one incident, whatever its words' frequency."""
    from alertloom.operators.alerts import with_cleaned_message

    def incidents(messages):
        rows = [(i, i * SECOND, "db-1", "ERROR", m, 0) for i, m in enumerate(messages)]
        return correlation.correlate_text(with_cleaned_message(alerts_df(spark, rows).drop("vec_id")), window_sec=60, threshold=0.75).incidents.count()

    assert incidents(["disk failed"] * 50) == 1
    assert incidents(["disk failed", "failed disk"] * 20) == 1
    assert incidents(["disk failed on write"] * 10 + ["user login rejected"] * 10) == 2


def test_span_alone_bounds_incidents(spark):
    rows = [(i, i * 30 * SECOND, "s-1", "WARN", "m", 0) for i in range(200)]
    cut = correlation.scored_members(alerts_df(spark, rows), vectors_df(spark, [(0, [1.0, 0.0])]), 60, 0.5, max_span_sec=600)
    spans = cut.groupBy("component_id").agg((F.max("ts_us") - F.min("ts_us")).alias("span")).collect()
    assert len(spans) > 5 and max(r.span for r in spans) <= 600 * SECOND


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    ring = [(2000 + i, 2000 + (i * 7 + 7) % 50) for i in range(50)]
    edges = path + star + ring
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = union_find({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in expected.items() if n != r}


def test_settings_run_together(spark):
    rows, vecs, alerts, vectors = tables(spark, 7)
    settings = [(0, 30, 0.2), (1, 30, 0.8), (2, 300, 0.2)]
    cells = forest.setting_cells(alerts, vectors, settings)
    for s, window, threshold in settings:
        one = cells.where(F.col("setting") == s)
        got = {r.alert_id: r.component_id for r in C.label_alerts(alerts, one, window).collect()}
        edges = [(a, b) for a, b, _, _ in brute_edges(rows, vecs, window, threshold)]
        assert got == union_find([r[0] for r in rows], edges)


def kruskal(edges):
    """Weights of a maximum spanning forest, strongest first."""
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    kept = []
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            kept.append(w)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_maximum_forest(spark, seed):
    """Rings, loops, parallel edges and many equal weights."""
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(5) / 5) for _ in range(200)]
    edges += [(100 + i, 100 + (i + 1) % 40, 0.5) for i in range(40)] + [(200 + i, 201 + i, 0.9 + i / 1000) for i in range(30)]
    got = forest.maximum_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    assert sorted(r.w for r in got) == sorted(kruskal(edges))
    assert {(r.a, r.b, r.w) for r in got} <= set(edges)
    for t in (0.2, 0.5, 0.91):
        assert union_find({n for e in edges for n in e[:2]}, [(r.a, r.b) for r in got if r.w >= t]) == union_find(
            {n for e in edges for n in e[:2]}, [(a, b) for a, b, w in edges if w >= t]
        )


def test_maximum_forest_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b long, w double")
    assert forest.maximum_forest(empty).collect() == []
    assert forest.maximum_forest(spark.createDataFrame([(1, 1, 0.5)], empty.schema)).collect() == []


def test_twenty_thresholds_are_cuts_of_one_comparison(spark, crowded, monkeypatch):
    rows, vecs, alerts, vectors = tables(spark, 6)
    calls, compare = [], linking._compare
    monkeypatch.setattr(linking, "_compare", lambda *args: calls.append(1) or compare(*args))
    settings = [(s, 60, (s + 1) / 20) for s in range(20)]
    whole = forest.window_forest(alerts, vectors, settings)
    runs = whole.heads.count()
    assert len(calls) == 1 and whole.edges.count() < runs
    cells = whole.cells.join(forest.cut(whole, settings), ["window_us", "vec_id", "run"]).toPandas()
    bucketed = [(r[0], r[5], r[1] // (60 * SECOND)) for r in rows]
    for s, window, threshold in settings:
        one = cells[cells.setting == s]
        label = {(v, b): c for v, b, c in zip(one.vec_id, one.bucket, one.component_id, strict=True)}
        expected = union_find([r[0] for r in rows], [(a, b) for a, b, _, _ in brute_edges(rows, vecs, window, threshold)])
        assert {i: label.get((v, b), i) for i, v, b in bucketed} == expected


def test_sweep_equals_a_run_for_each_setting(spark):
    rows, vecs, alerts, vectors = tables(spark, 9)
    alerts = alerts.withColumn("vec_id", F.expr("if(alert_id % 11 = 0, 9999, vec_id)"))  # some have no vector
    settings = [(0, 30, 0.2), (1, 300, 0.7), (2, 300, 0.2)]
    first = min(r[1] for r in rows)
    faults = spark.createDataFrame([(i, first + i * 90 * SECOND, f"s-{i % 4}") for i in range(12)], "fault_id long, ts_us long, cmdb_id string")
    got = {r.setting: r for r in correlation.parameter_sweep(alerts, vectors, faults, settings, 60).collect()}
    for s, window, threshold in settings:
        one = correlation.correlate(alerts, vectors, window_sec=window, threshold=threshold)
        services = I.member_services(one.members)
        incidents = one.incidents.join(services, "component_id").withColumn("incident_no", F.struct("start_us", "component_id"))
        counts = evaluation.fault_match(faults, incidents, 60).agg(*evaluation.counters()).first()
        share = lambda a, b: round(100.0 * a / b, 1) if b else 0.0
        assert (got[s].alerts, got[s].incidents) == (len(rows), one.incidents.count())
        assert got[s].detection_rate == pytest.approx(share(counts.detected, counts.total), abs=0.051)
        assert got[s].root_cause_accuracy == pytest.approx(share(counts.root_localized, counts.detected), abs=0.051)


@pytest.mark.parametrize("gap,span", [(20, 100), (50, 60), (10, 5)])
def test_segments_respect_their_bounds(spark, gap, span):
    rows, vecs, alerts, vectors = tables(spark, 8)
    cells = C.component_cells(alerts, vectors, 120, 0.2)
    cut = segments.span_segments(C.label_alerts(alerts, cells, 120), gap, span).collect()
    assert sorted(r.alert_id for r in cut) == [r[0] for r in rows]
    pieces = {}
    for r in cut:
        pieces.setdefault((r.component_id, r.gap_no), []).append((r.ts_us, r.span_no))
    by_component = {}
    for (component, no), members in pieces.items():
        times = sorted(t for t, _ in members)
        assert all(b - a <= gap * SECOND for a, b in zip(times, times[1:]))
        by_component.setdefault(component, []).append((no, times[0], times[-1]))
        stretches = {}
        for t, s in members:
            stretches.setdefault(s, []).append(t)
        assert all(max(ts) - min(ts) <= span * SECOND for ts in stretches.values())
        # Greedy, by a plain loop over the times.
        begin, number, right = times[0], 0, {}
        for t in times:
            if t - begin > span * SECOND:
                begin, number = t, number + 1
            right.setdefault(number, []).append(t)
        assert {n: sorted(ts) for n, ts in stretches.items()} == right
    for parts in by_component.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(b[1] - a[2] > gap * SECOND for a, b in zip(parts, parts[1:]))


def test_a_long_component_is_cut_in_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    stored = segments.durable
    monkeypatch.setattr(segments, "durable", lambda df: rounds.append(df) or stored(df))
    rng = random.Random(4)
    times = sorted({rng.randrange(0, 2_000_000) for _ in range(20_000)})
    rows = spark.createDataFrame([(i, 1, t * 1000) for i, t in enumerate(times)], "alert_id long, component_id long, ts_us long")
    cut = {r.alert_id: r.span_no for r in segments.span_segments(rows, 60, 3).collect()}
    begin, number = times[0], 0
    for i, t in enumerate(times):
        if t - begin > 3000:
            begin, number = t, number + 1
        assert cut[i] == number
    assert number > 500 and len(rounds) <= 4 + 2 * 11  # 2^10 segments


def test_first_lines_over_files_and_splits(spark, tmp_path):
    from alertloom.sources import logs

    names = ["b.log", "a.log", "c c.log", "empty.log", "d.log"]
    for k, name in enumerate(names):
        (tmp_path / name).write_text("" if name == "empty.log" else "".join(f"{name} {i} {'x' * (i % 40)}\n" for i in range(50 + 30 * k)))
    right = [line for name in sorted(names) for line in (tmp_path / name).read_text().splitlines()]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for most in (1, 49, 50, 51, 130, 333, len(right), len(right) + 1):
            got = logs.read_lines(spark, str(tmp_path), most)
            assert sorted(r.value for r in got.collect()) == sorted(right[:most]), most
            assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
        assert logs.read_lines(spark, str(tmp_path), 0).count() == len(right)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def brute_incidents(rows, vecs, labels):
    sim = similarity(vecs)
    rank = {"FATAL": 4, "ERROR": 3, "WARN": 2}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        groups.setdefault(labels[r[0]], []).append(r)
    out = {}
    for c, members in groups.items():
        scored = []
        for m in members:
            others = [sim(m[5], o[5]) for o in members if o is not m]
            cohesion = sum(others) / len(others) if others else 1.0
            late = (m[1] - members[0][1]) / SECOND
            scored.append((0.45 / (1 + late / 60) + 0.3 * rank[m[3]] / 4 + 0.25 * cohesion, cohesion, m))
        scored.sort(key=lambda s: -round(s[0], 9))
        out[c] = (scored, members)
    return out


@pytest.mark.parametrize("seed", [1, 9])
def test_incidents_equal_brute_force(spark, seed):
    rows, vecs, alerts, vectors = tables(spark, seed)
    found = correlation.correlate(alerts, vectors, window_sec=60, threshold=0.3)
    members = {r.alert_id: r for r in found.members.collect()}
    labels = union_find([r[0] for r in rows], [(a, b) for a, b, _, _ in brute_edges(rows, vecs, 60, 0.3)])
    expected = brute_incidents(rows, vecs, labels)
    heads = {r.component_id: r for r in found.incidents.collect()}
    assert set(heads) == set(expected)
    for c, (scored, group) in expected.items():
        for score, cohesion, m in scored:
            assert math.isclose(members[m[0]].score, score, abs_tol=1e-9)
            assert math.isclose(members[m[0]].cohesion, cohesion, abs_tol=1e-9)
        head = heads[c]
        assert head.root_alert_id == scored[0][2][0]
        assert [x.alert_id for x in head.candidates] == [s[2][0] for s in scored[:3]]
        assert abs(sum(x.confidence for x in head.candidates) - 1) <= 0.002
        assert (head.start_us, head.end_us, head.member_count) == (group[0][1], group[-1][1], len(group))
        sure = head.confidence >= 0.75 and len(group) >= 2
        assert head.status == ("confirmed" if sure else "needs_review")
    order = sorted(heads.values(), key=lambda h: (h.start_us, h.component_id))
    assert [h.incident_no for h in order] == list(range(1, len(order) + 1))
    assert order[0].incident_id == "inc_001"


def test_segmented_incidents_rank_their_own_members(spark):
    rows, vecs, alerts, vectors = tables(spark, 10)
    found = correlation.correlate(alerts, vectors, window_sec=120, threshold=0.2, max_gap_sec=40, max_span_sec=60)
    members = found.members.collect()
    labels = {r.alert_id: r.component_id for r in members}
    assert sorted(labels) == [r[0] for r in rows]
    expected = brute_incidents(rows, vecs, labels)
    for head in found.incidents.collect():
        scored, group = expected[head.component_id]
        assert head.component_id == min(m[0] for m in group)
        assert head.root_alert_id == scored[0][2][0] and head.member_count == len(group)
        assert (group[-1][1] - group[0][1]) <= 60 * SECOND


def test_bursts(spark):
    """Three bursts and a chain of heartbeats: four components."""
    basis = np.eye(16)
    noise = 0.05 * basis[5]
    rows, kinds = [], [
        (12, 0, "dfs.DataNode", "ERROR", 0),
        (3, 0, "hdfs.server.namenode", "ERROR", 1),
        (4, 3600, "org.apache.spark.executor", "WARN", 2),
    ]
    for n, at, service, severity, vec in kinds:
        rows += [(len(rows) + i, at * SECOND, service, severity, "m", vec) for i in range(n)]
    rows += [(len(rows) + i, s * SECOND, "dfs.FSNamesystem", "INFO", "ok", 3) for i, s in enumerate(range(0, 4000, 120))]
    vecs = [(v, [float(x) for x in basis[v] + noise]) for v in range(4)]
    found = correlation.correlate(alerts_df(spark, rows), vectors_df(spark, vecs))
    heads = found.incidents.orderBy("incident_no").collect()
    assert sorted(h.member_count for h in heads) == [3, 4, 12, 34]
    assert {h.status for h in heads} == {"confirmed"} and {h.confidence for h in heads} == {1.0}
    assert [h.root_severity for h in heads if h.member_count == 4] == ["WARN"]


def test_text_path_links_equal_templates(spark):
    rows = [(i, i * SECOND, f"cart-{i % 3}", "ERROR", "m", 0) for i in range(6)]
    rows += [(10 + i, i * SECOND, "pay-0", "WARN", "m", 0) for i in range(4)]
    alerts = alerts_df(spark, rows).drop("vec_id").withColumn(
        "cleaned_message", F.when(F.col("alert_id") < 10, "disk full on host").otherwise("slow response seen")
    )
    found = correlation.correlate_text(alerts)
    assert sorted(h.member_count for h in found.incidents.collect()) == [4, 6]


def test_sync_check(spark):
    _, _, alerts, vectors = tables(spark, 1)
    check = embedding.sync_check(alerts, vectors).first()
    assert check.alerts == 120 and check.vectors == 5 and check.alerts_without_vector > 0
    with pytest.raises(ValueError):
        embedding.require_sync(alerts, vectors)
    embedding.require_sync(alerts.where("vec_id < 4"), vectors.where("vec_id < 4"))


def test_thresholds_are_checked(spark):
    _, _, alerts, vectors = tables(spark, 1)
    with pytest.raises(ValueError):
        linking.similarity_edges(alerts, vectors, 60, 0.0)
    with pytest.raises(ValueError):
        C.component_cells(alerts, vectors, 60, 0.5, 0.4)
