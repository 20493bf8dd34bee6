"""Components of the alert graph at many thresholds, from one comparison of each window.

A maximum spanning forest keeps, for every threshold at once, what is connected: whatever is linked by similarities of t
or more is linked by forest edges of t or more. Forests of parts make up that of the whole, so each pair of blocks gives
its own, at most one edge a cell, and Boruvka's rounds over Spark tables reduce their union: every component picks its
strongest outgoing edge, the picked edges are contracted, and of parallel edges the strongest stays. A round at least
halves the components. Any threshold is then a cut of the forest, which has fewer edges than there are runs: alerts,
vectors and comparisons are not touched again.

Alerts are read once for each window, not for each setting.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.time import long_lit
from alertloom.functions.vectors import linkable
from alertloom.operators import components as C, linking
from alertloom.session import durable

Setting = tuple[int, float, float]  # number, window in seconds, threshold


class Forest(NamedTuple):
    """`cells` (window_us, vec_id, bucket, run, ...), `heads` (window_us, vec_id, run, node, ...), `edges` (window_us, a, b, sim)."""

    cells: DataFrame
    heads: DataFrame
    edges: DataFrame


def _strongest(edges: DataFrame) -> DataFrame:
    """Of edges (x, y, w, a, b), the strongest between each two nodes, which come in order."""
    ordered = edges.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "w", "a", "b")
    return ordered.groupBy("x", "y").agg(F.max(F.struct("w", "a", "b")).alias("e")).select("x", "y", "e.*")


def maximum_forest(edges: DataFrame) -> DataFrame:
    """Of edges (a, b, w), those of a maximum spanning forest; loops and all but the strongest of parallel edges go.

    Equal weights are ordered by their nodes, so picks never make a ring. An empty table gives an empty one.
    """
    live = durable(_strongest(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b")))
    found = edges.select("a", "b", "w").where("false")
    while not live.isEmpty():
        edge = F.struct("w", "x", "y", "a", "b").alias("edge")
        ends = live.select(F.col("x").alias("node"), edge).unionByName(live.select(F.col("y").alias("node"), edge))
        picked = durable(ends.groupBy("node").agg(F.max("edge").alias("edge")).select("edge.*").distinct())
        found = found.unionByName(picked.select("a", "b", "w"))
        roots = C.components(picked.select(F.col("x").alias("a"), F.col("y").alias("b")))
        for end in ("x", "y"):
            moved = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
            live = live.join(moved, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        live = durable(_strongest(live))
    return found


def window_forest(alerts: DataFrame, vectors: DataFrame, settings: Sequence[Setting]) -> Forest:
    """The forest of each window of the settings, at the thresholds that it is asked for; `sim` is the highest that a link reaches."""
    if not settings or not all(0 < t <= 1 for _, _, t in settings):
        raise ValueError("thresholds must be in (0, 1]")
    levels: dict[int, set[float]] = {}
    for _, window, t in settings:
        levels.setdefault(linking.window_micros(window), set()).add(float(t))
    grid = F.array(
        *[F.struct(long_lit(us).alias("window_us"), F.array(*map(F.lit, sorted(ts))).alias("min_sims")) for us, ts in sorted(levels.items())]
    )
    windows = F.array(*[F.struct(long_lit(us).alias("window_us")) for us in sorted(levels)])
    units = linkable(vectors)
    timed = alerts.select("alert_id", "ts_us", "vec_id", F.inline(windows)).withColumn("window", F.col("window_us"))
    keys = ["window", "vec_id"]
    cells = linking.cells(timed, keys).join(units.select("vec_id"), "vec_id", "left_semi")
    chained = durable(linking.runs(cells, keys))
    heads = C.run_heads(chained, keys, "first_id")
    asked = F.element_at(F.filter(grid, lambda g: g["window_us"] == F.col("window_us")), 1)["min_sims"]
    placed = chained.join(heads.select(*keys, "run", "node"), [*keys, "run"]).withColumn("min_sims", asked)
    # Neighbouring buckets repeat edges between the same runs; they are combined before the rounds.
    links = linking.cell_forest(placed, units, ["window"])
    node = lambda c: F.struct("window", F.col(c).alias("id")).alias(c)
    edges = maximum_forest(links.select(node("a"), node("b"), F.col("sim").alias("w")))
    flat = edges.select(F.col("a.window").alias("window_us"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("w").alias("sim"))
    return Forest(chained.drop("window"), heads.drop("window"), flat)


def _of_window(settings: Sequence[Setting]) -> Column:
    """The settings of a row's window_us, as structs (setting, threshold)."""
    grid = F.array(
        *[
            F.struct(F.lit(s).alias("setting"), long_lit(linking.window_micros(w)).alias("window_us"), F.lit(float(t)).alias("threshold"))
            for s, w, t in settings
        ]
    )
    return F.filter(grid, lambda g: g["window_us"] == F.col("window_us"))


def cut(forest: Forest, settings: Sequence[Setting]) -> DataFrame:
    """(setting, window_us, vec_id, run, component_id): the component of every run in every setting."""
    holds = F.filter(_of_window(settings), lambda g: F.col("sim") >= g["threshold"])
    kept = forest.edges.withColumn("_s", F.explode(holds["setting"]))
    named = lambda c: F.struct(F.col("_s").alias("setting"), F.col(c).alias("id"))
    roots = C.components(kept.select(named("a").alias("a"), named("b").alias("b")))
    runs = forest.heads.withColumn("_s", F.explode(_of_window(settings)["setting"]))
    labelled = runs.withColumn("node", named("node")).join(roots, "node", "left")
    return labelled.select(
        F.col("node.setting").alias("setting"), "window_us", "vec_id", "run", F.coalesce("root", "node")["id"].alias("component_id")
    )


def setting_cells(alerts: DataFrame, vectors: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """Cells (setting, vec_id, bucket, ...) of the alert graph with their component in each setting."""
    forest = window_forest(alerts, vectors, settings)
    return forest.cells.join(cut(forest, settings), ["window_us", "vec_id", "run"]).drop("run", "first_id")
