"""Connected components of an edge table, and of the alert graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from alertloom.functions.text import base_service
from alertloom.functions.time import long_lit
from alertloom.functions.vectors import linkable
from alertloom.operators import linking
from alertloom.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the smallest node around it."""
    both = edges.select(F.col("child").alias("x"), F.col("parent").alias("y")).unionByName(
        edges.select(F.col("parent").alias("x"), F.col("child").alias("y"))
    )
    lowest = both.groupBy("x").agg(F.min("y").alias("low")).withColumn("low", F.least("x", "low"))
    return both.join(lowest, "x").where("y > x").select(F.col("y").alias("child"), F.col("low").alias("parent"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    lowest = edges.groupBy("child").agg(F.min("parent").alias("low"))
    siblings = (
        edges.join(lowest, "child")
        .where("parent != low")
        .select(F.col("parent").alias("child"), F.col("low").alias("parent"))
    )
    return siblings.unionByName(lowest.select("child", F.col("low").alias("parent")))


def _with_leaves(edges: DataFrame) -> DataFrame:
    """Flag the edges whose child has no other edge: it will share its parent's root, whatever that is."""
    roles = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counted = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    leaves = counted.select(F.col("node").alias("child"), ((F.col("up") == 1) & (F.col("down") == 0)).alias("leaf"))
    return edges.join(leaves, "child")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not its component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): each round is two joins against
    combined minima and no task ever holds a component. Nodes with a single edge
    leave the rounds and are looked up at the end, so rounds shrink quickly. Each
    round is written to reliable storage.
    """
    forest = edges.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    forest = forest.where("child != parent").distinct()
    settled = []
    while True:
        flagged = durable(_with_leaves(forest))
        settled.append(flagged.where("leaf").select("child", "parent"))
        rest = flagged.where("not leaf").select("child", "parent")
        if rest.isEmpty():
            break
        forest = _small_star(_large_star(rest).distinct()).distinct()
    roots = settled.pop().select(F.col("child").alias("node"), F.col("parent").alias("root"))
    while settled:
        upper = roots.withColumnRenamed("node", "parent")
        found = settled.pop().join(upper, "parent", "left")
        named = found.select(F.col("child").alias("node"), F.coalesce("root", "parent").alias("root"))
        # Written, because the next step reads it twice.
        roots = durable(roots.unionByName(named))
    return roots


def component_cells(
    alerts: DataFrame,
    vectors: DataFrame,
    window_sec: float,
    threshold: float,
    cross_threshold: float | None = None,
) -> DataFrame:
    """Cells (vec_id, bucket) of the alert graph with the component each belongs to.

    Alerts whose vector is zero or missing have no cell; they are components of their own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("thresholds must be in (0, 1]")
    if cross_threshold is not None and not threshold <= cross_threshold <= 1:
        raise ValueError("need threshold <= cross_threshold <= 1")

    units = linkable(vectors)
    timed = alerts.withColumn("window_us", long_lit(linking.window_micros(window_sec)))
    narrow = timed.select("alert_id", "ts_us", "vec_id", "window_us", base_service(F.col("service")).alias("base"))
    keys = ["vec_id"]
    chained = durable(
        linking.runs(linking.cells(narrow, keys).join(units.select("vec_id"), "vec_id", "left_semi"), keys)
    )
    heads = run_heads(chained, keys, "first_id")
    least = F.lit(float(threshold))
    placed = chained.join(heads.select(*keys, "run", "node"), [*keys, "run"])
    if cross_threshold is None:
        edges = linking.cell_links(placed.withColumn("min_sim", least), units, [])
    else:
        # A service's run lies inside one run of its vector, found by any bucket of it; the services' cells make up the vector's.
        local = linking.cells(narrow, ["base", "vec_id"]).join(placed.select(*keys, "bucket", "node"), [*keys, "bucket"])
        both = local.withColumns({"min_sim": F.lit(float(cross_threshold)), "base_sim": least})
        edges = linking.cell_links(both, units, [])

    roots = components(edges.select("a", "b"))
    labelled = heads.join(roots, "node", "left").withColumn("component_id", F.coalesce("root", "node"))
    return chained.join(labelled.select(*keys, "run", "component_id"), [*keys, "run"]).drop("run", "first_id")


def run_heads(chained: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row per run with its time range and, as `node`, its smallest label."""
    return chained.groupBy(*keys, "run").agg(
        F.min(label).alias("node"),
        F.min("first_us").alias("start_us"),
        F.max("last_us").alias("end_us"),
        F.first("window_us").alias("window_us"),
    )


def label_alerts(alerts: DataFrame, cells_: DataFrame, window_sec: float, columns: Sequence[str] = ()) -> DataFrame:
    """Alerts with `component_id` (the smallest alert id in the component) and any other cell columns."""
    keys = ["vec_id", "bucket"]
    bucketed = linking.with_bucket(alerts, long_lit(linking.window_micros(window_sec)))
    looked_up = bucketed.join(cells_.select(*keys, "component_id", *columns), keys, "left")
    return looked_up.withColumn("component_id", F.coalesce("component_id", "alert_id")).drop("bucket")


def connected_components(
    alerts: DataFrame,
    vectors: DataFrame,
    window_sec: float,
    threshold: float,
    cross_threshold: float | None = None,
) -> DataFrame:
    found = component_cells(alerts, vectors, window_sec, threshold, cross_threshold)
    return label_alerts(alerts, found, window_sec).select("alert_id", "component_id")
