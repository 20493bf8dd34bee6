"""Correlation of alerts as they arrive.

The state between batches is a table of open cells: (vector, bucket) with their
time range and the label of the component they are in. A batch adds its alerts to
the cells, links cells as the batch plan does, and writes

* `labels/<batch>`  (alert_id, label), once per arriving alert;
* `merges/<batch>`  (label, root), components that turned out to be one;
* `open/<batch>`    the cells that later alerts can still link to;
* `late/<batch>`    how many alerts came after the watermark and were left out;
* `vectors/<batch>` and `held/<batch>`, where vectors are made from text (see LiveVectors).

Every batch reads the state of the one before and writes folders of its own, so a
batch that is run again after a failure replaces what it wrote. State grows with
vectors and the open time range, not with alerts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom import schema
from alertloom.functions.time import bucket, long_lit
from alertloom.functions.vectors import linkable
from alertloom.operators import embedding, linking
from alertloom.operators.components import components, run_heads
from alertloom.session import durable
from alertloom.streaming.feeds import each_batch

CELL = ["vec_id", "bucket", "first_us", "last_us", "label", "window_us"]


class LiveVectors:
    """Vectors of templates, made when they are first seen in a stream.

    A batch counts the new texts' dimensions into the document frequencies of all texts so far (`held/<batch>`, at most
    one row a dimension and one for the number of texts) and writes the new texts' vectors by them (`vectors/<batch>`).
    A text keeps the vector of its first batch, so whatever was linked by it stays linked. A batch reads what earlier
    batches wrote, never its own folders, and so may be run again.
    """

    def __init__(self, root: str, dimensions: int = embedding.DIMENSIONS):
        self.root = root
        self.dimensions = dimensions

    def _held(self, spark: SparkSession, number: int) -> DataFrame:
        """(dim, df) of all texts before a batch; the row without dimension counts the texts."""
        if number > 0:
            return spark.read.parquet(f"{self.root}/held/{number - 1}")
        return spark.createDataFrame([], "dim int, df long")

    def upto(self, spark: SparkSession, number: int) -> DataFrame:
        """(vec_id, tagged, embedding, batch) of all texts of the batches before `number`."""
        schema_ = "vec_id string, tagged string, embedding array<double>, batch int"
        if number == 0:
            return spark.createDataFrame([], schema_)
        return spark.read.schema(schema_).parquet(*[f"{self.root}/vectors/{n}" for n in range(number)])

    def add(self, tagged: DataFrame, number: int) -> DataFrame:
        """The vectors of all texts up to and including this batch's `tagged` (vec_id, tagged)."""
        spark = tagged.sparkSession
        known = self.upto(spark, number)
        new = durable(tagged.select("vec_id", "tagged").distinct().join(known.select("vec_id"), "vec_id", "left_anti"))
        terms = durable(embedding.term_counts(new, self.dimensions))
        own = terms.groupBy("dim").agg(F.count("*").alias("df")).unionByName(new.agg(F.count("*").alias("df")).withColumn("dim", F.lit(None).cast("int")))
        held = self._held(spark, number).unionByName(own).groupBy("dim").agg(F.sum("df").alias("df"))
        held.write.mode("overwrite").parquet(f"{self.root}/held/{number}")
        held = self._held(spark, number + 1)
        texts = held.where("dim IS NULL").first().df
        made = embedding.weighted_vectors(new, terms, held.where("dim IS NOT NULL"), texts, self.dimensions)
        made.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.root}/vectors/{number}")
        return self.upto(spark, number + 1)


class LiveCorrelation:
    """Live correlation with a table of vectors or, without one, with vectors that are made as templates appear.

    In the second case alerts have `service` and `cleaned_message` instead of `vec_id`.
    """

    def __init__(
        self,
        vectors: DataFrame | None,
        root: str,
        window_sec: float = schema.WINDOW_SEC,
        threshold: float = schema.SIMILARITY,
        delay_sec: float = 600,
    ):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        self.vectors = vectors
        self.made = LiveVectors(root) if vectors is None else None
        self.root = root
        self.window_us = linking.window_micros(window_sec)
        self.delay_us = linking.window_micros(delay_sec)
        self.threshold = threshold

    def run(self, alerts: DataFrame) -> None:
        """Correlate the stream (alert_id, ts_us, vec_id or service and cleaned_message) over all data present."""
        each_batch(alerts, self.batch, self.root)

    def _state(self, spark: SparkSession, number: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.root}/open/{number - 1}") if number > 0 else None

    def batch(self, arrived: DataFrame, number: int) -> None:
        spark = arrived.sparkSession
        open_cells = self._state(spark, number)
        if self.made is None:
            alerts = durable(arrived.select("alert_id", "ts_us", "vec_id"))
        else:
            alerts = durable(embedding.tag_alerts(arrived).select("alert_id", "ts_us", "vec_id", "tagged"))
        # The watermark is stored with the state, in a row of its own.
        newest = None
        if open_cells is not None:
            newest = open_cells.where("vec_id IS NULL").first().last_us
            open_cells = open_cells.where("vec_id IS NOT NULL")
        horizon = None if newest is None else newest - self.delay_us
        late = F.lit(False) if horizon is None else F.col("ts_us") < horizon
        self._write(alerts.agg(F.count_if(late).alias("late")), "late", number)
        alerts = alerts.where(~late)

        window = long_lit(self.window_us)
        vectors = linkable(self.vectors if self.made is None else self.made.add(alerts, number).select("vec_id", "embedding"))
        fresh = (
            linking.cells(alerts.withColumn("window_us", window), ["vec_id"])
            .join(vectors.select("vec_id"), "vec_id", "left_semi")
            .withColumn("label", F.lit(None).cast("long"))
            .select(*CELL, "first_id")
        )
        known = fresh
        if open_cells is not None:
            known = fresh.unionByName(open_cells.select(*CELL, F.col("label").alias("first_id")))
        merged = known.groupBy("vec_id", "bucket").agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.coalesce(F.min("label"), F.min("first_id")).alias("label"),
            F.first("window_us").alias("window_us"),
        )
        cells = durable(self._relabel(merged, vectors))

        labelled = alerts.withColumn("bucket", bucket(F.col("ts_us"), window)).join(
            cells.select("vec_id", "bucket", "root"), ["vec_id", "bucket"], "left"
        )
        self._write(labelled.select("alert_id", F.coalesce("root", "alert_id").alias("label")), "labels", number)
        changed = cells.where("label != root").select("label", "root").distinct()
        self._write(changed, "merges", number)

        seen = alerts.agg(F.max("ts_us").alias("last_us"))
        last = seen.select(F.greatest("last_us", F.lit(newest).cast("long")).alias("last_us"))
        nearest = F.coalesce(last.scalar(), long_lit(0)) - long_lit(self.delay_us + self.window_us)
        still = cells.where(F.col("last_us") >= nearest).drop("label").withColumnRenamed("root", "label").select(*CELL)
        nothing = [F.lit(None).cast(t).alias(n) for n, t in still.dtypes if n != "last_us"]
        marker = last.select("last_us", *nothing).select(*CELL)
        self._write(still.unionByName(marker), "open", number)

    def _relabel(self, cells: DataFrame, vectors: DataFrame) -> DataFrame:
        chained = durable(linking.runs(cells, ["vec_id"]))
        heads = run_heads(chained, ["vec_id"], "label")
        placed = chained.join(heads.select("vec_id", "run", "node"), ["vec_id", "run"])
        along = placed.select(F.col("label").alias("a"), F.col("node").alias("b")).where("a != b")
        graded = placed.withColumn("min_sim", F.lit(float(self.threshold)))
        edges = along.unionByName(linking.cell_links(graded, vectors, []))
        roots = components(edges)
        return (
            chained.drop("run")
            .join(roots.withColumnRenamed("node", "label"), "label", "left")
            .withColumn("root", F.coalesce("root", "label"))
        )

    def _write(self, table: DataFrame, name: str, number: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.root}/{name}/{number}")

    def components(self, spark: SparkSession) -> DataFrame:
        """(alert_id, component_id) of everything seen so far, as the batch plan names them."""
        labels = spark.read.parquet(f"{self.root}/labels/*")
        merges = spark.read.parquet(f"{self.root}/merges/*")
        roots = components(merges.select(F.col("label").alias("a"), F.col("root").alias("b")))
        resolved = labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select(
            "alert_id", F.coalesce("root", "label").alias("root")
        )
        smallest = resolved.groupBy("root").agg(F.min("alert_id").alias("component_id"))
        return resolved.join(smallest, "root").select("alert_id", "component_id")

    def late(self, spark: SparkSession) -> int:
        try:
            return spark.read.parquet(f"{self.root}/late/*").agg(F.sum("late")).first()[0] or 0
        except AnalysisException:
            return 0
