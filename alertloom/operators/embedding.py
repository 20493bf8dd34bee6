"""Text to vectors, and the check that alerts and vectors belong together."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions import text
from alertloom.functions.vectors import l2_normalize
from alertloom.session import durable

DIMENSIONS = 384
# Texts whose words a task has apart at once, bounded in bytes as well; not how many are read.
SLICE, SLICE_BYTES = 1000, 1 << 23


def tag_alerts(cleaned: DataFrame) -> DataFrame:
    """Add `tagged`, the text to embed, and `vec_id`, its key. Equal texts share a vector."""
    tagged = text.service_tagged_text(F.col("service"), F.col("cleaned_message"))
    return cleaned.withColumn("tagged", tagged).withColumn("vec_id", F.md5("tagged"))


def _count_words(dimensions: int):
    most, most_bytes = SLICE, SLICE_BYTES

    def counted(low: pa.Array) -> pa.Array:
        words = pc.split_pattern(low, " ")
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(words).dictionary_encode()
        places = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions if w else -1 for w in coded.dictionary.to_pylist()]
        place = np.array(places, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(len(low)), lengths)[place >= 0]
        n = np.bincount(row * dimensions + place[place >= 0], minlength=len(low) * dimensions)
        ends = np.arange(len(low) + 1, dtype=np.int32) * dimensions
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n, pa.int32()))

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch["low"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = size[at - 1] if at else 0
                end = max(at + 1, min(at + most, int(np.searchsorted(size, before + most_bytes, "right"))))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["tagged"], counted(part["low"])], names=["vec_id", "tagged", "counts"])
                at = end

    return run


def dimension_counts(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, tagged, counts): how many of a text's words fall on each dimension, one row a text.

    A word is hashed once for all texts of a slice, and no word becomes a row.
    """
    low = texts.select("vec_id", "tagged", F.lower("tagged").alias("low"))
    kind = dict(texts.dtypes)["vec_id"]
    return low.mapInArrow(_count_words(dimensions), f"vec_id {kind}, tagged string, counts array<int>")


def term_counts(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, dim, n): how often a text's words fall on each dimension."""
    terms = dimension_counts(texts, dimensions).select("vec_id", F.posexplode("counts").alias("dim", "n")).where("n > 0")
    return terms.groupBy("vec_id", "dim").agg(F.sum("n").alias("n"))


def rarity(df: Column, n_texts: Column) -> Column:
    """1 + ln((texts + 1) / (texts with its dimension + 1)), which is never 0."""
    return 1 + F.log((n_texts + 1.0) / (df + 1))


def weighted_vectors(texts: DataFrame, terms: DataFrame, held: DataFrame, n_texts: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, tagged, embedding) of texts with their terms, given how many of n_texts texts have each dimension (dim, df).

    A term's weight is its count times its `rarity`: a text has a zero vector, which links with nothing, only if it has
    no word.
    """
    weighted = terms.join(held, "dim").groupBy("vec_id")  # at most one row a dimension
    sparse = weighted.agg(F.map_from_entries(F.collect_list(F.struct("dim", (F.col("n") * rarity(F.col("df"), F.lit(n_texts))).alias("w")))).alias("w"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.element_at("w", d), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), dimensions)
    vectors = texts.join(sparse, "vec_id", "left").withColumn("_v", F.when(F.col("w").isNull(), none).otherwise(dense))
    return vectors.select("vec_id", "tagged", l2_normalize(F.col("_v")).alias("embedding"))


def text_vectors(tagged: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, tagged, embedding): hashed term weights of each distinct text, of unit length (see weighted_vectors).

    A vec_id stands for one text, as `tag_alerts` makes it. Counts are stored by text, so weighing them takes no join:
    the frequencies of all dimensions are one row.
    """
    counted = durable(dimension_counts(tagged.select("vec_id", "tagged").distinct(), dimensions))
    held = counted.select(F.posexplode("counts").alias("dim", "n")).groupBy("dim").agg(F.count_if(F.col("n") > 0).alias("df"))
    in_order = F.array_sort(F.collect_list(F.struct("dim", rarity(F.col("df"), F.lit(counted.count())).alias("r"))))["r"]
    weights = durable(held.agg(in_order.alias("weights")))
    weighted = F.zip_with("counts", "weights", lambda n, r: n * r)
    return counted.crossJoin(weights).select("vec_id", "tagged", l2_normalize(weighted).alias("embedding"))


def sync_check(alerts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Alerts without a vector, vectors without an alert, and the range of dimensions."""
    used = alerts.groupBy("vec_id").agg(F.count("*").alias("n"))
    known = vectors.select("vec_id", F.size("embedding").alias("dims"))
    both = used.join(known, "vec_id", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"),
        F.count("dims").alias("vectors"),
        F.coalesce(F.sum(F.when(F.col("dims").isNull(), F.col("n"))), F.lit(0)).alias("alerts_without_vector"),
        F.count_if(F.col("n").isNull()).alias("vectors_without_alert"),
        F.min("dims").cast("long").alias("min_dims"),
        F.max("dims").cast("long").alias("max_dims"),
    )


def require_sync(alerts: DataFrame, vectors: DataFrame) -> None:
    """Raise when an alert has no vector, or vectors are empty or of unequal length."""
    found = sync_check(alerts, vectors).first()
    if found.alerts_without_vector or not found.vectors or found.min_dims != found.max_dims or not found.min_dims:
        raise ValueError(f"alerts and vectors are out of sync: {found.asDict()}")
