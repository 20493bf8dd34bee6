"""Order-dependent operators that hold when one group has a third of all rows.

A plain window function puts each group into one task. Here rows are
range-partitioned on (group, order), so that a large group is cut into even
slabs; a running value is computed per slab and shifted by the totals of the
slabs before it. Those totals are one row per slab and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertloom.session import durable


# Most rows of a slab, on average: what a window task sorts.
SLAB_ROWS = 2_000_000


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Add `out`: the sum of `value` up to and including the row, per group.

    `order` has to tell the rows of a group apart. Group columns must not be NULL.
    """
    slabs = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLAB_ROWS))
    keys = list(group) or ["_all"]
    # The slab number is only meaningful while the partitioning is pinned, hence durable().
    pinned = durable(
        df.withColumn("_all", F.lit(0))
        .withColumn("_value", value.cast("long"))
        .repartitionByRange(slabs, *keys, *order)
        .withColumn("_slab", F.spark_partition_id())
    )
    before = W.partitionBy(*keys).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        pinned.groupBy("_slab", *keys)
        .agg(F.sum("_value").alias("_total"))
        .select("_slab", *keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    )
    within = W.partitionBy("_slab", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        pinned.withColumn("_local", F.sum("_value").over(within))
        .join(shifts, ["_slab", *keys])
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_slab", "_all", "_value", "_local", "_shift")
    )


def position(df: DataFrame, order: Sequence[str], out: str = "idx", group: Sequence[str] = ()) -> DataFrame:
    """Add `out`: the dense 0-based rank of the row in its group (or in the whole table)."""
    return running_sum(df, group, order, F.lit(1), out).withColumn(out, F.col(out) - 1)


def ranked(df: DataFrame, order: Sequence[str], out: str = "idx", group: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """As position, for wide rows: only group and order columns are sorted and stored, then joined back.

    `keep` is a condition on `out` that is applied before the join. `order` has to tell the rows apart.
    """
    keys = [*group, *order]
    narrow = position(df.select(*keys), order, out, group)
    narrow = narrow if keep is None else narrow.where(keep)
    narrow = narrow.select(*[F.col(c).alias(f"_{c}") for c in keys], out)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return df.join(narrow, same).drop(*[f"_{c}" for c in keys])


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first k rows of each group, numbered from 1.

    Spark keeps k rows per group and task before the shuffle, so a large group
    never travels as a whole.
    """
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col(out) <= k)
