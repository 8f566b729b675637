"""Joins and running totals that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.session import cut_lineage, shuffle_width

def running_total(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
) -> DataFrame:
    """``sum(value)`` over all rows up to and including this one, per group, in ``order``.

    A window over the group alone would sort a whole group in one task.  Here the rows are
    range-partitioned by group and order, so a large group lies on many partitions; each partition
    sums its own rows, and the totals of the partitions before it (one small row per partition and
    group) are added.  ``order`` must be unique within a group.
    """
    width = shuffle_width(df.sparkSession)
    keys = [*groups, *order]
    placed = cut_lineage(
        df.withColumn("_value", value)
        .repartitionByRange(width, *keys)
        .withColumn("_part", F.spark_partition_id())
    )
    slices = ["_part", *groups]
    within = W.partitionBy(*slices).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = placed.groupBy(*slices).agg(F.sum("_value").alias("_total"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *slices, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_local", F.sum("_value").over(within))
        .join(offsets, slices)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_value", "_part")
    )


def ordinal(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """Row number from 1 per group, computed as a running total of ones."""
    return running_total(df, groups, order, F.lit(1).cast("bigint"), name)


def tiles(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int, name: str
) -> DataFrame:
    """``ntile(n)`` per group (at least one): the first ``count % n`` tiles hold one row more."""
    numbered = ordinal(df, groups, order, "_row")
    sizes = numbered.groupBy(*groups).agg(F.count("*").alias("_size"))
    base = F.floor(F.col("_size") / n)
    extra = F.col("_size") % n
    large = extra * (base + 1)
    tile = F.when(
        F.col("_row") <= large, F.floor((F.col("_row") - 1) / (base + 1)) + 1
    ).otherwise(extra + F.floor((F.col("_row") - 1 - large) / F.greatest(base, F.lit(1))) + 1)
    joined = numbered.join(sizes, list(groups))
    return joined.withColumn(name, tile.cast("int")).drop("_row", "_size")
