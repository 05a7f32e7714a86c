"""Row positions inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add a 1-based position per group without gathering a group in one task.

    Rows are range-partitioned by (group, order), so a group holding a third of the
    input spreads over a third of the partitions. Each partition numbers its own rows;
    only groups that cross a partition boundary (at most two per partition) need an
    offset, which makes the offset table safe to broadcast.
    """
    group_columns = [F.col(column) for column in group]
    tagged = materialize(
        df.repartitionByRange(*group_columns, *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = tagged.groupBy("_slice", *group).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("_offset", F.sum("_rows").over(before))
        .filter(F.col("_offset").isNotNull())
        .drop("_rows")
    )
    within = Window.partitionBy("_slice", *group).orderBy(*order)
    return (
        tagged.withColumn("_local", F.row_number().over(within))
        .join(F.broadcast(offsets), ["_slice", *group], "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0)))
        .drop("_slice", "_local", "_offset")
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first k rows per group, numbered.

    The `<= k` filter right above `row_number` lets Spark keep only k rows per group
    on the map side, so a dominant group shuffles k rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
