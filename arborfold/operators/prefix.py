"""Running totals in a global order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.plans.scratch import saved


def running(rows: DataFrame, group: list[str], order: list[str], **values: Column) -> DataFrame:
    """rows with a column for each of values: its sum over the rows of the group that come before.

    Rows are sorted by range, so a large group lies in many partitions; a partition's sums are totalled first, and
    each row adds what its partition holds before it.  Rows of equal group and order count in any order.  Written, as
    places must not change when a task is run again.
    """
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = saved(ranged.withColumns({"_part": F.spark_partition_id(), **{f"_{k}": v.cast("long") for k, v in values.items()}}))
    blocks = placed.groupBy(*group, "_part").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in values))
    # at most a row for each group and partition that holds some of it
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_in"), *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_base_{k}") for k in values))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.select("*", *(F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)).alias(f"_own_{k}") for k in values))
    same = F.col("_part") == F.col("_in")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return here.join(blocks, same).select(*rows.columns, *((F.col(f"_own_{k}") + F.col(f"_base_{k}")).alias(k) for k in values))
