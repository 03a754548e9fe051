"""Places of rows in an order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """rows with their place, from 1, among those of equal keys; without keys, among all.

    Rows are sorted out into ranges of keys and order, and places count on from one range to the next, so that no task
    holds more than a range, whatever the size of a group. Rows equal in all of these are placed in any order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # the number of a range is part of the saved rows: it must not change when a task is run again
    parts = rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    same = F.col("__part") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    here = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return parts.withColumn("__here", here).join(shifts, same).select(*rows.columns, (F.col("__here") + F.col("__shift")).alias(name))
