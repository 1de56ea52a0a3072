"""Running values along an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.plans.shared import materialize


def with_running_max(df: DataFrame, group: list[str], order: list[str], of: Column, name: str) -> DataFrame:
    """df with the greatest `of` among the rows before each in its group, null for the first; order must end in something unique.

    Rows are dealt by ranges of group and order and written; the parts' own maxima are few and run on from part to part.
    """
    cut = df.withColumn("_of", of).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = materialize(cut.withColumn("_part", F.spark_partition_id()), "running")
    parts = rows.groupBy(*group, "_part").agg(F.max("_of").alias("_most"))  # as many rows as parts and groups together, at most
    parts = parts.withColumn("_before", F.max("_most").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_most")
    inside = F.max("_of").over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(parts, [*group, "_part"]).withColumn(name, F.greatest(inside, F.col("_before"))).drop("_of", "_part", "_before")
