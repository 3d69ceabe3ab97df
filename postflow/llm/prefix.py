"""Running totals in a given order without a task that sees a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.operators.storage import saved

ROWS = 2_000_000  # rows of a range, beyond the session's number of shuffle partitions


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], rows: int) -> DataFrame:
    """Adds, for each entry of sums, its total over the rows of the same group that come earlier in order.

    Rows are dealt into ranges of (group, order), so that a group of any size is spread; a row's total is that of the earlier ranges of
    its group and of the earlier rows of its range. The ranges are written once, as their borders are drawn from a sample. Groups may
    be null. `rows` is about how many rows there are; order should tell rows apart, as rows that agree in all of it share a range.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS))
    keys = [F.col(c) for c in group]
    ranged = saved(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = ranged.groupBy(*keys, "__range").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    base = totals.select(*(F.col(c).alias(f"__{c}") for c in group), F.col("__range").alias("__at"), *(zero(F.sum(k).over(across)).alias(f"__base_{k}") for k in sums))
    own = ranged.select("*", *(zero(F.sum(v).over(within)).alias(f"__own_{k}") for k, v in sums.items()))
    same = F.col("__range") == F.col("__at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return own.join(base, same).select(*df.columns, *((F.col(f"__base_{k}") + F.col(f"__own_{k}")).alias(k) for k in sums))
