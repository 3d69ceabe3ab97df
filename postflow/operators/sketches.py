"""Distinct counts that add up: theta sketches by group and run, stored, united over runs and subtracted from each other.

A run is sketched from its own rows and written beside those of earlier runs; totals and gains read sketches only. With 2^lg entries,
counts up to about that many are exact, and beyond it the relative standard error is about 1 / sqrt(2^lg), of a gain relative to the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG = 12


def add_run(rows: DataFrame, folder: str, run: str, by: list[str], item: str, lg: int = LG) -> None:
    """Sketches a run's rows by group; writing a run again replaces it."""
    sketches = rows.groupBy(*by).agg(F.theta_sketch_agg(item, lg).alias("sketch"))
    sketches.write.mode("overwrite").parquet(f"{folder}/run={run}")


def totals(spark: SparkSession, folder: str, by: list[str], where: Column | None = None, lg: int = LG) -> DataFrame:
    """by, sketch: the union over the stored runs, or over those that `where` (on run) chooses; only their folders are read."""
    stored = spark.read.parquet(folder)
    stored = stored if where is None else stored.where(where)
    return stored.groupBy(*by).agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def estimate(sketch: Column | str) -> Column:
    return F.theta_sketch_estimate(sketch).cast("bigint")


def gained(now: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """by, gained: about how many items are in a group's sketch now and not in its sketch before."""
    both = now.join(before.withColumnRenamed("sketch", "old"), by, "left")
    return both.select(*by, F.coalesce(estimate(F.theta_difference("sketch", "old")), estimate("sketch")).alias("gained"))
