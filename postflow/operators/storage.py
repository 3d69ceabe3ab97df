"""Tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. One is made up only in local mode, where spark.checkpoint.dir may be unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster, tables cut from their lineage need a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The table written once to the shared checkpoint folder and read from there, its lineage cut. As with checkpoints, the folder's owner clears it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are wanted for a while only: saved as above, and freed when they are no longer read, or all at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def saved(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/scratch-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def free(self, *tables: DataFrame) -> None:
        """Overwrites tables with nothing; those that were not saved here are left alone."""
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Inside, the files of a query's shuffles go when it ends, and not when the driver happens to collect its garbage; scratch tables go at the end."""
    before, tables = spark.conf.get(SHUFFLES_GO, None), Scratch(spark)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield tables
    finally:
        tables.free(*[df for df, _ in tables.paths.values()])
        spark.conf.set(SHUFFLES_GO, before) if before else spark.conf.unset(SHUFFLES_GO)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def saved_in_small_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """As saved, for tables whose rows go through Python and may be large: batches sent there are bounded by bytes and not by rows alone.

    The session's own bound comes back afterwards.
    """
    conf = df.sparkSession.conf
    before = conf.get(BATCH_BYTES)
    conf.set(BATCH_BYTES, size)
    try:
        return saved(df)
    finally:
        conf.set(BATCH_BYTES, before)
