"""Intermediate tables in the shared checkpoint folder."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of a query at its end; else they stay until the driver happens to collect
    its garbage. For queries whose result is a table: nothing reads their shuffles again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read again: cuts lineage (and the
    size estimates that grow with it), and survives the loss of executors. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)
