"""Spark session and table access shared by the jobs, tests and the bench."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "lexsense") -> SparkSession:
    """Session tuned for the jobs: AQE on, UTC, Arrow on, no UI.

    On a cluster the master, memory and checkpoint folder come from spark-submit;
    the values here only fill what is unset.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = SparkConf()  # spark-submit and spark-defaults
    values = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if (master or given.get("spark.master", "local")).startswith("local"):  # sizes of one machine
        values["spark.sql.shuffle.partitions"] = os.environ.get("LEXSENSE_SHUFFLE_PARTITIONS", str((os.cpu_count() or 8) * 2))
        values["spark.driver.memory"] = os.environ.get("LEXSENSE_DRIVER_MEMORY", "16g")
    for key, value in values.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must set it to a shared file system; only a local master gets a folder of our own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexsense-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: cuts the lineage, and with it the size
    estimates that a loop would let grow."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, listed anew each time."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors (its UDFs and mapInPandas functions are
    pickled by reference): zip it once per SparkContext and register it with ``addPyFile``,
    the standard way to ship Python code with a job."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="lexsense-pyfiles-"), "lexsense.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
