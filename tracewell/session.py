"""Session settings, scratch tables and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed case is split even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Python call sites are recorded for every column otherwise, which takes longer
# than planning for wide aggregates.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(master: str | None = None, app: str = "tracewell", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the settings the results depend on in a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tracewell-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir.

    A local session without that setting (tests) gets a temporary folder. A
    cluster without it is an error, because a machine-local folder would be
    lost with its executor.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back.

    Cuts lineage, and pins values that a recomputation could place in another
    partition.
    """
    spark = df.sparkSession
    path = os.path.join(
        scratch_root(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}"
    )
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch folder. Nothing lazy may depend on it any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(os.path.join(scratch_root(spark), context.applicationId))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    """A number of parts that adaptive execution keeps: for rows that grow after they have moved."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """For files that cannot be split (gzip): deal the rows over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
