"""What the operators of this subpackage share: session settings and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import prepare, scratch_root, table

# Python tasks get batches bounded by rows and by bytes, so that a batch of very
# long texts fits beside the others in an executor.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
LAST_ID = (1 << 63) - 1


def ready(spark: SparkSession) -> SparkSession:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return prepare(spark)


def key_of(column: str) -> Column:
    """An id as a sort key; a null id comes after all others."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(LAST_ID))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(ready(spark), folder, name)
