"""Which discharged cases have waited too long for a score, as a stream.

State per case: its discharge, when it was first scored for it, and whether the flag was given. A discharge that
grows stale while nothing names its case is flagged as well, as soon as the stream's clock has come to it. The
clock is the latest `at`, the time of delivery, of all batches so far, and does not go back; what was
delivered by the clock of an earlier batch comes too late to count.

- A stay that comes late, when it is stale already, is flagged as it comes.
- A repeated stay changes nothing; one with another discharge starts to wait anew, one
  without is open again and waits for nothing. Of several rows of a case in one batch the later delivery
  counts, then the later discharge.
- A score before the discharge grows stale stops the wait, also if it comes before its stay; a later one does not undo the flag.

State is a table of one small row per case, in the checkpoint folder, and is never dropped: a repeat of any age is known. A
batch reads the state that the batch before has left, folds its rows into it in one shuffle by case, and
writes it anew, so a batch that is replayed after a failure gives the same state and flags. All of it is built-in
functions: no case is handed to Python.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tracewell.functions import fixed_values as fixed
from tracewell.schema import KEY

STAY, SCORE = "stay", "score"
NEWS = "source string, case_id string, kind string, at timestamp, discharged_at timestamp"
HELD = "struct<discharged: bigint, delivered: bigint, scored: bigint, flagged: boolean>"
STATE = f"source string, case_id string, held {HELD}, late boolean"
DAY = 86_400_000


def _take(held: Column, row: Column) -> Column:
    """State after one row; times are milliseconds."""
    earlier = F.coalesce(row["at"] < held["delivered"], F.lit(False))
    known = held["delivered"].isNotNull()
    anew = known & ~row["discharged"].eqNullSafe(held["discharged"])
    state = lambda discharged, delivered, scored, flagged: F.struct(
        discharged.alias("discharged"), delivered.alias("delivered"), scored.alias("scored"), flagged.alias("flagged"))
    scored = state(held["discharged"], held["delivered"], F.least(row["at"], held["scored"]), held["flagged"])
    stay = state(row["discharged"], row["at"], F.when(~anew, held["scored"]), held["flagged"] & ~anew)
    return F.when(row["score"], scored).when(earlier, held).otherwise(stay)


def folded(held: DataFrame, news: DataFrame, before: int, after: int, days: int = fixed.STALE_DAYS) -> DataFrame:
    """STATE after a batch of NEWS: one row per case; `late` is null but for a flag given by this batch.

    The clock is at `before` while the rows are taken in, and at `after` when all are."""
    score = F.col("kind").eqNullSafe(SCORE)
    # rows are in the order of this struct; a null discharge counts as 0 there
    row = F.struct(
        F.unix_millis("at").alias("at"), score.alias("score"),
        F.coalesce(F.unix_millis("discharged_at"), F.lit(0)).alias("place"), F.unix_millis("discharged_at").alias("discharged"))
    known = held.select(*KEY, "held", F.lit(None).cast(news.select(row.alias("r")).schema["r"].dataType).alias("row"))
    both = known.unionByName(news.select(*KEY, F.lit(None).cast(HELD).alias("held"), row.alias("row")))
    # rows that are equal count once
    cases = both.groupBy(*KEY).agg(F.first("held", ignorenulls=True).alias("held"), F.array_sort(F.collect_set("row")).alias("rows"))
    none = F.struct(
        *[F.lit(None).cast("bigint").alias(c) for c in ("discharged", "delivered", "scored")], F.lit(False).alias("flagged"))
    # the column of the fold is made once, then read
    taken = cases.select(
        *KEY, (F.size("rows") > 0).alias("named"),
        F.inline(F.array(F.struct(F.aggregate("rows", F.coalesce("held", none), _take).alias("held")))))
    held = F.col("held")
    due = held["discharged"] + days * DAY
    waits = due.isNotNull() & ~held["flagged"] & F.coalesce(held["scored"] >= due, F.lit(True))
    late = F.when(waits & F.col("named") & (due <= before), True).when(waits & (due <= after), False)
    return taken.select(*KEY, "held", late.alias("late")).select(
        *KEY, held.withField("flagged", held["flagged"] | F.col("late").isNotNull()).alias("held"), "late")


def flags_of(state: DataFrame, days: int = fixed.STALE_DAYS) -> DataFrame:
    """The flags that the last batch gave: one for each discharge that went without a score for so many days."""
    discharged = F.col("held.discharged")
    return state.where(F.col("late").isNotNull()).select(
        *KEY, F.timestamp_millis(discharged).alias("discharged_at"),
        F.timestamp_millis(discharged + days * DAY).alias("stale_at"), "late")


def watch_waiting(
    spark: SparkSession, folder: str, flags: str, checkpoint: str, days: int = fixed.STALE_DAYS,
    available_now: bool = True, file_format: str = "parquet",
) -> StreamingQuery:
    """Start the stream from a folder of NEWS files to a folder of flags, each written once, by batch."""
    news = spark.readStream.schema(NEWS).format(file_format).load(folder)
    at = lambda table, batch_id: os.path.join(checkpoint, "waiting", table, f"batch={batch_id}")

    def take(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        if batch_id:
            held = session.read.schema(STATE).parquet(at("state", batch_id - 1))
            before = session.read.parquet(at("clock", batch_id - 1)).head()["clock"]
        else:
            held, before = session.createDataFrame([], STATE), 0
        latest = rows.agg(F.max(F.unix_millis("at"))).head()[0]
        after = max(before, before if latest is None else latest)
        fresh = rows.where(F.col("at").isNull() | (F.col("at") > F.timestamp_millis(F.lit(before))))
        folded(held, fresh, before, after, days).write.mode("overwrite").parquet(at("state", batch_id))
        state = session.read.schema(STATE).parquet(at("state", batch_id))
        flags_of(state, days).write.mode("overwrite").parquet(os.path.join(flags, f"batch={batch_id}"))
        session.createDataFrame([(after,)], "clock bigint").write.mode("overwrite").parquet(at("clock", batch_id))
        if batch_id > 1:
            _drop(session, at("state", batch_id - 2))      # no replay reads it any more

    writer = news.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _drop(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
