import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.operators import ordering as O


def skewed(spark, n=3000):
    """A third of the rows share one key and one score."""
    rng = random.Random(3)
    rows = [
        (i, "hot" if i % 3 == 0 else f"k{rng.randrange(200)}",
         0.5 if i % 3 == 0 else rng.randrange(50) / 50, rng.randrange(10))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id bigint, key string, score double, v bigint").repartition(5)


def same(a, b):
    columns = sorted(a.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_global_rank_equals_one_window(spark):
    df = skewed(spark)
    ranked = O.global_rank(df, [F.desc("score"), F.asc("id")])
    plain = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint"))
    assert same(ranked, plain)


def test_global_rank_splits_a_hot_score(spark):
    ranged = O._ranged(skewed(spark, 30000), [F.desc("score"), F.asc("id")])
    largest = ranged.groupBy(O.PART).count().agg(F.max("count")).head()[0]
    assert ranged.select(O.PART).distinct().count() == 1 or largest < 30000 / 2


def test_running_totals(spark):
    df = skewed(spark)
    totals = O.running_totals(df, [F.col("score"), F.col("id")], {"upto": "v"})
    upto = Window.orderBy("score", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert same(totals, df.withColumn("upto", F.sum("v").over(upto)))


def test_lag_and_number_within_a_hot_key(spark):
    df = skewed(spark)
    order = [F.col("v"), F.col("id")]
    lagged = O.lag_within(df, ["key"], order, {"before": "v", "score_before": "score"})
    w = Window.partitionBy("key").orderBy("v", "id")
    assert same(lagged, df.withColumn("before", F.lag("v").over(w)).withColumn(
        "score_before", F.lag("score").over(w)))
    numbered = O.number_within(df, ["key"], order, "n")
    assert same(numbered, df.withColumn("n", F.row_number().over(w)))


def test_null_keys_keep_their_rows(spark):
    rows = [(None if i % 3 else "a", "x" if i % 2 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, l string, id bigint").repartition(5)
    w = Window.partitionBy("k", "l").orderBy("id")
    # several ranges, so that keys go on over range borders
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert same(O.number_within(df, ["k", "l"], [F.col("id")], "n"), df.withColumn("n", F.row_number().over(w)))
    assert same(O.lag_within(df, ["k", "l"], [F.col("id")], {"p": "id"}), df.withColumn("p", F.lag("id").over(w)))
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_flag_smallest_is_exact(spark):
    df = skewed(spark).withColumn("h", C.seeded_hash(5, F.col("id"))).withColumn("hot", F.col("key") == "hot")
    chosen = O.flag_smallest(df, "h", {True: 137, False: 1}, "hot")
    w = Window.partitionBy("hot").orderBy("h")
    wanted = F.row_number().over(w) <= F.when(F.col("hot"), 137).otherwise(1)
    assert same(chosen, df.withColumn("chosen", wanted))
    everything = O.flag_smallest(df, "h", {True: 10**6, False: 0}, "hot")
    assert everything.where("chosen").count() == df.where("hot").count()


def test_empty_input(spark):
    empty = skewed(spark).where("id < 0")
    assert O.global_rank(empty, [F.col("id")]).count() == 0
    assert O.lag_within(empty, ["key"], [F.col("id")], {"x": "v"}).count() == 0
    assert O.number_within(empty, ["key"], [F.col("id")], "n").count() == 0
