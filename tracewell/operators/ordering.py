"""Order-dependent results without pulling an order into one task.

A window without partitions, or one over a key that holds a third of the rows,
runs in a single task. Here the rows are range-partitioned on the full sort
key instead. The key ends in a unique column, so equal scores and hot keys are
split over partitions too. The ranged rows are written once, which pins the
partition of each row; what crosses partition borders is one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import materialize

PART, SPOT = "_part", "_spot"
# Rows of a key that one task numbers; longer keys go by ranges. Shares of the rows that are looked at to tell.
LONG_KEY, LOOKED_AT = 2_000_000, 0.01

ROWS_BELOW = (Window.unboundedPreceding, Window.currentRow)


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in global order: _part is the range, _spot the position inside it."""
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # One id expression only, so both parts come from the same evaluation.
    return materialize(
        ordered.withColumn(SPOT, place)
        .withColumn(PART, F.shiftright(SPOT, 33).cast("int"))
        .withColumn(SPOT, F.col(SPOT).bitwiseAND(F.lit((1 << 33) - 1))),
        "ranged",
    )


def _before_parts(per_part: DataFrame, names: list[str]) -> DataFrame:
    """Totals of all earlier parts. per_part has one row per range partition."""
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        PART, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_before") for n in names]
    )


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position in the given total order."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    # At most one row per range partition.
    offsets = F.broadcast(_before_parts(sizes, ["n"]))
    return (
        ranged.join(offsets, PART)
        .withColumn(name, F.col("_n_before") + F.col(SPOT) + 1)
        .drop(PART, SPOT, "_n_before")
    )


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Adds, per {new: column}, the sum of column up to and including the row."""
    ranged = _ranged(df, order)
    names = list(totals)
    sums = ranged.groupBy(PART).agg(*[F.sum(totals[n]).alias(n) for n in names])
    offsets = F.broadcast(_before_parts(sums, names))
    inside = Window.partitionBy(PART).orderBy(SPOT).rowsBetween(*ROWS_BELOW)
    return (
        ranged.join(offsets, PART)
        .select(
            *df.columns,
            *[
                (F.sum(totals[n]).over(inside) + F.col(f"_{n}_before")).alias(n)
                for n in names
            ],
        )
    )


def number_within(
    df: DataFrame, keys: list[str], order: list[Column], name: str
) -> DataFrame:
    """1-based running number per key, null keys included.

    Keys are numbered where a shuffle by key brings their rows. Those of about LONG_KEY rows and more, by a sample, would
    hold up a task, and go by ranges of the whole order; both ways give the same numbers.
    """
    df = materialize(df, "unnumbered")
    sampled = df.select(*keys).sample(LOOKED_AT, 7).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # fewer than one per LONG_KEY rows
    long = materialize(sampled.where(F.col("_n") >= LONG_KEY * LOOKED_AT).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]), "long_keys")
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias(name)
    if long.isEmpty():
        return df.select("*", plain)
    of_long = F.lit(True)
    for i, k in enumerate(keys):
        of_long = of_long & F.col(k).eqNullSafe(F.col(f"_{i}"))
    ranged = number_by_ranges(df.join(F.broadcast(long), of_long, "left_semi"), keys, order, name)
    return df.join(F.broadcast(long), of_long, "left_anti").select("*", plain).unionByName(ranged)


def number_by_ranges(
    df: DataFrame, keys: list[str], order: list[Column], name: str
) -> DataFrame:
    """number_within by ranges, for keys of any length.

    A key that goes on from one range into the next is the last key of each range
    before, so its rows there are known from one row per range.
    """
    ranged = _ranged(df, [F.col(k) for k in keys] + order)
    key = F.struct(*keys)
    sizes = ranged.groupBy(PART, *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(SPOT).alias("_from")
    )
    ends = sizes.groupBy(PART).agg(
        F.min_by(key, "_from").alias("_head"), F.max_by(key, "_from").alias("_tail"),
        F.max_by("_n", "_from").alias("_tail_n"),
    )
    earlier = ends.select(F.col(PART).alias("_earlier"), F.col("_tail").alias("_same"), F.col("_tail_n").alias("_rows"))
    # One row per range.
    carried = F.broadcast(
        ends.select(PART, "_head").join(
            earlier,
            F.col("_head").eqNullSafe(F.col("_same")) & (F.col("_earlier") < F.col(PART)),
        )
        .groupBy(PART).agg(F.first("_head").alias("_head"), F.sum("_rows").alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(SPOT))
    before = F.when(F.col("_head").eqNullSafe(key), F.col("_before"))
    return ranged.join(carried, PART, "left").select(
        *df.columns, (inside + F.coalesce(before, F.lit(0))).cast("int").alias(name)
    )


def lag_within(
    df: DataFrame, keys: list[str], order: list[Column], lags: dict[str, str]
) -> DataFrame:
    """Adds, per {new: column}, the column's value on the previous row of the key."""
    ranged = _ranged(df, [F.col(k) for k in keys] + order)
    inside = Window.partitionBy(PART, *keys).orderBy(SPOT)
    # Last row of each part, handed to the first row of the next part.
    carried = list(dict.fromkeys([*keys, *lags.values()]))
    tails = ranged.groupBy(PART).agg(
        F.max_by(F.struct(*carried), F.col(SPOT)).alias("_tail")
    )
    handed = F.broadcast(
        tails.select(PART, F.lag("_tail").over(Window.orderBy(PART)).alias("_handed"))
    )
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"_handed.{k}").eqNullSafe(F.col(k))
    first_here = F.row_number().over(inside) == 1
    return ranged.join(handed, PART).select(
        *df.columns,
        *[
            F.when(
                first_here, F.when((F.col(SPOT) == 0) & same_key, F.col(f"_handed.{c}"))
            ).otherwise(F.lag(c).over(inside)).alias(n)
            for n, c in lags.items()
        ],
    )


def flag_smallest(
    df: DataFrame, hash_col: str, wanted: dict, group: str, name: str = "chosen"
) -> DataFrame:
    """Marks the wanted[g] rows with the smallest hash in each group g, exactly.

    Counts per group and four-digit hash prefix find the prefix that holds the
    cut, and only rows with that prefix are ranked; the marking itself is then a
    plain comparison. hash_col must be uniform and unique (see seeded_hash).
    Groups missing from wanted are left unmarked.
    """
    keep = F.lit(None).cast("bigint")
    for value, count in wanted.items():
        keep = F.when(F.col(group) == F.lit(value), F.lit(int(count)).cast("bigint")).otherwise(keep)
    hashed = df.select(group, hash_col, F.substring(hash_col, 1, 4).alias("_prefix"))
    # At most 65,536 rows per group, and few groups.
    counts = hashed.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_prefix"))
    cut = (
        counts.withColumn("_upto", upto)
        .withColumn("_keep", keep)
        .where((F.col("_upto") - F.col("_n") < F.col("_keep")) & (F.col("_keep") <= F.col("_upto")))
        .select(group, "_prefix", (F.col("_keep") - F.col("_upto") + F.col("_n")).alias("_nth"))
    )
    nth = F.row_number().over(Window.partitionBy(group, "_prefix").orderBy(hash_col))
    last = (
        hashed.join(F.broadcast(cut), [group, "_prefix"])
        .withColumn("_rn", nth)
        .where(F.col("_rn") == F.col("_nth"))
        .select(F.col(group).alias("_group"), F.col(hash_col).alias("_last"))
    )
    size = counts.groupBy(group).agg(F.sum("_n").alias("_size"))
    # One row per group.
    bounds = size.join(last, F.col(group) == F.col("_group"), "left").select(
        F.col(group).alias("_of"), (keep >= F.col("_size")).alias("_all"), "_last"
    )
    chosen = F.coalesce(F.col("_all") | (F.col(hash_col) <= F.col("_last")), F.lit(False))
    return (
        df.join(F.broadcast(bounds), F.col(group) == F.col("_of"), "left")
        .withColumn(name, chosen)
        .drop("_of", "_all", "_last")
    )
