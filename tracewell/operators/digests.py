"""A hash tree of order-free digests: where two copies of a table differ, without joining them.

A row's digest is a 128-bit hash of its values and of which of them are null. A node's digest is the
sum over its rows, those of the right side taken with a minus sign, so a node whose copies hold the same
rows, in any order, sums to zero in one grouped pass. Nodes are buckets of the key, then keys, then rows; a
level looks only at what the level above could not clear. Sums are exact, and partial
sums meet before the shuffle, so a key with a third of all rows is one row per task.

Nodes that differ sum to zero by chance only (128 bits). Copies of a row count.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of the first level, and the most that reaches the driver.
BUCKETS = 4096


def _pieces(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of the columns, in pieces of 22 bits whose sums hold for 10^12 rows of a node.

    Nulls do not enter a hash, so their places are hashed as well.
    """
    values, gaps = [F.col(c) for c in columns], [F.isnull(c) for c in columns]
    both = F.xxhash64(*values, *gaps), F.xxhash64(F.lit("second"), *gaps, *reversed(values))
    low = F.lit((1 << 22) - 1)
    return [F.shiftrightunsigned(h, k).bitwiseAND(low) for h in both for k in (0, 22, 44)]


def signed(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of both sides; `n` is 1 on the left and -1 on the right."""
    side = lambda df, n: df.select(*columns, F.lit(n).alias("n"))
    return side(left, 1).unionByName(side(right, -1))


def _differs(columns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.sum(p * F.col("n")) != 0 for p in _pieces(columns)])


def bucket_of(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


@dataclass
class Differences:
    """Row counts of both sides, and the buckets of the key whose rows differ."""
    left_rows: int
    right_rows: int
    buckets: list[int]

    def among(self, df: DataFrame, key: list[str]) -> DataFrame:
        """The rows of df that may lie in those buckets: all of them where too many buckets differ to save a read."""
        if len(self.buckets) > BUCKETS // 4:
            return df
        listed = ", ".join(map(str, self.buckets)) or "NULL"
        return df.withColumn("_bucket", bucket_of(key)).where(f"_bucket IN ({listed})").drop("_bucket")


def differing_buckets(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> Differences:
    """Compare the buckets of two copies: one pass, at most BUCKETS rows to the driver."""
    rows = (
        signed(left, right, [*key, *columns]).groupBy(bucket_of(key).alias("bucket"))
        .agg(F.count_if(F.col("n") > 0).alias("left_rows"), F.count_if(F.col("n") < 0).alias("right_rows"),
             _differs([*key, *columns]).alias("differs"))
        .collect()
    )
    return Differences(
        sum(r["left_rows"] for r in rows), sum(r["right_rows"] for r in rows),
        sorted(r["bucket"] for r in rows if r["differs"]),
    )


def differing_keys(
    left: DataFrame, right: DataFrame, key: list[str], columns: list[str], placed: list[str]
) -> DataFrame:
    """Keys whose rows differ once the columns `placed` count as well; `content` says whether they do without them."""
    return (
        signed(left, right, [*key, *columns, *placed]).groupBy(*key)
        .agg(_differs(columns).alias("content"), _differs([*columns, *placed]).alias("any"))
        .where("any OR content").drop("any")
    )
