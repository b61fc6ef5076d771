"""Counts and profiles over cases, events and raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as C

def count_rows() -> Column:
    return F.count(F.lit(1))


def count_true(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0)).cast("bigint")


def cohort_summary(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases, events, events per case, label rate and notes, in one grouped pass."""
    as_cases = cases.select(F.lit("case").alias("kind"), "label")
    as_events = events.select(
        F.when(F.col("event_type") == "note", "note").otherwise("event").alias("kind"),
        F.lit(None).cast("boolean").alias("label"),
    )
    totals = as_cases.unionByName(as_events).agg(
        count_true(F.col("kind") == "case").alias("cases"),
        count_true(F.col("kind") != "case").alias("events"),
        count_true(F.col("kind") == "note").alias("notes"),
        count_true(F.col("label").isNotNull()).alias("labelled"),
        count_true(F.col("label")).alias("positives"),
    )
    return totals.withColumn("events_per_case", C.ratio(F.col("events"), F.col("cases"))).withColumn(
        "label_rate", C.ratio(F.col("positives"), F.col("labelled"))
    )


def stay_census(cases: DataFrame) -> DataFrame:
    """Total, in-house and discharged stays per source."""
    open_stay = F.col("discharged_at").isNull()
    return cases.groupBy("source").agg(
        count_rows().alias("total"),
        count_true(open_stay).alias("in_house"),
        count_true(~open_stay).alias("discharged"),
    )


def source_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("source").agg(count_rows().alias("cases"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table; names may carry a namespace before a dot."""
    counts = [
        df.agg(count_rows().alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def namespace_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables and rows per namespace (the part of the name before the dot)."""
    return (
        table_counts(tables)
        .withColumn("namespace", F.substring_index("table_name", ".", 1))
        .groupBy("namespace")
        .agg(count_rows().alias("n_tables"), F.sum("n_rows").alias("n_rows"))
    )


def verify_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Source and target row counts side by side."""
    left = table_counts(source).withColumnRenamed("n_rows", "source_rows")
    right = table_counts(target).withColumnRenamed("n_rows", "target_rows")
    return left.join(right, "table_name", "full").withColumn(
        "same", F.col("source_rows").eqNullSafe(F.col("target_rows"))
    )


def distinct_share(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Distinct keys overall and under a flag, with the percentage."""
    per_key = df.groupBy(key).agg(F.bool_or(flag).alias("flag")).where(F.col(key).isNotNull())
    return per_key.agg(
        count_rows().alias("total"), count_true(F.col("flag")).alias("flagged")
    ).withColumn("pct", F.round(100 * C.ratio(F.col("flagged"), F.col("total")), 1))


def top_values(df: DataFrame, column: str, k: int | None = None, *also: Column) -> DataFrame:
    """Value counts, most frequent first; ties by value."""
    counts = df.groupBy(column).agg(count_rows().alias("n"), *also)
    ordered = counts.orderBy(F.desc("n"), F.col(column))
    return counts if k is None else ordered.limit(k)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null values of each column.

    Two grouped passes per column instead of one expanded count of all.
    """
    parts = [
        df.where(F.col(c).isNotNull()).groupBy(c).agg(F.first(F.lit(1)).alias("_"))
        .agg(count_rows().alias("n_distinct"))
        .select(F.lit(c).alias("column_name"), "n_distinct")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def matching_titles(df: DataFrame, title: str, terms: list[str]) -> DataFrame:
    """Occurrences per title that contains any of the terms."""
    return (
        df.where(C.contains_any(F.col(title), terms))
        .groupBy(title)
        .agg(count_rows().alias("occurrences"))
    )


def group_profile(scored: DataFrame, group: str) -> DataFrame:
    """Cases, mean score and label rate per group."""
    return (
        scored.groupBy(group)
        .agg(
            count_rows().alias("cases"),
            F.avg("score").alias("mean_score"),
            F.avg(F.col("label").cast("double")).alias("label_rate"),
        )
    )


def label_by_codes(
    diagnoses: DataFrame, patterns: dict[int, str], case: str = "hadm_id",
    code: str = "icd_code", version: str = "icd_version",
) -> DataFrame:
    """Per case, whether any code belongs to its version's pattern."""
    cleaned = F.upper(C.strip(F.col(code)))
    hit = reduce(
        lambda a, b: a | b,
        [(F.col(version) == v) & cleaned.rlike(p) for v, p in patterns.items()],
    )
    return diagnoses.groupBy(case).agg(F.bool_or(hit).alias("label"))


def label_by_names(
    conditions: DataFrame, names: list[str], case: str = "case_id", name: str = "name"
) -> DataFrame:
    """Cases with a named condition: the sorted distinct names and the first of them.

    The list per case is bounded by the given names.
    """
    return (
        conditions.where(F.col(name).isin(names))
        .groupBy(case)
        .agg(F.array_sort(F.collect_set(name)).alias("names"))
        .withColumn("scenario", F.get("names", F.lit(0)))
        .withColumn("label", F.lit(True))
    )


def with_labels(cases: DataFrame, labels: DataFrame, case: str = "case_id") -> DataFrame:
    """Left join of case labels, absent read as false."""
    return (
        cases.drop("label")
        .join(labels.select(case, "label"), case, "left")
        .withColumn("label", F.coalesce("label", F.lit(False)))
    )


def longest_stays(
    stays: DataFrame, admitted: str, discharged: str, stay: str, k: int = 5
) -> DataFrame:
    """Stays by length in days, counted in hour boundaries."""
    hour = lambda c: F.floor(F.unix_micros(c) / F.lit(3600e6))
    los = (hour(discharged) - hour(admitted)) / F.lit(24.0)
    return stays.withColumn("los_days", los).orderBy(F.desc_nulls_last("los_days"), stay).limit(k)


def rows_of_cases(rows: DataFrame, cases: DataFrame, key: list[str]) -> DataFrame:
    """Keep rows whose case is in the set."""
    return rows.join(cases.select(*key), key, "left_semi")


def unknown_keys(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key).distinct().join(known.select(*key), key, "left_anti")


def key_set_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return (
        a.withColumn("_l", F.lit(True))
        .join(b.withColumn("_r", F.lit(True)), key, "full")
        .where(F.col("_l").isNull() | F.col("_r").isNull())
        .select(*key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("only_in"))
    )


def held_out_check(train: DataFrame, held_out: DataFrame, text: str = "text") -> DataFrame:
    """Texts shared by both tables and texts repeated within one."""
    both = (
        train.select(text, F.lit("train").alias("part"))
        .unionByName(held_out.select(text, F.lit("held_out").alias("part")))
        .groupBy(text)
        .agg(
            count_true(F.col("part") == "train").alias("in_train"),
            count_true(F.col("part") == "held_out").alias("in_held_out"),
        )
    )
    overlap = (F.col("in_train") > 0) & (F.col("in_held_out") > 0)
    return both.agg(
        count_true(overlap).alias("overlapping"),
        count_true(F.col("in_train") > 1).alias("repeated_in_train"),
        count_true(F.col("in_held_out") > 1).alias("repeated_in_held_out"),
    )
