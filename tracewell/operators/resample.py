"""Exact, seeded samples: prevalence thinning, train/test split, folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.cohort import count_true
from tracewell.operators.ordering import flag_smallest, global_rank
from tracewell.schema import KEY


def class_sizes(cases: DataFrame) -> tuple[int, int]:
    """(positives, negatives) among labelled rows."""
    row = cases.agg(
        count_true(F.col("label")).alias("p"), count_true(~F.col("label")).alias("n")
    ).head()
    return row["p"], row["n"]


def prevalence_plan(positives: int, negatives: int, target: float) -> tuple[int, int]:
    """How many of each class stay. Only the over-represented class is thinned."""
    if not 0.0 < target < 1.0:
        raise ValueError(f"target must be between 0 and 1, got {target}")
    if not positives or not negatives:
        return positives, negatives
    if positives / (positives + negatives) > target:
        keep = round(negatives * target / (1.0 - target))
        return min(positives, max(1, keep)), negatives
    keep = round(positives * (1.0 - target) / target)
    return positives, min(negatives, max(1, keep))


def _identity(cases: DataFrame, case: str | None):
    """What a row is drawn by: the given column, or else the whole key of a case."""
    return F.col(case) if case else F.concat_ws("|", *[k for k in KEY if k in cases.columns])


def downsample_to_prevalence(
    cases: DataFrame, target: float = fixed.TARGET_PREVALENCE, seed: int = 7,
    case: str | None = None,
) -> DataFrame:
    """Thin the over-represented class to the target rate; never duplicates.

    Unlabelled rows have no class and are left out.
    """
    if not 0.0 < target < 1.0:
        raise ValueError(f"target must be between 0 and 1, got {target}")
    keep_pos, keep_neg = prevalence_plan(*class_sizes(cases), target)
    hashed = cases.where(F.col("label").isNotNull()).withColumn(
        "_hash", C.seeded_hash(seed, _identity(cases, case))
    )
    return (
        flag_smallest(hashed, "_hash", {True: keep_pos, False: keep_neg}, "label", "_kept")
        .where("_kept")
        .drop("_hash", "_kept")
    )


def resample_summary(cases: DataFrame, kept: DataFrame, target: float) -> DataFrame:
    """What was kept and dropped, and the rate before and after."""
    known = lambda df, part: df.where(F.col("label").isNotNull()).select(
        "label", F.lit(part).alias("part")
    )
    before, after = F.col("part") == "before", F.col("part") == "after"
    label = F.col("label")
    return (
        known(cases, "before")
        .unionByName(known(kept, "after"))
        .agg(
            count_true(before).alias("n_before"),
            count_true(before & label).alias("p_before"),
            count_true(after).alias("kept"),
            count_true(after & label).alias("p_kept"),
        )
        .select(
            F.lit(float(target)).alias("target_rate"),
            "kept",
            (F.col("n_before") - F.col("kept")).alias("dropped"),
            F.coalesce(C.ratio(F.col("p_before"), F.col("n_before")), F.lit(0.0)).alias(
                "original_rate"
            ),
            F.coalesce(C.ratio(F.col("p_kept"), F.col("kept")), F.lit(0.0)).alias(
                "resulting_rate"
            ),
        )
    )


def split_plan(positives: int, negatives: int, test_size: float) -> tuple[int, int]:
    """Test rows per class: a rounded-up total shared out by largest remainder."""
    total = positives + negatives
    n_test = math.ceil(total * test_size)
    exact = positives * n_test / total
    pos = math.floor(exact)
    neg = math.floor(negatives * n_test / total)
    if pos + neg < n_test:
        if exact - pos >= 0.5:
            pos += 1
        else:
            neg += 1
    return pos, neg


def stratified_split(
    cases: DataFrame, test_size: float = 0.3, seed: int = 7, case: str | None = None
) -> DataFrame:
    """Adds is_test. At least 10 labelled rows and two classes are required."""
    positives, negatives = class_sizes(cases)
    if positives + negatives < 10:
        raise ValueError("need at least 10 labelled cases to fit and evaluate a model")
    if not positives or not negatives:
        raise ValueError("the labelled sample holds one class only")
    pos, neg = split_plan(positives, negatives, test_size)
    hashed = cases.where(F.col("label").isNotNull()).withColumn(
        "_hash", C.seeded_hash(seed, _identity(cases, case))
    )
    return flag_smallest(hashed, "_hash", {True: pos, False: neg}, "label", "is_test").drop("_hash")


def stratified_folds(
    cases: DataFrame, k: int, seed: int = 7, case: str | None = None, label: str = "label"
) -> DataFrame:
    """Adds fold 0..k-1: the row's hash rank within its class, modulo k."""
    hashed = cases.where(F.col(label).isNotNull()).withColumn(
        "_hash", C.seeded_hash(seed, _identity(cases, case))
    )
    ranked = global_rank(hashed, [F.col(label), F.col("_hash"), _identity(cases, case)], "_rank")
    # One row per class.
    starts = F.broadcast(
        ranked.groupBy(label).agg(F.min("_rank").alias("_start"))
    )
    return (
        ranked.join(starts, label)
        .withColumn("fold", ((F.col("_rank") - F.col("_start")) % k).cast("int"))
        .drop("_hash", "_rank", "_start")
    )
