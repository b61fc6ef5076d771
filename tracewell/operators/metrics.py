"""Model quality from scored, labelled rows. Rows without a label are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.cohort import count_true
from tracewell.operators.ordering import running_totals

WIDE = "decimal(38,0)"


def labelled(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("label").isNotNull() & F.col("score").isNotNull())


def ranking_quality(scored: DataFrame) -> DataFrame:
    """ROC AUC, average precision, their baseline and lift, and the Brier score.

    Rows collapse to one per distinct score before any ordering, so a score
    shared by most rows costs nothing. Average precision is the step form; ties
    share one step.
    """
    miss = F.pow(F.col("score") - F.col("label").cast("double"), F.lit(2))
    return _quality(labelled(scored).groupBy("score").agg(
        count_true(F.col("label")).alias("pos"),
        count_true(~F.col("label")).alias("neg"),
        F.sum(miss).alias("miss"),
    ))


def counted_ranking_quality(scored: DataFrame) -> DataFrame:
    """The same of rows that stand for several: a score, and how many positive and negative rows have it."""
    score, positive, negative = F.col("score"), F.col("positive"), F.col("negative")
    miss = positive * F.pow(score - 1, F.lit(2)) + negative * F.pow(score, F.lit(2))
    return _quality(scored.where(score.isNotNull()).groupBy("score").agg(
        F.sum(positive).cast("bigint").alias("pos"), F.sum(negative).cast("bigint").alias("neg"), F.sum(miss).alias("miss"),
    ))


def _quality(per_score: DataFrame) -> DataFrame:
    """per_score: pos, neg and miss of each distinct score."""
    stepped = running_totals(per_score, [F.desc("score")], {"pos_upto": "pos", "neg_upto": "neg"})
    pos, neg = F.col("pos").cast(WIDE), F.col("neg").cast(WIDE)
    beaten_twice = pos * (2 * F.col("neg_upto").cast(WIDE) - neg)
    found = F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    totals = stepped.agg(
        F.coalesce(F.max("pos_upto"), F.lit(0)).alias("positives"),
        F.coalesce(F.max("neg_upto"), F.lit(0)).alias("negatives"),
        F.sum(beaten_twice).cast("double").alias("lost"),
        F.sum(F.col("pos") * found).alias("steps"),
        F.sum("miss").alias("miss"),
    )
    p, n = F.col("positives"), F.col("negatives")
    both = (p > 0) & (n > 0)
    precision = F.when(both, C.ratio(F.col("steps"), p))
    baseline = C.ratio(p, p + n)
    return totals.select(
        (p + n).alias("cases"),
        "positives",
        F.when(both, 1 - C.ratio(F.col("lost"), 2 * p.cast("double") * n)).alias("roc_auc"),
        precision.alias("average_precision"),
        baseline.alias("pr_baseline"),
        C.ratio(precision, baseline).alias("pr_lift"),
        C.ratio(F.col("miss"), p + n).alias("brier"),
    )


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; zero where undefined."""
    zero = F.lit(0.0)
    return (
        F.coalesce(C.ratio(tp, tp + fp), zero),
        F.coalesce(C.ratio(tp, tp + fn), zero),
        F.coalesce(C.ratio(2 * tp, 2 * tp + fp + fn), zero),
    )


def confusion(scored: DataFrame, threshold: float = fixed.FLAG_THRESHOLD) -> DataFrame:
    flagged, label = F.col("score") >= threshold, F.col("label")
    counts = labelled(scored).agg(
        count_true(~flagged & ~label).alias("tn"),
        count_true(flagged & ~label).alias("fp"),
        count_true(~flagged & label).alias("fn"),
        count_true(flagged & label).alias("tp"),
    )
    precision, recall, f1 = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(
        "tn", "fp", "fn", "tp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def threshold_sweep(scored: DataFrame, cuts: list[float] = fixed.SWEEP_CUTS) -> DataFrame:
    """Precision, recall, F1 and flagged count at each cut, all in one pass."""
    score, label = F.col("score"), F.col("label")
    counts = labelled(scored).agg(
        count_true(label).alias("positives"),
        *[count_true(score >= c).alias(f"flagged_{i}") for i, c in enumerate(cuts)],
        *[count_true((score >= c) & label).alias(f"tp_{i}") for i, c in enumerate(cuts)],
    )
    rows = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("threshold"),
                        F.col(f"flagged_{i}").alias("flagged"),
                        F.col(f"tp_{i}").alias("tp"),
                        F.col("positives").alias("positives"),
                    )
                    for i, c in enumerate(cuts)
                ]
            )
        )
    )
    tp = F.col("tp")
    precision, recall, f1 = _rates(tp, F.col("flagged") - tp, F.col("positives") - tp)
    return rows.select(
        "threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "flagged"
    )


def capacity_table(
    ranked_top: DataFrame, scored: DataFrame, capacities: list[int] = fixed.REVIEW_CAPACITIES
) -> DataFrame:
    """Precision and caught positives when only the top k are reviewed.

    ranked_top: the first max(capacities) rows of the queue with their `rank`.
    Capacities larger than the cohort are left out.
    """
    label = F.coalesce(F.col("label"), F.lit(False))
    top = ranked_top.agg(
        F.coalesce(F.max("rank"), F.lit(0)).alias("reached"),
        *[count_true((F.col("rank") <= k) & label).alias(f"top_{k}") for k in capacities],
    )
    total = scored.agg(count_true(label).alias("n")).scalar()
    rows = top.select(
        "reached",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("reviewing_top"), F.col(f"top_{k}").alias("caught"))
                    for k in capacities
                ]
            )
        ),
    ).where(F.col("reviewing_top") <= F.col("reached"))
    return rows.select(
        "reviewing_top",
        C.ratio(F.col("caught"), F.col("reviewing_top")).alias("precision"),
        "caught",
        total.alias("of_total"),
    )


def queue_yield(listed: DataFrame, scored: DataFrame) -> DataFrame:
    """Labelled cases on the list and in the whole queue, with their shares.

    Both shares use the population they were counted in.
    """
    label = F.coalesce(F.col("label"), F.lit(False))
    both = listed.select(label.alias("label"), F.lit(True).alias("listed")).unionByName(
        scored.select(label.alias("label"), F.lit(False).alias("listed"))
    )
    on_list = F.col("listed")
    return both.agg(
        count_true(on_list).alias("listed"),
        count_true(~on_list).alias("checked"),
        count_true(on_list & F.col("label")).alias("tagged_on_list"),
        count_true(~on_list & F.col("label")).alias("tagged_in_all"),
    ).select(
        "*",
        F.coalesce(C.ratio(F.col("tagged_on_list"), F.col("listed")), F.lit(0.0)).alias(
            "share_on_list"
        ),
        F.coalesce(C.ratio(F.col("tagged_in_all"), F.col("checked")), F.lit(0.0)).alias(
            "share_overall"
        ),
    )


def class_counts(predicted: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """The confusion matrix as rows (truth, pred, n)."""
    return predicted.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(
    predicted: DataFrame, classes: list[str] = fixed.FRAMING_CLASSES,
    truth: str = "truth", pred: str = "pred",
) -> DataFrame:
    """Precision, recall, F1 and support per class; one row per class."""
    t, p = F.col(truth), F.col(pred)
    counts = predicted.agg(
        *[
            agg
            for i, c in enumerate(classes)
            for agg in (
                count_true((t == c) & (p == c)).alias(f"tp_{i}"),
                count_true(t == c).alias(f"support_{i}"),
                count_true(p == c).alias(f"given_{i}"),
            )
        ]
    )
    rows = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("class"),
                        F.col(f"tp_{i}").alias("tp"),
                        F.col(f"given_{i}").alias("given"),
                        F.col(f"support_{i}").alias("support"),
                    )
                    for i, c in enumerate(classes)
                ]
            )
        )
    )
    tp = F.col("tp")
    precision, recall, f1 = _rates(tp, F.col("given") - tp, F.col("support") - tp)
    return rows.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def class_summary(
    predicted: DataFrame, classes: list[str] = fixed.FRAMING_CLASSES,
    truth: str = "truth", pred: str = "pred", fold: str | None = None,
) -> DataFrame:
    """Accuracy, macro F1 (over folds: mean and population deviation), majority baseline.

    As usual, a fold's macro F1 averages the classes seen in it.
    """
    folded = predicted if fold else predicted.withColumn("_fold", F.lit(0))
    fold = fold or "_fold"
    t, p = F.col(truth), F.col(pred)
    listed = F.array(*[F.lit(c) for c in classes])
    per_class = (
        folded.select(fold, F.explode(F.array_distinct(F.array(t, p))).alias("class"), t, p)
        .where(F.array_contains(listed, F.col("class")))
        .groupBy(fold, "class")
        .agg(
            count_true((t == p) & (t == F.col("class"))).alias("tp"),
            count_true((p == F.col("class")) & (t != p)).alias("fp"),
            count_true((t == F.col("class")) & (t != p)).alias("fn"),
        )
    )
    f1 = _rates(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    per_fold = per_class.groupBy(fold).agg(F.avg(f1).alias("macro_f1"))
    spread = per_fold.agg(
        F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std")
    )
    sizes = predicted.groupBy(truth).agg(
        F.count(F.lit(1)).alias("n"), count_true(t == p).alias("right")
    )
    return sizes.agg(
        F.sum("n").alias("n_samples"),
        C.ratio(F.sum("right"), F.sum("n")).alias("accuracy"),
        C.ratio(F.max("n"), F.sum("n")).alias("majority_baseline"),
    ).select(
        "*",
        spread.select("mean").scalar().alias("macro_f1_mean"),
        spread.select("std").scalar().alias("macro_f1_std"),
    )


def nth_rank(n: int, order: list[Column]):
    """Window for ranking a list that is already cut to n rows."""
    return F.row_number().over(Window.orderBy(*order))
