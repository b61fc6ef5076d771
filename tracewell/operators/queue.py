"""The review queue: order, capacity, cut-off, reviewed cases, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import fixed_values as fixed
from tracewell.operators.ordering import global_rank
from tracewell.schema import KEY

NEVER = "9999-12-31"

# A longer list is ranked by ranges.
TOP_ROWS = 10_000


def queue_order() -> list[Column]:
    """Score first, then oldest discharge, open stays last; ties end in the key."""
    return [
        F.desc("score"),
        F.coalesce(F.col("discharged_at"), F.lit(NEVER).cast("timestamp")).asc(),
        F.asc("source"),
        F.asc("case_id"),
    ]


def rankable(cases: DataFrame) -> DataFrame:
    """Only discharged stays are ranked."""
    return cases.where(F.col("discharged_at").isNotNull())


def without_reviewed(scored: DataFrame, reviews: DataFrame) -> DataFrame:
    return scored.join(reviews.select(*KEY).distinct(), KEY, "left_anti")


def reviewed_cases(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cases with at least one review."""
    return cases.join(reviews.select(*KEY), KEY, "left_semi")


def discharged_unscored(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Discharged cases no run of any model has scored, in no order."""
    return rankable(cases).join(scores.select(*KEY), KEY, "left_anti")


def oldest_first(pending: DataFrame) -> DataFrame:
    """For output: a global sort that no later step needs."""
    return pending.orderBy("discharged_at", *KEY)


def top_of_queue(scored: DataFrame, capacity: int) -> DataFrame:
    """The first `capacity` rows (at least one) with their rank.

    Each task keeps its own best rows; only those are merged, in one task up to TOP_ROWS
    rows. A longer list is ranked by ranges.
    """
    capacity = max(1, capacity)
    if capacity > TOP_ROWS:
        return global_rank(scored, queue_order(), "rank").where(F.col("rank") <= capacity)
    top = scored.orderBy(*queue_order()).limit(capacity)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*queue_order())).cast("bigint"))


def over_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def ranked_contributions(contributions: DataFrame, per_side: int = 8) -> DataFrame:
    """Per case the strongest raising and the strongest lowering contributions."""
    side = F.when(F.col("contribution") > 0, "raising").when(
        F.col("contribution") < 0, "lowering"
    )
    order = Window.partitionBy(*KEY, "side").orderBy(
        F.desc(F.abs("contribution")), F.asc("feature")
    )
    return (
        contributions.withColumn("side", side)
        .where(F.col("side").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_side)
    )


def first_evidence(evidence: DataFrame, n: int = 10) -> DataFrame:
    """The first n pieces of evidence per case, in reading order."""
    order = Window.partitionBy(*KEY).orderBy("section", "ts", "case_ordinal", "text")
    return evidence.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def first_findings(findings: DataFrame, n: int = 6) -> DataFrame:
    """Per case the n strongest findings, unanticipated framing first."""
    order = Window.partitionBy(*KEY).orderBy(
        (F.col("label") != "unanticipated").asc(), F.desc("probability"),
        F.asc("case_ordinal"), F.asc("position"),
    )
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def headline_reason(
    listed: DataFrame, evidence: DataFrame, contributions: DataFrame,
    meanings: dict = fixed.TRIGGER_MEANINGS,
) -> DataFrame:
    """Why a case is on the list: first evidence, else strongest raising feature."""
    first = first_evidence(evidence, 1).select(*KEY, F.col("text").alias("first_text"))
    raising = (
        ranked_contributions(contributions, 1)
        .where(F.col("side") == "raising")
        .select(*KEY, "feature")
    )
    pairs = [F.lit(x) for item in meanings.items() for x in item]
    described = F.coalesce(F.element_at(F.create_map(*pairs), F.col("feature")), F.col("feature"))
    return (
        listed.join(first, KEY, "left")
        .join(raising, KEY, "left")
        .withColumn("reason", F.coalesce("first_text", described, F.lit(fixed.DEFAULT_REASON)))
        .drop("first_text", "feature")
    )
