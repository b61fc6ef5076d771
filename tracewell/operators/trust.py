"""How far a ranking can be trusted: coverage, leakage, gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.cohort import count_true
from tracewell.operators.ordering import global_rank
from tracewell.schema import KEY


def trigger_coverage(features: DataFrame, labels: DataFrame, meanings: dict) -> DataFrame:
    """Per trigger: cases it fires on, share, label rate when fired, and lift.

    All counts come from one grouped pass over the wide rows; the long form is
    made from the single result row, not from every case. A null label counts
    towards cases but not towards rates.
    """
    return coverage_rates(coverage_counts(features, labels, list(meanings)), meanings)


def coverage_counts(features: DataFrame, labels: DataFrame, names: list[str], *by: str) -> DataFrame:
    """Counts per trigger (and per group of columns of labels), from which rates follow; they add up over groups."""
    wide = features.join(labels.select(*KEY, "label", *[c for c in by if c not in KEY]), KEY)
    label = F.col("label")
    known = label.isNotNull()
    counts = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        count_true(known).alias("labelled"),
        count_true(label).alias("positives"),
        *[count_true(F.col(n) > 0).alias(f"{n}__cases") for n in names],
        *[count_true((F.col(n) > 0) & known).alias(f"{n}__known") for n in names],
        *[count_true((F.col(n) > 0) & label).alias(f"{n}__hits") for n in names],
    )
    return counts.select(
        *by, "total", "labelled", "positives",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("trigger"),
                        F.col(f"{n}__cases").alias("cases"),
                        F.col(f"{n}__known").alias("known"),
                        F.col(f"{n}__hits").alias("hits"),
                    )
                    for n in names
                ]
            )
        ),
    )


def coverage_rates(counts: DataFrame, meanings: dict) -> DataFrame:
    pairs = [F.lit(x) for item in meanings.items() for x in item]
    rows = counts.withColumn("meaning", F.element_at(F.create_map(*pairs), F.col("trigger")))
    rate = C.ratio(F.col("hits"), F.col("known"))
    base = C.ratio(F.col("positives"), F.col("labelled"))
    return rows.select(
        "trigger", "meaning", "cases", F.col("known").alias("labelled_cases"),
        F.coalesce(C.ratio(F.col("cases"), F.col("total")), F.lit(0.0)).alias("share"),
        rate.alias("label_rate"),
        C.ratio(rate, base).alias("lift"),
        base.alias("base_rate"),
    )


def by_lift(coverage: DataFrame) -> DataFrame:
    return coverage.orderBy(F.desc_nulls_last("lift"), "trigger")


def dark_triggers(coverage: DataFrame) -> DataFrame:
    """Triggers this cohort can never fire."""
    return coverage.where(F.col("cases") == 0)


def weak_triggers(coverage: DataFrame, min_cases: int = fixed.WEAK_MIN_CASES) -> DataFrame:
    """Triggers that fire but point the wrong way."""
    return coverage.where((F.col("cases") >= min_cases) & (F.col("lift") < 1.0))


def leakage_by_feature(
    coverage: DataFrame,
    min_support: int = fixed.MIN_SUPPORT,
    tolerance: float = fixed.SEPARATION_TOLERANCE,
) -> DataFrame:
    """Separation of each trigger: its lift as a share of the ceiling 1 / base rate."""
    ceiling = C.ratio(F.lit(1.0), F.col("base_rate"))
    return (
        coverage.select(
            F.col("trigger").alias("feature"),
            F.col("labelled_cases").alias("support"),
            "label_rate", "lift", ceiling.alias("max_lift"),
        )
        .withColumn("separation", F.coalesce(C.ratio(F.col("lift"), F.col("max_lift")), F.lit(0.0)))
        .withColumn(
            "leaking", (F.col("support") >= min_support) & (F.col("separation") >= tolerance)
        )
        .withColumn("dead", F.col("support") == 0)
    )


def value_label_rates(
    events: DataFrame, labels: DataFrame, kinds: tuple = ("medication", "procedure")
) -> DataFrame:
    """Support and label rate of each raw event value, counted once per case."""
    value = C.strip(C.text_or_empty(F.col("value")))
    seen = (
        events.where(F.col("event_type").isin(*kinds))
        .select(*KEY, "event_type", value.alias("value"))
        .where(F.col("value") != "")
        .dropDuplicates([*KEY, "event_type", "value"])
    )
    known = labels.where(F.col("label").isNotNull()).select(*KEY, "label")
    return (
        seen.join(known, KEY)
        .groupBy("event_type", "value")
        .agg(F.count(F.lit(1)).alias("support"), count_true(F.col("label")).alias("positives"))
        .withColumn("label_rate", C.ratio(F.col("positives"), F.col("support")))
    )


def giveaway_values(
    rates: DataFrame,
    min_support: int = fixed.MIN_SUPPORT,
    purity: float = fixed.GIVEAWAY_PURITY,
) -> DataFrame:
    """Values that map onto the label almost one to one."""
    return rates.where((F.col("support") >= min_support) & (F.col("label_rate") >= purity))


def leakage_verdict(feature_audit: DataFrame, giveaways: DataFrame) -> DataFrame:
    """Clean when no feature separates perfectly and no value gives the label away."""
    found = feature_audit.select(
        F.lit("feature").alias("kind"), F.col("leaking"), F.col("dead")
    ).unionByName(
        giveaways.select(
            F.lit("value").alias("kind"), F.lit(True).alias("leaking"), F.lit(False).alias("dead")
        )
    )
    is_feature = F.col("kind") == "feature"
    return found.agg(
        count_true(is_feature & ~F.col("dead")).alias("features"),
        count_true(is_feature & F.col("leaking")).alias("leaking_features"),
        count_true(F.col("dead")).alias("dead_features"),
        count_true(~is_feature).alias("giveaway_values"),
    ).withColumn(
        "clean", (F.col("leaking_features") == 0) & (F.col("giveaway_values") == 0)
    )


def gain_curve(scored: DataFrame, order: list[Column], points: int = 40) -> DataFrame:
    """Share of positives found in the top x of the ranking, at points + 1 steps.

    Each row is ranked once and falls into the first step whose cut-off reaches
    it; the steps are then summed. Cut-offs round half to even.
    """
    spark = scored.sparkSession
    ranked = global_rank(scored.where(F.col("label").isNotNull()), order)
    totals = ranked.agg(F.count(F.lit(1)).alias("n"), count_true(F.col("label")).alias("p")).head()
    total, positives = totals["n"], totals["p"]
    if total == 0:
        return spark.createDataFrame(
            [(0, 0.0, 0.0), (points, 1.0, 1.0)], "step int, review_share double, harm_found double"
        )
    cutoffs = [round(step / points * total) for step in range(points + 1)]
    step = sum(((F.col("rank") > c).cast("int") for c in cutoffs), F.lit(0))
    found = ranked.groupBy(step.alias("step")).agg(count_true(F.col("label")).alias("hits"))
    # points + 1 rows from here on.
    steps = spark.createDataFrame(list(enumerate(cutoffs)), "step int, cutoff bigint")
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.col("cutoff") / F.lit(total) if positives else F.col("step") / F.lit(points)
    return (
        steps.join(found, "step", "left")
        .withColumn("seen", F.coalesce(F.sum("hits").over(upto), F.lit(0)))
        .select(
            "step",
            share.alias("review_share"),
            F.coalesce(C.ratio(F.col("seen"), F.lit(positives)), F.lit(0.0)).alias("harm_found"),
        )
    )


def random_curve(curve: DataFrame, points: int = 40) -> DataFrame:
    """The diagonal on the same steps."""
    x = F.col("step") / F.lit(points)
    return curve.select("step", x.alias("review_share"), x.alias("harm_found"))


def lift_at(curve: DataFrame, share: float) -> DataFrame:
    """Found share at the first step at or past `share`, and its multiple of random."""
    reached = F.col("review_share") >= share - 1e-9
    found = F.coalesce(
        F.min_by("harm_found", F.when(reached, F.col("step"))), F.lit(1.0)
    )
    multiple = found / share if share > 0 else F.lit(1.0)
    return curve.agg(found.alias("harm_found"), multiple.alias("lift_multiple"))
