"""Trigger features and evidence from each case's ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.ordering import lag_within
from tracewell.schema import KEY

ANCHORS = ("procedure", "admission")
FEATURES = list(fixed.TRIGGER_MEANINGS)


def _check_anchor(anchor: str) -> None:
    if anchor not in ANCHORS:
        raise ValueError(f"anchor must be one of {ANCHORS}, got {anchor!r}")


def draw_order() -> Column:
    """(ts, case_ordinal) as one number.

    A fixed-width ordering keeps min_by in the hash aggregate; a struct would
    force a sort of all events first.
    """
    return F.unix_micros("ts").cast("decimal(18,0)") * F.lit(10**15).cast("decimal(16,0)") + F.col(
        "case_ordinal"
    ).cast("decimal(15,0)")


def event_signals(events: DataFrame, lab_rules: dict = fixed.LAB_RULES) -> DataFrame:
    """Per event: what it says on its own, before any comparison with the anchor."""
    kind = F.col("event_type")
    name = F.lower(C.text_or_empty(F.col("value")))
    text = F.lower(
        F.concat(C.text_or_empty(F.col("value")), F.lit(" "), C.text_or_empty(F.col("details")))
    )
    medication, procedure = kind == "medication", kind == "procedure"
    transfer, lab = kind == "transfer", kind == "lab"

    specific = medication & C.contains_any(name, fixed.SPECIFIC_ANTIDOTES)
    context = medication & ~specific & C.contains_any(name, fixed.CONTEXT_REVERSAL_AGENTS)
    transfusion = (medication | procedure) & C.contains_any(text, fixed.BLOOD_PRODUCT_TERMS)
    planned = F.replace(text, F.lit("unplanned"), F.lit("")).contains("planned")
    escalation = transfer & C.contains_any(name, fixed.ESCALATION_UNIT_TERMS) & ~planned
    rapid = (transfer | (kind == "note")) & C.contains_any(text, fixed.RAPID_RESPONSE_TERMS)
    reoperation = procedure & returned_to_theatre(text)
    readmission = (kind == "admission") & text.contains("readmission")

    lab_name = F.when(lab, C.lookup(C.strip(name), {n: n for n in lab_rules}))

    return events.select(
        *KEY,
        kind.alias("event_type"),
        "ts",
        "case_ordinal",
        lab_name.alias("lab_name"),
        F.when(lab, F.col("value")).alias("lab_spelling"),
        F.when(lab, C.numeric_prefix(F.col("details"))).alias("lab_number"),
        F.when(specific, F.col("ts")).alias("antidote_at"),
        context.cast("int").alias("context"),
        transfusion.cast("int").alias("transfusion"),
        escalation.cast("int").alias("escalation"),
        rapid.cast("int").alias("rapid"),
        reoperation.cast("int").alias("reoperation"),
        readmission.cast("int").alias("readmission"),
    ).withColumns(
        {c: F.when(F.col("lab_name").isNotNull(), F.col(c)) for c in ("lab_spelling", "lab_number")}
    ).withColumn(
        "abnormal", C.lab_flag(F.col("lab_name"), F.col("lab_number"), lab_rules, 1)
    ).withColumn(
        "critical", C.lab_flag(F.col("lab_name"), F.col("lab_number"), lab_rules, 2)
    )


def returned_to_theatre(text: Column) -> Column:
    """A coded reoperation, or prose that names both a place and a lack of plan."""
    return C.contains_any(text, fixed.REOPERATION_TERMS) | (
        C.contains_any(text, fixed.OPERATING_PLACE_TERMS)
        & C.contains_any(text, fixed.UNPLANNED_TERMS)
    )


def _anchor_mins() -> list[Column]:
    kind, ts = F.col("event_type"), F.col("ts")
    return [
        F.min(F.when(kind == "admission", ts)).alias("first_admission"),
        F.min(F.when(kind == "procedure", ts)).alias("first_procedure"),
        F.min(F.when(kind.isin("procedure", "medication"), ts)).alias("first_treatment"),
    ]


def _anchor(anchor: str) -> Column:
    found = F.coalesce("first_procedure", "first_treatment")
    return F.coalesce(F.col("first_admission"), found) if anchor == "admission" else found


def treatment_anchor(events: DataFrame, anchor: str = "procedure") -> DataFrame:
    """When care began, per case; null when nothing marks it."""
    _check_anchor(anchor)
    return (
        events.groupBy(*KEY).agg(*_anchor_mins()).select(*KEY, _anchor(anchor).alias("anchor_at"))
    )


def trigger_features(
    events: DataFrame,
    cases: DataFrame | None = None,
    anchor: str = "procedure",
    lab_rules: dict = fixed.LAB_RULES,
) -> DataFrame:
    """The fourteen trigger features, one row per case.

    "After the anchor" needs no join back to the events: an event of a kind
    lies after the anchor exactly when the latest event of that kind does. So
    two grouped passes suffice, both with map-side partial aggregation: first
    per case and lab spelling, then per case. A case that holds a third of all
    events reaches its reducer as a few rows.
    """
    _check_anchor(anchor)
    ts, number, order = F.col("ts"), F.col("lab_number"), F.col("draw_order")
    per_lab = (
        event_signals(events, lab_rules)
        .withColumn("draw_order", F.when(number.isNotNull(), draw_order()))
        .groupBy(*KEY, "lab_spelling", "lab_name")
        .agg(
            *_anchor_mins(),
            F.max("antidote_at").alias("antidote_at"),
            F.max("context").alias("context"),
            F.max("transfusion").alias("transfusion"),
            F.sum("escalation").alias("escalations"),
            F.max("rapid").alias("rapid"),
            F.max("reoperation").alias("reoperation"),
            F.max("readmission").alias("readmission"),
            F.max(F.when(F.col("abnormal"), ts)).alias("abnormal_at"),
            F.max(F.when(F.col("critical"), ts)).alias("critical_at"),
            F.min_by(number, order).alias("base"),
            F.min(order).alias("base_order"),
            F.min(number).alias("lowest"),
            F.max(number).alias("highest"),
        )
    )

    def of(lab: str, column: str) -> Column:
        return F.when(F.col("lab_name") == lab, F.col(column))

    per_case = per_lab.groupBy(*KEY).agg(
        F.min("first_admission").alias("first_admission"),
        F.min("first_procedure").alias("first_procedure"),
        F.min("first_treatment").alias("first_treatment"),
        F.max("antidote_at").alias("antidote_at"),
        F.max("context").alias("context"),
        F.max("transfusion").alias("transfusion"),
        F.sum("escalations").alias("escalations"),
        F.max("rapid").alias("rapid"),
        F.max("reoperation").alias("reoperation"),
        F.max("readmission").alias("readmission"),
        F.max("critical_at").alias("critical_at"),
        # One entry per spelling of a dozen lab names.
        F.collect_list("abnormal_at").alias("abnormal_ats"),
        *[
            agg
            for lab in ("hemoglobin", "hgb", "creatinine")
            for agg in (
                F.min_by(of(lab, "base"), of(lab, "base_order")).alias(f"{lab}_base"),
                F.min(of(lab, "lowest")).alias(f"{lab}_low"),
                F.max(of(lab, "highest")).alias(f"{lab}_high"),
            )
        ],
    ).withColumn("anchor_at", _anchor(anchor))

    start = F.col("anchor_at")
    after = lambda t: t.isNotNull() & (start.isNull() | (t > start))
    abnormal_types = F.size(F.filter("abnormal_ats", after))
    drop, rise = trend_changes()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    antidote = F.col("antidote_at")

    features = per_case.select(
        *KEY,
        flag(antidote.isNotNull()).alias("antidote_given"),
        flag(antidote > start).alias("antidote_after_treatment_start"),
        flag(F.col("context") == 1).alias("context_dependent_reversal_agent"),
        flag(F.col("escalations") >= 1).alias("unplanned_icu_transfer"),
        flag(F.col("escalations") >= 2).alias("repeat_icu_escalation"),
        flag(F.col("reoperation") == 1).alias("unplanned_return_to_or"),
        flag(F.col("readmission") == 1).alias("readmission_30d"),
        flag(F.col("rapid") == 1).alias("rapid_response_called"),
        flag(F.col("transfusion") == 1).alias("transfusion_given"),
        flag(abnormal_types > 0).alias("abnormal_post_treatment_lab"),
        flag(after(F.col("critical_at"))).alias("critical_post_treatment_lab"),
        flag(drop >= fixed.HEMOGLOBIN_DROP).alias("hemoglobin_drop"),
        flag(rise >= fixed.CREATININE_RATIO).alias("creatinine_doubled"),
        abnormal_types.cast("double").alias("abnormal_lab_types_count"),
    )
    if cases is None:
        return features
    return cases.select(*KEY).join(features, KEY, "left").fillna(0.0, FEATURES)


def trend_changes() -> tuple[Column, Column]:
    """Largest fall of hemoglobin and rise of creatinine against the first draw.

    The first draw is part of the extreme, which changes nothing at cut-offs
    above "no change". Series hgb counts only where hemoglobin was never drawn.
    """
    drop = F.coalesce(
        F.col("hemoglobin_base") - F.col("hemoglobin_low"), F.col("hgb_base") - F.col("hgb_low")
    )
    rise = F.when(
        F.col("creatinine_base") > 0, F.col("creatinine_high") / F.col("creatinine_base")
    )
    return drop, rise


def lab_trends(events: DataFrame) -> DataFrame:
    """First draw, extremes and change per case, over all draws of the three series."""
    number = C.numeric_prefix(F.col("details"))
    lab = C.strip(F.lower(C.text_or_empty(F.col("value"))))
    draws = (
        events.where(F.col("event_type") == "lab")
        .select(*KEY, "ts", "case_ordinal", lab.alias("lab"), number.alias("number"))
        .where(F.col("lab").isin("hemoglobin", "hgb", "creatinine"))
        .where(F.col("number").isNotNull())
        .withColumn("draw_order", draw_order())
    )
    of = lambda lab, c: F.when(F.col("lab") == lab, F.col(c))
    per_case = draws.groupBy(*KEY).agg(
        *[
            agg
            for lab in ("hemoglobin", "hgb", "creatinine")
            for agg in (
                F.min_by(of(lab, "number"), of(lab, "draw_order")).alias(f"{lab}_base"),
                F.min(of(lab, "number")).alias(f"{lab}_low"),
                F.max(of(lab, "number")).alias(f"{lab}_high"),
            )
        ]
    )
    drop, rise = trend_changes()
    return per_case.withColumn("hemoglobin_fall", drop).withColumn("creatinine_rise", rise)


def with_anchor(
    events: DataFrame, anchor: str = "procedure", all_events: DataFrame | None = None
) -> DataFrame:
    """Events with their case's anchor. all_events: where the anchor is found,
    when `events` is already a selection."""
    anchors = treatment_anchor(events if all_events is None else all_events, anchor)
    return events.join(anchors, KEY, "left")


def timed_labs(
    events: DataFrame, anchor: str = "procedure", lab_rules: dict = fixed.LAB_RULES
) -> DataFrame:
    """Each known lab draw with its flags and whether it lies after the anchor."""
    _check_anchor(anchor)
    draws = (
        event_signals(events, lab_rules)
        .where(F.col("lab_name").isNotNull() & F.col("lab_number").isNotNull())
        .select(*KEY, "ts", "case_ordinal", "lab_spelling", "lab_name", "lab_number",
                "abnormal", "critical")
    )
    after = F.col("anchor_at").isNull() | (F.col("ts") > F.col("anchor_at"))
    return with_anchor(draws, anchor, events).withColumn("after_anchor", after)


def trigger_evidence(
    events: DataFrame,
    anchor: str = "procedure",
    lab_rules: dict = fixed.LAB_RULES,
) -> DataFrame:
    """One row per piece of evidence: what fired, when, with its values.

    `section` orders the rows of a case as a reviewer reads them: events, then
    labs after the anchor, then trends.
    """
    _check_anchor(anchor)
    value, details = C.text_or_empty(F.col("value")), C.text_or_empty(F.col("details"))
    text = F.concat(value, F.lit(" "), details)
    reasons = {**fixed.SPECIFIC_ANTIDOTES, **fixed.CONTEXT_REVERSAL_AGENTS}

    kind = F.col("event_type")
    reoperation = C.mentions(text, fixed.REOPERATION_TERMS) | (
        C.mentions(text, fixed.OPERATING_PLACE_TERMS) & C.mentions(text, fixed.UNPLANNED_TERMS)
    )
    telling = (
        ((kind == "medication") & C.mentions(value, reasons))
        | ((kind == "transfer") & C.mentions(value, fixed.ESCALATION_UNIT_TERMS))
        | ((kind == "procedure") & reoperation)
        | ((kind == "admission") & C.mentions(text, ["readmission"]))
    )
    drug = F.when(kind == "medication", C.first_match(F.lower(value), reasons))
    shown = (
        events.where(telling)
        .withColumn("drug", drug)
        .join(treatment_anchor(events, anchor), KEY, "left")
    )
    timing = F.when(F.col("ts") > F.col("anchor_at"), "after treatment began").otherwise(
        "on arrival, before our treatment"
    )
    tier = F.when(F.col("drug").isin(list(fixed.SPECIFIC_ANTIDOTES)), "Antidote").otherwise(
        "Reversal agent"
    )
    from_events = shown.select(
        *KEY,
        F.lit(0).alias("section"),
        "ts",
        "case_ordinal",
        kind.alias("trigger"),
        F.when(
            F.col("drug").isNotNull(),
            F.concat(tier, F.lit(" **"), F.initcap("drug"), F.lit("** given "), timing,
                     F.lit(" ("), C.lookup(F.col("drug"), reasons), F.lit(")")),
        )
        .when(kind == "transfer", F.concat(F.lit("Transfer to "), value, F.lit(": "), details))
        .when(
            kind == "procedure",
            F.concat(F.lit("Unplanned OR return: "), value, F.lit(" — "), details),
        )
        .otherwise(F.concat(value, F.lit(": "), details))
        .alias("text"),
    )

    marker = F.when(F.col("critical"), "critical").otherwise("abnormal")
    from_labs = (
        timed_labs(events, anchor, lab_rules)
        .where(F.col("abnormal") & F.col("after_anchor"))
        .select(
            *KEY,
            F.lit(1).alias("section"),
            "ts",
            "case_ordinal",
            F.lit("lab").alias("trigger"),
            F.concat(
                F.lit("Post-treatment "), F.col("lab_spelling"), F.lit(" = "),
                C.general_number(F.col("lab_number")), F.lit(" ("), marker, F.lit(")"),
            ).alias("text"),
        )
    )

    trends = lab_trends(events)
    never = F.lit(None).cast("timestamp")
    fall, rise = F.col("hemoglobin_fall"), F.col("creatinine_rise")
    one_decimal = lambda c: F.format_string("%.1f", c)
    from_trends = trends.select(
        *KEY,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        fall >= fixed.HEMOGLOBIN_DROP,
                        F.struct(
                            F.lit(2).alias("section"),
                            F.lit("hemoglobin_drop").alias("trigger"),
                            F.concat(F.lit("Hemoglobin dropped "), one_decimal(fall),
                                     F.lit(" g/dL between draws")).alias("text"),
                        ),
                    ),
                    F.when(
                        rise >= fixed.CREATININE_RATIO,
                        F.struct(
                            F.lit(3).alias("section"),
                            F.lit("creatinine_doubled").alias("trigger"),
                            F.concat(F.lit("Creatinine rose "), one_decimal(rise),
                                     F.lit("x from baseline")).alias("text"),
                        ),
                    ),
                )
            )
        ).alias("t"),
    ).select(
        *KEY, "t.section", never.alias("ts"), F.lit(None).cast("bigint").alias("case_ordinal"),
        "t.trigger", "t.text",
    )
    return from_events.unionByName(from_labs).unionByName(from_trends)


def last_events(events: DataFrame, n: int = 12) -> DataFrame:
    """The last n events of each timeline.

    The row_number filter becomes a group limit before the shuffle, so a very
    long timeline sends at most n rows per task.
    """
    newest = Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("case_ordinal"))
    return events.withColumn("from_end", F.row_number().over(newest)).where(
        F.col("from_end") <= n
    )


def events_of_type(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds))


def readmission_gaps(
    stays: DataFrame,
    patient: str = "patient_id",
    stay: str = "case_id",
    admitted: str = "admitted_at",
    discharged: str = "discharged_at",
    window_days: int = fixed.READMISSION_DAYS,
) -> DataFrame:
    """Adds the previous discharge and the gap in days where it is 0..window_days."""
    order = [F.col(admitted).asc_nulls_last(), F.col(stay)]
    gap = C.days_between(F.col("previous_discharge"), F.col(admitted))
    return lag_within(
        stays, [patient], order, {"previous_discharge": discharged}
    ).withColumn("readmission_gap_days", F.when(gap.between(0, window_days), gap))


def with_waiting(cases: DataFrame, now: Column, stale_days: int = fixed.STALE_DAYS) -> DataFrame:
    days = C.waiting_days(F.col("discharged_at"), now)
    return cases.withColumn("waiting_days", days).withColumn(
        "stale", F.coalesce(F.col("waiting_days") >= stale_days, F.lit(False))
    )
