"""Admission dataset (patients, admissions, transfers, labs, ...) to cases and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.cohort import label_by_codes, with_labels
from tracewell.operators.ordering import lag_within
from tracewell.operators.timeline import readmission_gaps

SOURCE = "admissions"


def _event(kind: str, ts: Column, value: Column, details: Column) -> list[Column]:
    return [
        F.col("hadm_id"), F.lit(kind).alias("event_type"), ts.cast("timestamp").alias("ts"),
        value.cast("string").alias("value"), details.cast("string").alias("details"),
    ]


def is_icu(unit: Column) -> Column:
    return F.coalesce(C.contains_any(F.lower(unit), fixed.ICU_UNIT_TERMS), F.lit(False))


def on_planned_route(unit: Column) -> Column:
    return F.coalesce(C.contains_any(F.lower(unit), fixed.PLANNED_ROUTE_TERMS), F.lit(False))


def admission_stays(admissions: DataFrame) -> DataFrame:
    """Admissions with the gap since the patient's previous discharge."""
    stays = admissions.withColumn("admittime", F.col("admittime").cast("timestamp")).withColumn(
        "dischtime", F.col("dischtime").cast("timestamp")
    )
    return readmission_gaps(stays, "subject_id", "hadm_id", "admittime", "dischtime")


def admission_cases(patients: DataFrame, stays: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """One case per admission, labelled by its complication codes.

    An admission of an unknown patient is an error.
    """
    case_id = F.concat_ws("-", F.col("subject_id").cast("string"), F.col("hadm_id").cast("string"))
    labels = label_by_codes(diagnoses, fixed.COMPLICATION_CODES)
    people = patients.withColumn("_known", F.lit(True))
    checked = F.when(F.col("_known"), F.col("anchor_age").cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unknown patient of "), case_id)).cast("int")
    )
    return with_labels(stays.join(people, "subject_id", "left"), labels, "hadm_id").select(
        F.lit(SOURCE).alias("source"),
        case_id.alias("case_id"),
        "hadm_id",
        checked.alias("age"),
        F.col("gender").cast("string").alias("gender"),
        "label",
        F.lit("icd_complication_proxy").alias("label_source"),
        F.col("admission_type").cast("string").alias("scenario"),
    )


def admission_events(stays: DataFrame) -> DataFrame:
    plain = F.concat(F.col("admission_type").cast("string"), F.lit(" admission."))
    gap = F.col("readmission_gap_days")
    again = F.format_string(
        f"Readmission within {fixed.READMISSION_DAYS} days: %.1f days after the previous "
        "discharge. ", gap
    )
    return stays.where(F.col("admittime").isNotNull()).select(
        *_event("admission", F.col("admittime"), F.lit("Inpatient admission"),
                F.when(gap.isNotNull(), F.concat(again, plain)).otherwise(plain))
    )


def transfer_events(transfers: DataFrame) -> DataFrame:
    """Moves into intensive care, planned or not judged by the unit before."""
    timed = transfers.withColumn("intime", F.col("intime").cast("timestamp"))
    ordered = lag_within(
        timed, ["hadm_id"],
        [F.col("intime").asc_nulls_last(), F.col("eventtype"), F.col("careunit")],
        {"previous_unit": "careunit"},
    )
    previous = F.col("previous_unit")
    planned = (
        previous.isNull()
        | (F.col("eventtype") == "admit")
        | on_planned_route(previous)
        | is_icu(previous)
    )
    origin = F.coalesce(previous, F.lit("direct"))
    details = F.when(
        planned,
        F.concat(F.lit("Planned or direct admission to intensive care from "), origin, F.lit(".")),
    ).otherwise(F.concat(F.lit("Unplanned escalation to intensive care from "), origin, F.lit(".")))
    return ordered.where(is_icu(F.col("careunit")) & F.col("intime").isNotNull()).select(
        *_event("transfer", F.col("intime"), F.col("careunit"), details)
    )


def lab_events(labevents: DataFrame, labitems: DataFrame, names: dict = fixed.LAB_LABELS) -> DataFrame:
    """Draws of the labs that have a canonical name; missing results are dropped.

    Only the item rows with a known label are kept, at most a few ids per label.
    """
    wanted = labitems.select("itemid", C.lookup(F.col("label"), names).alias("lab")).where(
        F.col("lab").isNotNull()
    )
    return (
        labevents.where(F.col("valuenum").isNotNull() & F.col("charttime").isNotNull())
        .join(wanted, "itemid")
        .select(*_event("lab", F.col("charttime"), F.col("lab"),
                        C.general_number(F.col("valuenum").cast("double"))))
    )


def medication_events(emar: DataFrame) -> DataFrame:
    """Only what was given to the patient."""
    given = emar.where(
        F.col("event_txt").isin(fixed.GIVEN_STATUSES)
        & F.col("medication").isNotNull()
        & F.col("charttime").isNotNull()
    )
    return given.select(
        *_event("medication", F.col("charttime"), F.col("medication"),
                F.concat(F.lit("Administered ("), F.col("event_txt"), F.lit(").")))
    )


def blood_events(inputs: DataFrame, items: DataFrame) -> DataFrame:
    """Blood products by item category, without consent and autologous items."""
    name = F.lower(C.text_or_empty(F.col("label")))
    products = items.where(
        (F.col("category") == fixed.BLOOD_CATEGORY)
        & ~C.contains_any(name, fixed.BLOOD_EXCLUDED_TERMS)
    ).select("itemid", "label")
    amount = F.when(
        F.col("amount").isNotNull(),
        F.concat(C.general_number(F.col("amount").cast("double")), F.lit(" "),
                 C.text_or_empty(F.col("amountuom"))),
    ).otherwise("amount not recorded")
    return (
        inputs.where(F.col("starttime").isNotNull())
        .join(products, "itemid")
        .select(*_event("medication", F.col("starttime"), F.col("label"),
                        F.concat(F.lit("Transfused "), amount, F.lit("."))))
    )


def procedure_events(procedures: DataFrame, titles: DataFrame) -> DataFrame:
    """Coded procedures with titles; a date without a time is read as midday."""
    code = F.concat(F.lit("ICD-"), F.col("icd_version").cast("string"), F.lit(" "), F.col("icd_code"))
    midday = F.to_date("chartdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    return (
        procedures.where(F.col("chartdate").isNotNull())
        .join(titles, ["icd_code", "icd_version"], "left")
        .select(*_event("procedure", midday, F.coalesce(F.col("long_title"), code),
                        F.concat(F.lit("Coded procedure, date only ("), code, F.lit(")."))))
    )


def one_timeline(*streams: DataFrame) -> DataFrame:
    """The typed event streams as one table."""
    return reduce(DataFrame.unionByName, streams)
