"""Encounter warehouse (patients, encounters, observations, ...) to cases and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.cohort import label_by_names
from tracewell.operators.timeline import readmission_gaps

SOURCE = "encounters"


def _clean(name: str) -> Column:
    return C.strip(C.text_or_empty(F.col(name).cast("string")))


def _or(c: Column, default: str | Column) -> Column:
    return F.when(c == "", default).otherwise(c)


def timed_encounters(encounters: DataFrame) -> DataFrame:
    stays = encounters.select(
        F.col("Id").alias("encounter_id"), F.col("PATIENT").alias("patient_id"),
        F.col("START").cast("timestamp").alias("started"),
        F.col("STOP").cast("timestamp").alias("stopped"),
        _or(_clean("ENCOUNTERCLASS"), "inpatient").alias("encounter_class"),
        _or(_clean("DESCRIPTION"), "Encounter").alias("description"),
    )
    return readmission_gaps(
        stays, "patient_id", "encounter_id", "started", "stopped"
    ).where(F.col("started").isNotNull())


def encounter_cases(
    patients: DataFrame, stays: DataFrame, conditions: DataFrame,
    harms: list[str] = fixed.HARM_CONDITIONS,
) -> DataFrame:
    """Cases labelled by named conditions; unknown patients get age 0 and gender U."""
    people = patients.select(
        F.col("Id").alias("patient_id"), F.col("BIRTHDATE").cast("timestamp").alias("born"),
        _or(_clean("GENDER"), "U").alias("gender"),
    )
    harmed = label_by_names(
        conditions.select(F.col("ENCOUNTER").alias("encounter_id"),
                          F.col("DESCRIPTION").alias("name")),
        harms, "encounter_id",
    ).drop("names")
    years = F.coalesce(C.years_between(F.col("born"), F.col("started")), F.lit(0))
    return (
        stays.join(people, "patient_id", "left")
        .join(harmed, "encounter_id", "left")
        .select(
            F.lit(SOURCE).alias("source"),
            F.concat_ws("-", "patient_id", "encounter_id").alias("case_id"),
            "encounter_id",
            years.alias("age"),
            F.coalesce("gender", F.lit("U")).alias("gender"),
            F.coalesce("label", F.lit(False)).alias("label"),
            F.lit("condition_proxy").alias("label_source"),
            F.coalesce("scenario", "encounter_class").alias("scenario"),
        )
    )


def encounter_events(
    stays: DataFrame, observations: DataFrame, medications: DataFrame, procedures: DataFrame
) -> DataFrame:
    """Admission, lab, medication and procedure events of the known encounters."""
    gap = F.col("readmission_gap_days")
    plain = F.concat("encounter_class", F.lit(" admission. "), "description", F.lit("."))
    again = F.format_string(
        f"Readmission within {fixed.READMISSION_DAYS} days: %.1f days after the previous "
        "discharge. ", gap
    )
    admissions = stays.select(
        "encounter_id", F.lit("admission").alias("event_type"), F.col("started").alias("ts"),
        F.when(F.col("encounter_class") == "inpatient", "Inpatient admission")
        .otherwise(F.col("description")).alias("value"),
        F.when(gap.isNotNull(), F.concat(again, plain)).otherwise(plain).alias("details"),
    )

    def rows(df: DataFrame, kind: str, time: str, details: Column) -> DataFrame:
        return df.select(
            F.col("ENCOUNTER").alias("encounter_id"), F.lit(kind).alias("event_type"),
            F.col(time).cast("timestamp").alias("ts"), _clean("DESCRIPTION").alias("value"),
            details.alias("details"),
        ).where(F.col("ts").isNotNull())

    result = C.strip(F.concat_ws(" ", _clean("VALUE"), _clean("UNITS")))
    given = C.strip(F.concat(F.lit("Administered. "), _clean("REASONDESCRIPTION")))
    coded = _or(_clean("REASONDESCRIPTION"), "Coded procedure.")
    streams = (
        rows(observations, "lab", "DATE", result)
        .unionByName(rows(medications, "medication", "START", given))
        .unionByName(rows(procedures, "procedure", "START", coded))
    )
    return admissions.unionByName(
        streams.join(stays.select("encounter_id"), "encounter_id", "left_semi")
    )
