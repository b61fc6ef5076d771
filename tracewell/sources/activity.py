"""The events table read as clinical timelines.

One case per user and week. Each activity row becomes one clinical event: its
type sets the kind, and its `k` and value pick the wording. The same rules are
given as Spark columns and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.sqltext import sql_list
from tracewell.session import table

SOURCE = "activity"
KINDS = {
    "signup": "admission",
    "click": "procedure",
    "view": "lab",
    "purchase": "medication",
    "error": "transfer",
}
LABS = ["Hemoglobin", "Creatinine", "Hemoglobin", "Creatinine", "hgb", "Lactate", "Potassium",
        "WBC ", "INR", "Glucose", "Platelets", "ALT", "Sodium"]
DRUGS = ["Naloxone 0.4 MG/ML Injectable Solution", "Acetaminophen", "Vitamin K", "Ondansetron",
         "Packed Red Blood Cells (PRBC)", "Phytonadione 10 MG/ML Injectable Solution",
         "Furosemide", "Dextrose 50% Injectable Solution", "Cefazolin 1g", "Hydromorphone",
         "Flumazenil 0.1 MG/ML Injectable Solution", "Calcium gluconate 10% IV Solution",
         "Heparin"]
UNITS = ["MICU", "Med/Surg", "Coronary Care Unit (CCU)", "Neuro Stepdown", "Telemetry",
         "Surgical Intensive Care Unit (SICU)", "Emergency Department"]
MOVES = ["Unplanned escalation to intensive care from Med/Surg.",
         "Planned or direct admission to intensive care from PACU.",
         "Rapid response called overnight.", ""]
PROCEDURES = ["Reopening of recent laparotomy site to control hemorrhage", "Appendectomy",
              "Colonoscopy", "Unplanned return to surgery", "Transfusion of platelets",
              "Intravenous catheter insertion", "Washout of wound"]
PROCEDURE_NOTES = ["Coded procedure.", "Emergent case in the operating room.", "Elective."]
ARRIVALS = ["EW EMER. admission.",
            "Readmission within 30 days: 3.5 days after the previous discharge.",
            "ELECTIVE admission.", "OBSERVATION admission."]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    return table(spark, folder, "events").select(
        F.lit(SOURCE).alias("source"),
        F.concat(F.col("user_id").cast("string"), F.lit("-w"), week.cast("string")).alias("case_id"),
        "user_id",
        F.col("event_id").alias("case_ordinal"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("amount"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )


def activity_events(spark: SparkSession, folder: str) -> DataFrame:
    k, amount = F.col("k"), F.col("amount")
    kind = F.col("event_type")
    shown = amount.cast("string")
    result = F.when(k % 10 == 0, F.concat(F.lit("<"), shown)).otherwise(
        F.concat(shown, F.lit(" mg/dL"))
    )
    whole = F.floor(amount)
    mapped = F.create_map(*[F.lit(x) for item in KINDS.items() for x in item])
    return (
        _rows(spark, folder)
        .withColumn("event_type", F.element_at(mapped, F.col("activity")))
        .select(
            "source", "case_id", "case_ordinal", "event_id", "event_type", "ts",
            F.when(kind == "lab", _pick(LABS, k))
            .when(kind == "medication", _pick(DRUGS, k))
            .when(kind == "transfer", _pick(UNITS, k))
            .when(kind == "procedure", _pick(PROCEDURES, k))
            .otherwise("Inpatient admission")
            .alias("value"),
            F.when(kind == "lab", result)
            .when(kind == "medication", "Administered.")
            .when(kind == "transfer", _pick(MOVES, whole))
            .when(kind == "procedure", _pick(PROCEDURE_NOTES, whole))
            .otherwise(_pick(ARRIVALS, k))
            .alias("details"),
        )
    )


def activity_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    activity, ts = F.col("activity"), F.col("ts")
    return (
        rows.groupBy("source", "case_id")
        .agg(
            F.min("user_id").alias("user_id"),
            F.min("case_ordinal").alias("source_ordinal"),
            F.max(F.when(activity == "signup", 1)).alias("adjudicated"),
            F.max(F.when(F.col("k") >= 99, 1).otherwise(0)).alias("hit"),
            F.max(F.when(activity.isin("purchase", "view"), ts)).alias("discharged_at"),
            F.max("activity").alias("top_activity"),
        )
        .select(
            "source", "case_id", "source_ordinal",
            (F.col("user_id") % 70 + 20).cast("int").alias("age"),
            F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("gender"),
            F.when(F.col("adjudicated") == 1, F.col("hit") == 1).alias("label"),
            F.lit("activity_mark").alias("label_source"),
            F.col("top_activity").alias("scenario"),
            "discharged_at",
        )
    )


def _sql_pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[({index}) % {len(values)} + 1]"


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"

ACTIVITY_SQL = f"""
activity AS (
  SELECT '{SOURCE}' AS source,
         user_id::VARCHAR || '-w' || (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::VARCHAR
           AS case_id,
         user_id, event_id AS case_ordinal, event_id::VARCHAR AS event_id,
         event_type AS activity, {_KIND} AS event_type, ts, value AS amount,
         regexp_extract(props, '(\\d+)', 1)::INTEGER AS k
  FROM events),
a_events AS (
  SELECT source, case_id, case_ordinal, event_id, event_type, ts,
         CASE event_type
           WHEN 'lab' THEN {_sql_pick(LABS, 'k')}
           WHEN 'medication' THEN {_sql_pick(DRUGS, 'k')}
           WHEN 'transfer' THEN {_sql_pick(UNITS, 'k')}
           WHEN 'procedure' THEN {_sql_pick(PROCEDURES, 'k')}
           ELSE 'Inpatient admission' END AS value,
         CASE event_type
           WHEN 'lab' THEN CASE WHEN k % 10 = 0 THEN '<' || amount::VARCHAR
                                ELSE amount::VARCHAR || ' mg/dL' END
           WHEN 'medication' THEN 'Administered.'
           WHEN 'transfer' THEN {_sql_pick(MOVES, 'floor(amount)::BIGINT')}
           WHEN 'procedure' THEN {_sql_pick(PROCEDURE_NOTES, 'floor(amount)::BIGINT')}
           ELSE {_sql_pick(ARRIVALS, 'k')} END AS details
  FROM activity),
a_cases AS (
  SELECT source, case_id, min(case_ordinal) AS source_ordinal,
         (min(user_id) % 70 + 20)::INTEGER AS age,
         CASE WHEN min(user_id) % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         CASE WHEN bool_or(activity = 'signup') THEN bool_or(k >= 99) END AS label,
         'activity_mark' AS label_source, max(activity) AS scenario,
         max(ts) FILTER (WHERE activity IN ('purchase', 'view')) AS discharged_at
  FROM activity GROUP BY source, case_id)
"""
