"""Registered queries: raw sources to cases and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.catalog.common import plain
from tracewell.catalog.registry import query
from tracewell.catalog.sqltext import quoted, sql_any, sql_iso
from tracewell.functions import fixed_values as fixed
from tracewell.functions.columns import contains_any
from tracewell.operators import cohort
from tracewell.session import table
from tracewell.sources import admissions as A
from tracewell.sources import encounters as E
from tracewell.sources import hospital as H
from tracewell.sources.activity import ACTIVITY_SQL, activity_cases, activity_events
from tracewell.sources.raw_extracts import (
    ADMISSION_SQL,
    ENCOUNTER_SQL,
    GIVEN_DRUGS,
    HOSPITAL_SQL,
    LAB_ITEMS,
    admission_tables,
    encounter_tables,
    hospital_tables,
    sql_pick,
)
from tracewell.sources.scored_orders import SCORED_SQL, scored_orders

EVENT_COLUMNS = f"event_type, {sql_iso('ts')} AS ts, value, details"


# --- hospital extract -------------------------------------------------------------
@query(
    "hospital_mapped_stays",
    """SELECT o_orderkey::VARCHAR AS encounter_id,
      CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE (o_custkey % 60 + 20)::VARCHAR END AS age,
      CASE WHEN o_custkey % 2 = 0 THEN ' F' ELSE 'M' END AS sex,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS admitted,
      CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%dT%H:%M:%S')
        ELSE '' END AS discharged FROM orders""",
)
def hospital_mapped_stays(spark, folder):
    return H.map_columns(hospital_tables(spark, folder)["stays"], "stays")


@query(
    "hospital_cases",
    f"WITH {HOSPITAL_SQL} SELECT case_id, age, gender, {sql_iso('admitted_at')} AS admitted_at, "
    f"{sql_iso('discharged_at')} AS discharged_at FROM h_cases",
)
def hospital_cases(spark, folder):
    cases = H.conform(hospital_tables(spark, folder))[0]
    return plain(cases.select("case_id", "age", "gender", "admitted_at", "discharged_at"))


@query("hospital_events", f"WITH {HOSPITAL_SQL} SELECT case_id, event_id, {EVENT_COLUMNS} FROM h_events")
def hospital_events(spark, folder):
    return plain(H.conform(hospital_tables(spark, folder))[1].drop("source"))


@query(
    "hospital_event_ordinals",
    f"WITH {HOSPITAL_SQL} SELECT case_id, event_id, row_number() OVER (PARTITION BY case_id "
    "ORDER BY ts, event_type, event_id) - 1 AS case_ordinal FROM h_events",
)
def hospital_event_ordinals(spark, folder):
    events = H.conform(hospital_tables(spark, folder))[1]
    return H.with_case_ordinals(events).select("case_id", "event_id", "case_ordinal")


# --- admission dataset --------------------------------------------------------------
GAPS_SQL = f"""{ADMISSION_SQL},
m_lagged AS (SELECT *, lag(dischtime) OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS previous_discharge
  FROM m_admissions),
m_stays AS (SELECT *, CASE WHEN (epoch_us(admittime) - epoch_us(previous_discharge)) / 86400e6 BETWEEN 0 AND 30
  THEN (epoch_us(admittime) - epoch_us(previous_discharge)) / 86400e6 END AS readmission_gap_days FROM m_lagged)"""
_ICU = lambda c: f"coalesce({sql_any(f'lower({c})', fixed.ICU_UNIT_TERMS)}, false)"
_ROUTE = lambda c: f"coalesce({sql_any(f'lower({c})', fixed.PLANNED_ROUTE_TERMS)}, false)"
LABELS_SQL = f"""m_labels AS (SELECT hadm_id, bool_or(
    (icd_version = 10 AND regexp_matches(upper(trim(icd_code)), {quoted(fixed.COMPLICATION_CODES[10])}))
    OR (icd_version = 9 AND regexp_matches(upper(trim(icd_code)), {quoted(fixed.COMPLICATION_CODES[9])}))) AS label
  FROM m_diagnoses GROUP BY hadm_id)"""
ADMIT_EVENT = """SELECT hadm_id, 'admission' AS event_type, admittime AS ts, 'Inpatient admission' AS value,
  CASE WHEN readmission_gap_days IS NOT NULL THEN 'Readmission within 30 days: ' ||
    printf('%.1f', readmission_gap_days) || ' days after the previous discharge. ' ELSE '' END
  || admission_type || ' admission.' AS details FROM m_stays"""
TRANSFER_EVENT = f"""SELECT hadm_id, 'transfer' AS event_type, intime AS ts, careunit AS value,
  CASE WHEN previous_unit IS NULL OR eventtype = 'admit' OR {_ROUTE('previous_unit')} OR {_ICU('previous_unit')}
    THEN 'Planned or direct admission' ELSE 'Unplanned escalation' END || ' to intensive care from '
  || coalesce(previous_unit, 'direct') || '.' AS details
  FROM (SELECT *, lag(careunit) OVER (PARTITION BY hadm_id ORDER BY intime, eventtype, careunit NULLS FIRST)
    AS previous_unit FROM m_transfers) WHERE {_ICU('careunit')}"""
_LAB_NAME = "CASE label " + " ".join(
    f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in fixed.LAB_LABELS.items()
) + " END"
LAB_EVENT = f"""SELECT hadm_id, 'lab' AS event_type, charttime AS ts, {_LAB_NAME} AS value,
  format('{{:g}}', valuenum) AS details FROM m_labevents JOIN m_labitems USING (itemid)
  WHERE valuenum IS NOT NULL AND {_LAB_NAME} IS NOT NULL"""
MED_EVENT = """SELECT hadm_id, 'medication' AS event_type, charttime AS ts, medication AS value,
  'Administered (' || event_txt || ').' AS details FROM m_emar WHERE medication IS NOT NULL
  AND event_txt IN ('Administered', 'Administered in Other Location', 'Started')"""
BLOOD_EVENT = f"""SELECT hadm_id, 'medication' AS event_type, starttime AS ts, label AS value,
  'Transfused ' || CASE WHEN amount IS NULL THEN 'amount not recorded' ELSE format('{{:g}}', amount) || ' mL' END
  || '.' AS details FROM m_inputs JOIN m_items USING (itemid) WHERE category = '{fixed.BLOOD_CATEGORY}'
  AND NOT {sql_any('lower(label)', fixed.BLOOD_EXCLUDED_TERMS)}"""
PROCEDURE_EVENT = """SELECT hadm_id, 'procedure' AS event_type, date_trunc('day', chartdate) + INTERVAL 12 HOUR AS ts,
  coalesce(long_title, 'ICD-' || icd_version || ' ' || icd_code) AS value,
  'Coded procedure, date only (ICD-' || icd_version || ' ' || icd_code || ').' AS details
  FROM m_procedures LEFT JOIN m_titles USING (icd_code, icd_version)"""


def _shown(part: str) -> str:
    return (f"WITH {GAPS_SQL}, ev AS ({part}) SELECT hadm_id, {EVENT_COLUMNS} FROM ev")


@query(
    "readmission_gaps",
    f"WITH {GAPS_SQL} SELECT hadm_id, {sql_iso('previous_discharge')} AS previous_discharge, "
    "readmission_gap_days FROM m_stays",
)
def readmission_gaps(spark, folder):
    stays = A.admission_stays(admission_tables(spark, folder)["admissions"])
    return plain(stays.select("hadm_id", "previous_discharge", "readmission_gap_days"))


@query("labels_by_code", f"WITH {ADMISSION_SQL}, {LABELS_SQL} SELECT * FROM m_labels")
def labels_by_code(spark, folder):
    return cohort.label_by_codes(
        admission_tables(spark, folder)["diagnoses"], fixed.COMPLICATION_CODES
    )


@query(
    "admission_cases",
    f"""WITH {ADMISSION_SQL}, {LABELS_SQL} SELECT subject_id::VARCHAR || '-' || hadm_id::VARCHAR AS case_id,
      (c_nationkey + 20)::INTEGER AS age, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
      coalesce(label, false) AS label, admission_type AS scenario
    FROM m_admissions JOIN customer ON c_custkey = subject_id LEFT JOIN m_labels USING (hadm_id)""",
)
def admission_cases(spark, folder):
    t = admission_tables(spark, folder)
    cases = A.admission_cases(t["patients"], A.admission_stays(t["admissions"]), t["diagnoses"])
    return cases.select("case_id", "age", "gender", "label", "scenario")


@query("admission_arrivals", _shown(ADMIT_EVENT))
def admission_arrivals(spark, folder):
    t = admission_tables(spark, folder)
    return plain(A.admission_events(A.admission_stays(t["admissions"])))


@query("admission_transfers", _shown(TRANSFER_EVENT))
def admission_transfers(spark, folder):
    return plain(A.transfer_events(admission_tables(spark, folder)["transfers"]))


@query("admission_labs", _shown(LAB_EVENT))
def admission_labs(spark, folder):
    t = admission_tables(spark, folder)
    return plain(A.lab_events(t["labevents"], t["labitems"]))


@query("admission_medications", _shown(MED_EVENT))
def admission_medications(spark, folder):
    return plain(A.medication_events(admission_tables(spark, folder)["emar"]))


@query("admission_blood_products", _shown(BLOOD_EVENT))
def admission_blood_products(spark, folder):
    t = admission_tables(spark, folder)
    return plain(A.blood_events(t["inputs"], t["items"]))


@query("admission_procedures", _shown(PROCEDURE_EVENT))
def admission_procedures(spark, folder):
    t = admission_tables(spark, folder)
    return plain(A.procedure_events(t["procedures"], t["titles"]))


@query(
    "admission_timeline",
    f"""WITH {GAPS_SQL}, ev AS ({' UNION ALL '.join(
        f'({p})' for p in (ADMIT_EVENT, TRANSFER_EVENT, LAB_EVENT, MED_EVENT, BLOOD_EVENT, PROCEDURE_EVENT))})
    SELECT hadm_id, event_type, count(*) AS events, {sql_iso('min(ts)')} AS first_at,
      {sql_iso('max(ts)')} AS last_at FROM ev WHERE hadm_id IN (SELECT hadm_id FROM m_stays) GROUP BY hadm_id, event_type""",
)
def admission_timeline(spark, folder):
    t = admission_tables(spark, folder)
    stays = A.admission_stays(t["admissions"])
    streams = A.one_timeline(
        A.admission_events(stays),
        A.transfer_events(t["transfers"]),
        A.lab_events(t["labevents"], t["labitems"]),
        A.medication_events(t["emar"]),
        A.blood_events(t["inputs"], t["items"]),
        A.procedure_events(t["procedures"], t["titles"]),
    )
    return plain(
        cohort.rows_of_cases(streams, t["admissions"], ["hadm_id"])
        .groupBy("hadm_id", "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_at"),
             F.max("ts").alias("last_at"))
    )


@query(
    "unplanned_escalations",
    f"WITH {ADMISSION_SQL}, ev AS ({TRANSFER_EVENT}) SELECT count(DISTINCT hadm_id) AS admissions "
    "FROM ev WHERE details LIKE 'Unplanned%'",
)
def unplanned_escalations(spark, folder):
    moves = A.transfer_events(admission_tables(spark, folder)["transfers"])
    unplanned = moves.where(F.col("details").startswith("Unplanned"))
    return unplanned.select("hadm_id").distinct().agg(F.count(F.lit(1)).alias("admissions"))


# --- encounter warehouse ---------------------------------------------------------------
@query(
    "encounter_cases",
    f"""WITH {ENCOUNTER_SQL} SELECT s.patient_id || '-' || s.encounter_id AS case_id,
      coalesce(greatest(0, floor((date_diff('day', born, started::DATE)) / 365.25)), 0)::INTEGER AS age,
      coalesce(gender, 'U') AS gender, first_name IS NOT NULL AS label,
      coalesce(first_name, encounter_class) AS scenario
    FROM e_gaps s LEFT JOIN e_people USING (patient_id) LEFT JOIN e_harm USING (encounter_id)""",
)
def encounter_cases(spark, folder):
    t = encounter_tables(spark, folder)
    cases = E.encounter_cases(t["patients"], E.timed_encounters(t["encounters"]), t["conditions"])
    return cases.select("case_id", "age", "gender", "label", "scenario")


@query(
    "labels_by_condition",
    f"""WITH {ENCOUNTER_SQL} SELECT encounter_id, array_to_string(list_sort(list_distinct(list(name))), '|') AS names
    FROM e_conditions WHERE list_contains([{', '.join(quoted(c) for c in fixed.HARM_CONDITIONS)}], name)
    GROUP BY encounter_id""",
)
def labels_by_condition(spark, folder):
    conditions = encounter_tables(spark, folder)["conditions"].select(
        F.col("ENCOUNTER").alias("encounter_id"), F.col("DESCRIPTION").alias("name")
    )
    named = cohort.label_by_names(conditions, fixed.HARM_CONDITIONS, "encounter_id")
    return named.select("encounter_id", F.array_join("names", "|").alias("names"))


def _encounter_event_sql() -> str:
    line = "'e' || l_orderkey::VARCHAR AS encounter_id"
    return f"""WITH {ENCOUNTER_SQL}, ev AS (
      SELECT encounter_id, 'admission' AS event_type, started AS ts,
        CASE WHEN encounter_class = 'inpatient' THEN 'Inpatient admission' ELSE description END AS value,
        CASE WHEN gap IS NOT NULL THEN 'Readmission within 30 days: ' || printf('%.1f', gap) ||
          ' days after the previous discharge. ' ELSE '' END || encounter_class || ' admission. ' || description || '.' AS details
      FROM e_gaps
      UNION ALL SELECT {line}, 'lab', l_shipdate, {sql_pick(LAB_ITEMS, 'l_linenumber')},
        l_quantity::VARCHAR || CASE WHEN l_linenumber % 2 = 0 THEN ' mg/dL' ELSE '' END
      FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT {line}, 'medication', l_shipdate, coalesce({sql_pick(GIVEN_DRUGS, 'l_partkey')}, ''),
        'Administered.' || CASE WHEN l_linenumber % 2 = 0 THEN ' Pain' ELSE '' END
      FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT {line}, 'procedure', l_shipdate, {sql_pick(fixed.SIGNATURE_PROCEDURES, 'l_partkey')},
        CASE WHEN l_linenumber % 2 = 0 THEN 'Bleeding' ELSE 'Coded procedure.' END
      FROM lineitem WHERE l_returnflag = 'N')
    SELECT encounter_id, {EVENT_COLUMNS} FROM ev WHERE encounter_id IN (SELECT encounter_id FROM e_stays)"""


@query("encounter_events", _encounter_event_sql())
def encounter_events(spark, folder):
    t = encounter_tables(spark, folder)
    stays = E.timed_encounters(t["encounters"])
    return plain(
        E.encounter_events(stays, t["observations"], t["medications"], t["procedures"])
    )


# --- raw reports ---------------------------------------------------------------------------
@query(
    "flagged_admission_share",
    f"""WITH {ADMISSION_SQL}, {LABELS_SQL} SELECT count(*) AS total, count_if(label)::BIGINT AS flagged,
      round(100 * count_if(label)::DOUBLE / count(*), 1) AS pct FROM m_labels""",
)
def flagged_admission_share(spark, folder):
    labels = cohort.label_by_codes(
        admission_tables(spark, folder)["diagnoses"], fixed.COMPLICATION_CODES
    )
    return cohort.distinct_share(labels, "hadm_id", F.col("label"))


@query(
    "antidotes_given",
    f"""WITH {ADMISSION_SQL} SELECT medication, count(*) AS n, count(DISTINCT hadm_id) AS admissions FROM m_emar
    WHERE event_txt IN ('Administered', 'Administered in Other Location', 'Started')
      AND {sql_any('lower(medication)', [*fixed.SPECIFIC_ANTIDOTES, *fixed.CONTEXT_REVERSAL_AGENTS])} GROUP BY medication""",
)
def antidotes_given(spark, folder):
    terms = [*fixed.SPECIFIC_ANTIDOTES, *fixed.CONTEXT_REVERSAL_AGENTS]
    given = admission_tables(spark, folder)["emar"].where(
        F.col("event_txt").isin(fixed.GIVEN_STATUSES)
        & contains_any(F.lower("medication"), terms)
    )
    return cohort.top_values(
        given, "medication", None, F.count_distinct("hadm_id").alias("admissions")
    )


@query(
    "reoperation_titles",
    f"""WITH {ADMISSION_SQL} SELECT long_title, count(*) AS occurrences FROM m_procedures
    JOIN m_titles USING (icd_code, icd_version) WHERE contains(long_title, 'Reopening of')
      OR contains(long_title, 'Control Bleeding') GROUP BY long_title""",
)
def reoperation_titles(spark, folder):
    t = admission_tables(spark, folder)
    titled = t["procedures"].join(t["titles"], ["icd_code", "icd_version"])
    return cohort.matching_titles(titled, "long_title", ["Reopening of", "Control Bleeding"])


@query(
    "longest_stays",
    f"""WITH {ADMISSION_SQL} SELECT hadm_id, date_diff('hour', admittime, dischtime) / 24.0::DOUBLE AS los_days
    FROM m_admissions ORDER BY los_days DESC, hadm_id LIMIT 5""",
)
def longest_stays(spark, folder):
    stays = admission_tables(spark, folder)["admissions"].select(
        "hadm_id", F.col("admittime").cast("timestamp").alias("admittime"), "dischtime"
    )
    return cohort.longest_stays(stays, "admittime", "dischtime", "hadm_id").select(
        "hadm_id", "los_days"
    )


@query(
    "top_part_names",
    "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 20",
)
def top_part_names(spark, folder):
    return cohort.top_values(table(spark, folder, "part"), "p_name", 20)


@query(
    "distinct_values",
    """SELECT 'l_suppkey' AS column_name, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem
    UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
    UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem""",
)
def distinct_values(spark, folder):
    return cohort.distinct_values(
        table(spark, folder, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey"
    )


@query(
    "joined_lab_labels",
    f"""WITH {ADMISSION_SQL} SELECT label, count(*) AS n, count(valuenum) AS n_valued FROM m_labevents
    LEFT JOIN m_labitems USING (itemid) GROUP BY label""",
)
def joined_lab_labels(spark, folder):
    t = admission_tables(spark, folder)
    return (
        t["labevents"].join(t["labitems"], "itemid", "left").groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.count("valuenum").alias("n_valued"))
    )


_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "table_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _NAMES),
)
def table_counts(spark, folder):
    return cohort.table_counts({n: table(spark, folder, n) for n in _NAMES})


@query(
    "namespace_counts",
    """SELECT 'sales' AS namespace, 2::BIGINT AS n_tables,
      ((SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem))::BIGINT AS n_rows
    UNION ALL SELECT 'text', 2, ((SELECT count(*) FROM documents) + (SELECT count(*) FROM pages))::BIGINT""",
)
def namespace_counts(spark, folder):
    names = ["sales.orders", "sales.lineitem", "text.documents", "text.pages"]
    return cohort.namespace_counts(
        {n: table(spark, folder, n.split(".")[1]) for n in names}
    )


@query(
    "stay_census",
    f"""WITH {HOSPITAL_SQL} SELECT source, count(*) AS total, count_if(discharged_at IS NULL)::BIGINT AS in_house,
      count_if(discharged_at IS NOT NULL)::BIGINT AS discharged FROM h_cases GROUP BY source""",
)
def stay_census(spark, folder):
    return cohort.stay_census(H.conform(hospital_tables(spark, folder))[0])


@query(
    "cases_per_source",
    "SELECT source, count(*) AS cases FROM documents GROUP BY source",
)
def cases_per_source(spark, folder):
    return cohort.source_counts(table(spark, folder, "documents"))


@query(
    "cohort_summary",
    f"""WITH {ACTIVITY_SQL}, c AS (SELECT count(*) AS cases, count(label) AS labelled, count_if(label) AS positives FROM a_cases),
    e AS (SELECT count(*) AS events, count_if(event_type = 'note') AS notes FROM a_events)
    SELECT cases, events, notes::BIGINT AS notes, labelled, positives::BIGINT AS positives,
      events::DOUBLE / cases AS events_per_case, positives::DOUBLE / labelled AS label_rate FROM c, e""",
)
def cohort_summary(spark, folder):
    return cohort.cohort_summary(activity_cases(spark, folder), activity_events(spark, folder))


@query(
    "group_profile",
    f"""WITH {SCORED_SQL} SELECT scenario, count(*) AS cases, round(avg(score), 6) AS mean_score,
      round(avg(label::INT), 6) AS label_rate FROM scored GROUP BY scenario""",
)
def group_profile(spark, folder):
    profile = cohort.group_profile(scored_orders(spark, folder), "scenario")
    return profile.select(
        "scenario", "cases", F.round("mean_score", 6).alias("mean_score"),
        F.round("label_rate", 6).alias("label_rate"),
    )
