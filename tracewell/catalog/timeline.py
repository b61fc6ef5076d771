"""Registered queries: anchors, triggers, labs, evidence, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.catalog.common import plain
from tracewell.catalog.registry import query
from tracewell.catalog.sqltext import quoted, sql_any, sql_iso
from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators import timeline as T
from tracewell.sources.activity import ACTIVITY_SQL, activity_cases, activity_events

NUMBER_SQL = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def sql_number(column: str) -> str:
    token = f"regexp_split_to_array(regexp_replace({column}, '^\\s+|\\s+$', '', 'g'), '\\s+')[1]"
    return (
        f"CASE WHEN regexp_matches({token}, '{NUMBER_SQL}') "
        f"THEN TRY_CAST(replace({token}, '_', '') AS DOUBLE) END"
    )


def sql_lab_flag(cut: int) -> str:
    arms = " ".join(
        f"WHEN {quoted(lab)} THEN lab_number {'<' if rule[0] == 'low' else '>'} {rule[cut]}::DOUBLE"
        for lab, rule in fixed.LAB_RULES.items()
    )
    return f"coalesce(CASE lab_name {arms} END, false)"


LABS_IN = "(" + ", ".join(quoted(x) for x in fixed.LAB_RULES) + ")"
RETURNED = (
    f"({sql_any('txt', fixed.REOPERATION_TERMS)} OR "
    f"({sql_any('txt', fixed.OPERATING_PLACE_TERMS)} AND {sql_any('txt', fixed.UNPLANNED_TERMS)}))"
)

SIGNALS_SQL = f"""{ACTIVITY_SQL},
worded AS (
  SELECT *, lower(value) AS nm, lower(value || ' ' || details) AS txt,
         {sql_number('details')} AS parsed,
         regexp_replace(lower(value), '^\\s+|\\s+$', '', 'g') AS trimmed
  FROM a_events),
labelled AS (
  SELECT *,
    CASE WHEN event_type = 'lab' AND trimmed IN {LABS_IN} THEN trimmed END AS lab_name,
    CASE WHEN event_type = 'lab' AND trimmed IN {LABS_IN} THEN parsed END AS lab_number,
    event_type = 'medication' AND {sql_any('nm', fixed.SPECIFIC_ANTIDOTES)} AS specific,
    event_type IN ('medication', 'procedure') AND {sql_any('txt', fixed.BLOOD_PRODUCT_TERMS)} AS blood,
    event_type = 'transfer' AND {sql_any('nm', fixed.ESCALATION_UNIT_TERMS)}
      AND NOT contains(replace(txt, 'unplanned', ''), 'planned') AS escalation,
    event_type IN ('transfer', 'note') AND {sql_any('txt', fixed.RAPID_RESPONSE_TERMS)} AS rapid,
    event_type = 'procedure' AND {RETURNED} AS returned,
    event_type = 'admission' AND contains(txt, 'readmission') AS readmitted
  FROM worded),
signals AS (
  SELECT *, {sql_lab_flag(1)} AS abnormal, {sql_lab_flag(2)} AS critical,
    event_type = 'medication' AND NOT specific AND {sql_any('nm', fixed.CONTEXT_REVERSAL_AGENTS)} AS context
  FROM labelled),
mins AS (
  SELECT source, case_id,
    min(ts) FILTER (WHERE event_type = 'admission') AS first_admission,
    min(ts) FILTER (WHERE event_type = 'procedure') AS first_procedure,
    min(ts) FILTER (WHERE event_type IN ('procedure', 'medication')) AS first_treatment
  FROM signals GROUP BY ALL),
anchors AS (
  SELECT source, case_id,
    coalesce(first_procedure, first_treatment) AS by_procedure,
    coalesce(first_admission, first_procedure, first_treatment) AS by_admission FROM mins),
draws AS (
  SELECT source, case_id, lab_name, lab_number,
    first_value(lab_number) OVER (PARTITION BY source, case_id, lab_name ORDER BY ts, case_ordinal) AS base
  FROM signals WHERE lab_number IS NOT NULL),
trends AS (
  SELECT source, case_id,
    max(base) FILTER (WHERE lab_name = 'hemoglobin') AS hemoglobin_base,
    min(lab_number) FILTER (WHERE lab_name = 'hemoglobin') AS hemoglobin_low,
    max(lab_number) FILTER (WHERE lab_name = 'hemoglobin') AS hemoglobin_high,
    max(base) FILTER (WHERE lab_name = 'hgb') AS hgb_base,
    min(lab_number) FILTER (WHERE lab_name = 'hgb') AS hgb_low,
    max(lab_number) FILTER (WHERE lab_name = 'hgb') AS hgb_high,
    max(base) FILTER (WHERE lab_name = 'creatinine') AS creatinine_base,
    min(lab_number) FILTER (WHERE lab_name = 'creatinine') AS creatinine_low,
    max(lab_number) FILTER (WHERE lab_name = 'creatinine') AS creatinine_high
  FROM draws GROUP BY ALL),
changes AS (
  SELECT *, coalesce(hemoglobin_base - hemoglobin_low, hgb_base - hgb_low) AS hemoglobin_fall,
    CASE WHEN creatinine_base > 0 THEN creatinine_high / creatinine_base END AS creatinine_rise
  FROM trends)
"""


def features_sql(anchor: str, name: str = "features") -> str:
    return f"""{name} AS (
  SELECT s.source, s.case_id,
    max(specific)::INT::DOUBLE AS antidote_given,
    max(coalesce(specific AND ts > {anchor}, false))::INT::DOUBLE AS antidote_after_treatment_start,
    max(context)::INT::DOUBLE AS context_dependent_reversal_agent,
    (count_if(escalation) >= 1)::INT::DOUBLE AS unplanned_icu_transfer,
    (count_if(escalation) >= 2)::INT::DOUBLE AS repeat_icu_escalation,
    max(returned)::INT::DOUBLE AS unplanned_return_to_or,
    max(readmitted)::INT::DOUBLE AS readmission_30d,
    max(rapid)::INT::DOUBLE AS rapid_response_called,
    max(blood)::INT::DOUBLE AS transfusion_given,
    max(abnormal AND ({anchor} IS NULL OR ts > {anchor}))::INT::DOUBLE AS abnormal_post_treatment_lab,
    max(critical AND ({anchor} IS NULL OR ts > {anchor}))::INT::DOUBLE AS critical_post_treatment_lab,
    coalesce(max(hemoglobin_fall) >= 2, false)::INT::DOUBLE AS hemoglobin_drop,
    coalesce(max(creatinine_rise) >= 2, false)::INT::DOUBLE AS creatinine_doubled,
    count(DISTINCT CASE WHEN abnormal AND ({anchor} IS NULL OR ts > {anchor}) THEN value END)::DOUBLE
      AS abnormal_lab_types_count
  FROM signals s JOIN anchors a ON s.source = a.source AND s.case_id = a.case_id
  LEFT JOIN changes c ON c.source = s.source AND c.case_id = s.case_id
  GROUP BY s.source, s.case_id)"""


@query(
    "timeline_signals",
    f"WITH {SIGNALS_SQL} SELECT case_id, case_ordinal, specific, context, blood, escalation, rapid, "
    "returned, readmitted, lab_name, lab_number, abnormal, critical FROM signals",
)
def timeline_signals(spark, folder):
    flag = lambda c: (F.col(c) == 1)
    return T.event_signals(activity_events(spark, folder)).select(
        "case_id", "case_ordinal", F.col("antidote_at").isNotNull().alias("specific"),
        flag("context").alias("context"), flag("transfusion").alias("blood"),
        flag("escalation").alias("escalation"), flag("rapid").alias("rapid"),
        flag("reoperation").alias("returned"), flag("readmission").alias("readmitted"),
        "lab_name", "lab_number", "abnormal", "critical",
    )


@query(
    "treatment_anchor",
    f"WITH {SIGNALS_SQL} SELECT case_id, {sql_iso('by_procedure')} AS by_procedure, "
    f"{sql_iso('by_admission')} AS by_admission FROM anchors",
)
def treatment_anchor(spark, folder):
    events = activity_events(spark, folder)
    return plain(
        T.treatment_anchor(events, "procedure").withColumnRenamed("anchor_at", "by_procedure")
        .join(
            T.treatment_anchor(events, "admission").withColumnRenamed("anchor_at", "by_admission"),
            ["source", "case_id"],
        ).drop("source")
    )


@query("trigger_features",
       f"WITH {SIGNALS_SQL}, {features_sql('a.by_procedure')} SELECT * FROM features")
def trigger_features(spark, folder):
    return T.trigger_features(activity_events(spark, folder))


@query("trigger_features_from_admission",
       f"WITH {SIGNALS_SQL}, {features_sql('a.by_admission')} SELECT * FROM features")
def trigger_features_from_admission(spark, folder):
    return T.trigger_features(
        activity_events(spark, folder), activity_cases(spark, folder), anchor="admission"
    )


@query(
    "labs_after_anchor",
    f"WITH {SIGNALS_SQL} SELECT s.case_id, case_ordinal, value AS lab_spelling, lab_number, abnormal, "
    "critical, (by_procedure IS NULL OR ts > by_procedure) AS after_anchor "
    "FROM signals s JOIN anchors a USING (source, case_id) WHERE lab_number IS NOT NULL",
)
def labs_after_anchor(spark, folder):
    return T.timed_labs(activity_events(spark, folder)).select(
        "case_id", "case_ordinal", "lab_spelling", "lab_number", "abnormal", "critical",
        "after_anchor",
    )


@query(
    "lab_trends",
    f"WITH {SIGNALS_SQL} SELECT * EXCLUDE (source) FROM changes "
    "WHERE coalesce(hemoglobin_base, hgb_base, creatinine_base) IS NOT NULL",
)
def lab_trends(spark, folder):
    return T.lab_trends(activity_events(spark, folder)).drop("source")


REASONS = {**fixed.SPECIFIC_ANTIDOTES, **fixed.CONTEXT_REVERSAL_AGENTS}
_FIRST_DRUG = "CASE " + " ".join(
    f"WHEN contains(nm, {quoted(d)}) THEN {quoted(d)}" for d in REASONS
) + " END"
_DRUG_TITLE = "CASE drug " + " ".join(
    f"WHEN {quoted(d)} THEN {quoted(d.title())}" for d in REASONS
) + " END"
_DRUG_REASON = "CASE drug " + " ".join(
    f"WHEN {quoted(d)} THEN {quoted(r)}" for d, r in REASONS.items()
) + " END"
_IS_SPECIFIC = "drug IN (" + ", ".join(quoted(d) for d in fixed.SPECIFIC_ANTIDOTES) + ")"

EVIDENCE_PART = f"""marked AS (
  SELECT s.*, a.by_admission, CASE WHEN event_type = 'medication' THEN {_FIRST_DRUG} END AS drug,
    event_type = 'transfer' AND {sql_any('nm', fixed.ESCALATION_UNIT_TERMS)} AS moved
  FROM signals s JOIN anchors a USING (source, case_id)),
evidence AS (
  SELECT source, case_id, 0 AS section, ts, case_ordinal, event_type AS trigger,
    CASE WHEN drug IS NOT NULL THEN
      CASE WHEN {_IS_SPECIFIC} THEN 'Antidote' ELSE 'Reversal agent' END || ' **' || {_DRUG_TITLE}
      || '** given ' || CASE WHEN ts > by_admission THEN 'after treatment began'
                             ELSE 'on arrival, before our treatment' END
      || ' (' || {_DRUG_REASON} || ')'
    WHEN moved THEN 'Transfer to ' || value || ': ' || details
    WHEN returned THEN 'Unplanned OR return: ' || value || ' — ' || details
    ELSE value || ': ' || details END AS text
  FROM marked WHERE drug IS NOT NULL OR moved OR returned OR readmitted
  UNION ALL
  SELECT source, case_id, 1, ts, case_ordinal, 'lab',
    'Post-treatment ' || value || ' = ' || format('{{:g}}', lab_number) || ' ('
    || CASE WHEN critical THEN 'critical' ELSE 'abnormal' END || ')'
  FROM marked WHERE abnormal AND (by_admission IS NULL OR ts > by_admission)
  UNION ALL
  SELECT source, case_id, 2, NULL, NULL, 'hemoglobin_drop',
    'Hemoglobin dropped ' || printf('%.1f', hemoglobin_fall) || ' g/dL between draws'
  FROM changes WHERE hemoglobin_fall >= 2
  UNION ALL
  SELECT source, case_id, 3, NULL, NULL, 'creatinine_doubled',
    'Creatinine rose ' || printf('%.1f', creatinine_rise) || 'x from baseline'
  FROM changes WHERE creatinine_rise >= 2)
"""
EVIDENCE_SQL = f"{SIGNALS_SQL}, {EVIDENCE_PART}"


@query(
    "trigger_evidence",
    f"WITH {EVIDENCE_SQL} SELECT case_id, section, {sql_iso('ts')} AS ts, case_ordinal, trigger, text "
    "FROM evidence",
)
def trigger_evidence(spark, folder):
    return plain(
        T.trigger_evidence(activity_events(spark, folder), anchor="admission").drop("source")
    )


@query(
    "timeline_last_events",
    f"WITH {ACTIVITY_SQL} SELECT case_id, case_ordinal, value, row_number() OVER "
    "(PARTITION BY case_id ORDER BY ts DESC, case_ordinal DESC) AS from_end "
    "FROM a_events QUALIFY from_end <= 12",
)
def timeline_last_events(spark, folder):
    return T.last_events(activity_events(spark, folder), 12).select(
        "case_id", "case_ordinal", "value", F.col("from_end").cast("bigint").alias("from_end")
    )


@query(
    "timeline_event_mix",
    f"WITH {ACTIVITY_SQL} SELECT case_id, event_type, count(*) AS events FROM a_events GROUP BY ALL",
)
def timeline_event_mix(spark, folder):
    return (
        activity_events(spark, folder)
        .groupBy("case_id", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "timeline_of_types",
    f"WITH {ACTIVITY_SQL} SELECT case_id, case_ordinal, event_type, value FROM a_events "
    "WHERE event_type IN ('medication', 'procedure')",
)
def timeline_of_types(spark, folder):
    return T.events_of_type(activity_events(spark, folder), "medication", "procedure").select(
        "case_id", "case_ordinal", "event_type", "value"
    )


@query(
    "waiting_since_discharge",
    f"WITH {ACTIVITY_SQL}, w AS (SELECT case_id, CASE WHEN discharged_at IS NOT NULL THEN greatest(0, "
    "floor((epoch_us(TIMESTAMP '2024-01-25 12:00:00') - epoch_us(discharged_at)) / 86400e6))::INTEGER "
    "END AS waiting_days FROM a_cases) "
    "SELECT case_id, waiting_days, coalesce(waiting_days >= 7, false) AS stale FROM w",
)
def waiting_since_discharge(spark, folder):
    now = F.lit("2024-01-25 12:00:00").cast("timestamp")
    return T.with_waiting(activity_cases(spark, folder), now).select(
        "case_id", "waiting_days", "stale"
    )


@query(
    "antidote_first_match",
    f"WITH {SIGNALS_SQL} SELECT case_id, case_ordinal, value, {_FIRST_DRUG} AS drug FROM signals "
    f"WHERE event_type = 'medication' AND {_FIRST_DRUG} IS NOT NULL",
)
def antidote_first_match(spark, folder):
    drug = C.first_match(F.lower("value"), REASONS)
    return (
        T.events_of_type(activity_events(spark, folder), "medication")
        .select("case_id", "case_ordinal", "value", drug.alias("drug"))
        .where(F.col("drug").isNotNull())
    )
