"""The given tables in the shapes of the raw sources the conforming jobs read.

Orders become stays, order lines become results, drugs, moves and codes. Each
shape exists as Spark columns and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.sqltext import sql_list
from tracewell.functions import fixed_values as fixed
from tracewell.session import table

LAB_SPELLINGS = ["CREAT", "Lactic acid", "WBC  count", "Hemoglobin", " creatinine  Serpl"]
DRUG_SPELLINGS = ["NARCAN", "Naloxone  HCl ", "Furosemide", " Heparin"]
WARDS = ["Medical Intensive Care Unit (MICU)", "Med/Surg", "Emergency Department", "PACU",
         "Coronary Care Unit (CCU)", "Neuro Stepdown", "Medicine"]
CODES_10 = ["T81", "Y62", "I10", "E11", "t86 ", "Z99", "Y79"]
CODES_9 = ["9981", "E8702", "4019", "E9352", "25000"]
GIVEN_DRUGS = ["Naloxone", "Heparin", "Furosemide", "Protamine", None, "Calcium Gluconate"]
STATUSES = ["Administered", "Not Given", "Started", "Administered in Other Location", None]
BLOOD_ITEMS = ["Packed Red Blood Cells", "Fresh Frozen Plasma", "Blood Transfusion Consent",
               "Autologous Blood", "Platelets"]
LAB_ITEMS = [*fixed.LAB_LABELS, "Sodium", "Anion Gap"]
CONDITIONS = [*fixed.HARM_CONDITIONS, "Essential hypertension", "Diabetes", "Asthma",
              "Gout", "Anemia", "Migraine", "Sinusitis", "Eczema", "Obesity", "Insomnia"] + [
              "Routine finding"] * 40


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values)).cast("int"))


def sql_pick(values: list, index: str) -> str:
    shown = "[" + ", ".join("NULL" if v is None else sql_list([v])[1:-1] for v in values) + "]"
    return f"({shown})[({index}) % {len(values)} + 1]"


def _iso(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


# --- hospital extract --------------------------------------------------------------
def hospital_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Four text tables with foreign headers, orphans, blanks and repeated rows."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    low = F.col("o_orderpriority") == "5-LOW"
    stays = orders.select(
        _text("o_orderkey").alias("PAT_ENC_CSN_ID"),
        F.when(low, "").otherwise((F.col("o_custkey") % 60 + 20).cast("string")).alias("AGE"),
        F.when(F.col("o_custkey") % 2 == 0, " F").otherwise("M").alias("GENDER"),
        _iso("o_orderdate").alias("HOSP_ADMSN_TIME"),
        F.when(F.col("o_orderstatus") == "F",
               F.date_format(F.date_add("o_orderdate", 5), "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("").alias("HOSP_DISCH_TIME"),
    )
    encounter = F.when(F.col("l_tax") == 0.08, F.concat(F.lit("x"), _text("l_orderkey"))).otherwise(
        F.concat(F.lit(" "), _text("l_orderkey"))
    )
    when = F.when(F.col("l_discount") == 0.10, "").otherwise(_iso("l_shipdate"))
    of = lambda flag: lines.where(F.col("l_returnflag") == flag)
    number = F.col("l_linenumber")
    return {
        "stays": stays,
        "labs": of("A").select(
            encounter.alias("PAT_ENC_CSN_ID"), when.alias("RESULT_TIME"),
            _pick(LAB_SPELLINGS, number).alias("COMPONENT_NAME"),
            _text("l_quantity").alias("ORD_VALUE"), F.lit("mg/dL").alias("UNIT"),
        ),
        "meds": of("R").select(
            encounter.alias("PAT_ENC_CSN_ID"), when.alias("TAKEN_TIME"),
            _pick(DRUG_SPELLINGS, number).alias("MEDICATION_NAME"),
        ),
        "transfers": of("N").select(
            encounter.alias("PAT_ENC_CSN_ID"), when.alias("EFFECTIVE_TIME"),
            _pick(WARDS, F.col("l_suppkey")).alias("DEPARTMENT_NAME"),
        ),
    }


_SYNONYM = "CASE regexp_replace(lower(trim({c})), '\\s+', ' ', 'g') " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fixed.NAME_SYNONYMS.items()
) + " ELSE trim({c}) END"

HOSPITAL_SQL = f"""
h_cases AS (
  SELECT 'hospital' AS source, o_orderkey::VARCHAR AS case_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_custkey % 60 + 20 END::INTEGER AS age,
    CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, o_orderdate AS admitted_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 5 DAY END AS discharged_at
  FROM orders),
h_lines AS (
  SELECT *, l_orderkey::VARCHAR AS case_id FROM lineitem
  WHERE l_tax <> 0.08 AND l_discount <> 0.10
    AND l_orderkey IN (SELECT o_orderkey FROM orders)),
h_raw AS (
  SELECT case_id, 'admission' AS event_type, admitted_at AS ts, 'Inpatient admission' AS value, '' AS details
  FROM h_cases
  UNION ALL
  SELECT case_id, 'lab', l_shipdate, {_SYNONYM.format(c=sql_pick(LAB_SPELLINGS, 'l_linenumber'))},
    l_quantity::VARCHAR || ' mg/dL' FROM h_lines WHERE l_returnflag = 'A'
  UNION ALL
  SELECT case_id, 'medication', l_shipdate, {_SYNONYM.format(c=sql_pick(DRUG_SPELLINGS, 'l_linenumber'))},
    '' FROM h_lines WHERE l_returnflag = 'R'
  UNION ALL
  SELECT case_id, 'transfer', l_shipdate, {sql_pick(WARDS, 'l_suppkey')}, ''
  FROM h_lines WHERE l_returnflag = 'N'),
h_events AS (
  SELECT DISTINCT 'hospital' AS source, case_id, substr(sha1(event_type || '|' ||
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || value || '|' || details), 1, 16) AS event_id,
    event_type, ts, value, details FROM h_raw)
"""


# --- admission dataset -----------------------------------------------------------------
def admission_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    customer, part = table(spark, folder, "customer"), table(spark, folder, "part")
    newer = F.col("l_linestatus") == "O"
    version = F.when(newer, 10).otherwise(9)
    number = F.col("l_linenumber")
    whole = F.floor("l_extendedprice")
    result = (
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
        .when(number == 1, F.col("l_tax") / 1000)
        .when(number == 2, (whole * 1000).cast("double"))
        .otherwise(whole / 100)
    )
    hadm = F.col("l_orderkey").alias("hadm_id")
    return {
        "patients": customer.select(
            F.col("c_custkey").alias("subject_id"),
            F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
            (F.col("c_nationkey") + 20).alias("anchor_age"),
        ),
        "admissions": orders.select(
            F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
            F.col("o_orderdate").alias("admittime"),
            F.date_add("o_orderdate", (F.col("o_orderkey") % 20 + 1).cast("int")).cast("timestamp")
            .alias("dischtime"),
            F.col("o_orderpriority").alias("admission_type"),
        ),
        "diagnoses": lines.select(
            hadm, version.alias("icd_version"),
            F.when(newer, _pick(CODES_10, F.col("l_partkey")))
            .otherwise(_pick(CODES_9, F.col("l_partkey"))).alias("icd_code"),
        ),
        "transfers": lines.select(
            hadm,
            F.when(F.col("l_returnflag") == "A", "admit")
            .when(F.col("l_returnflag") == "R", "transfer").otherwise("discharge")
            .alias("eventtype"),
            F.when(F.col("l_returnflag") != "N", _pick(WARDS, F.col("l_suppkey"))).alias("careunit"),
            F.col("l_shipdate").alias("intime"),
        ),
        "labitems": part.select(
            F.col("p_partkey").alias("itemid"), _pick(LAB_ITEMS, F.col("p_size")).alias("label")
        ),
        "labevents": lines.select(
            hadm, F.col("l_partkey").alias("itemid"), F.col("l_shipdate").alias("charttime"),
            result.alias("valuenum"),
        ),
        "emar": lines.select(
            hadm, F.col("l_shipdate").alias("charttime"),
            _pick(GIVEN_DRUGS, F.col("l_partkey")).alias("medication"),
            _pick(STATUSES, F.col("l_suppkey")).alias("event_txt"),
        ),
        "items": part.select(
            F.col("p_partkey").alias("itemid"), _pick(BLOOD_ITEMS, F.col("p_size")).alias("label"),
            F.when(F.col("p_type").isin("PROMO", "ECONOMY"), fixed.BLOOD_CATEGORY)
            .otherwise("Medications").alias("category"),
        ),
        "inputs": lines.select(
            hadm, F.col("l_partkey").alias("itemid"), F.col("l_shipdate").alias("starttime"),
            F.when(F.col("l_discount") != 0.05, F.col("l_quantity")).alias("amount"),
            F.lit("mL").alias("amountuom"),
        ),
        "procedures": lines.select(
            hadm, F.col("l_shipdate").alias("chartdate"), version.alias("icd_version"),
            F.concat(F.lit("P"), (F.col("l_partkey") % 60).cast("string")).alias("icd_code"),
        ),
        "titles": part.select("p_size").distinct().select(
            F.concat(F.lit("P"), F.col("p_size").cast("string")).alias("icd_code"),
            F.lit(10).alias("icd_version"),
            F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Reopening of site "), _text("p_size")))
            .when(F.col("p_size") % 3 == 1, F.concat(F.lit("Control Bleeding in area "), _text("p_size")))
            .otherwise(F.concat(F.lit("Inspection of area "), _text("p_size")))
            .alias("long_title"),
        ),
    }


ADMISSION_SQL = f"""
m_admissions AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
    o_orderdate + to_days((o_orderkey % 20 + 1)::INTEGER) AS dischtime, o_orderpriority AS admission_type
  FROM orders),
m_lines AS (
  SELECT *, l_orderkey AS hadm_id, CASE WHEN l_linestatus = 'O' THEN 10 ELSE 9 END AS icd_version FROM lineitem),
m_diagnoses AS (
  SELECT hadm_id, icd_version, CASE WHEN icd_version = 10 THEN {sql_pick(CODES_10, 'l_partkey')}
    ELSE {sql_pick(CODES_9, 'l_partkey')} END AS icd_code FROM m_lines),
m_transfers AS (
  SELECT hadm_id, CASE l_returnflag WHEN 'A' THEN 'admit' WHEN 'R' THEN 'transfer' ELSE 'discharge' END AS eventtype,
    CASE WHEN l_returnflag <> 'N' THEN {sql_pick(WARDS, 'l_suppkey')} END AS careunit, l_shipdate AS intime FROM m_lines),
m_labitems AS (SELECT p_partkey AS itemid, {sql_pick(LAB_ITEMS, 'p_size')} AS label FROM part),
m_labevents AS (
  SELECT hadm_id, l_partkey AS itemid, l_shipdate AS charttime,
    CASE WHEN l_discount = 0 THEN NULL WHEN l_linenumber = 1 THEN l_tax / 1000.0::DOUBLE
      WHEN l_linenumber = 2 THEN floor(l_extendedprice) * 1000.0::DOUBLE
      ELSE floor(l_extendedprice) / 100.0::DOUBLE END AS valuenum FROM m_lines),
m_emar AS (
  SELECT hadm_id, l_shipdate AS charttime, {sql_pick(GIVEN_DRUGS, 'l_partkey')} AS medication,
    {sql_pick(STATUSES, 'l_suppkey')} AS event_txt FROM m_lines),
m_items AS (
  SELECT p_partkey AS itemid, {sql_pick(BLOOD_ITEMS, 'p_size')} AS label,
    CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN '{fixed.BLOOD_CATEGORY}' ELSE 'Medications' END AS category FROM part),
m_inputs AS (
  SELECT hadm_id, l_partkey AS itemid, l_shipdate AS starttime,
    CASE WHEN l_discount <> 0.05 THEN l_quantity END AS amount FROM m_lines),
m_procedures AS (
  SELECT hadm_id, l_shipdate AS chartdate, icd_version, 'P' || (l_partkey % 60)::VARCHAR AS icd_code FROM m_lines),
m_titles AS (
  SELECT DISTINCT 'P' || p_size::VARCHAR AS icd_code, 10 AS icd_version,
    CASE p_size % 3 WHEN 0 THEN 'Reopening of site ' WHEN 1 THEN 'Control Bleeding in area '
      ELSE 'Inspection of area ' END || p_size::VARCHAR AS long_title FROM part)
"""


# --- encounter warehouse ------------------------------------------------------------------
def encounter_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    customer = table(spark, folder, "customer")
    priority = F.col("o_orderpriority")
    encounter = F.concat(F.lit("e"), _text("l_orderkey")).alias("ENCOUNTER")
    time = F.col("l_shipdate")
    of = lambda flag: lines.where(F.col("l_returnflag") == flag)
    number = F.col("l_linenumber")
    return {
        "patients": customer.select(
            F.concat(F.lit("p"), _text("c_custkey")).alias("Id"),
            F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 7 % 15000).cast("int"))
            .cast("timestamp").alias("BIRTHDATE"),
            _pick(["", "M", "F"], F.col("c_nationkey")).alias("GENDER"),
        ),
        "encounters": orders.select(
            F.concat(F.lit("e"), _text("o_orderkey")).alias("Id"),
            F.col("o_orderdate").alias("START"),
            F.date_add("o_orderdate", (F.col("o_orderkey") % 9).cast("int")).cast("timestamp").alias("STOP"),
            F.concat(F.lit("p"), _text("o_custkey")).alias("PATIENT"),
            F.when(priority == "1-URGENT", "emergency").when(priority == "2-HIGH", "inpatient")
            .when(priority == "3-MEDIUM", "").otherwise("ambulatory").alias("ENCOUNTERCLASS"),
            F.when(priority == "5-LOW", None).otherwise(priority).alias("DESCRIPTION"),
        ),
        "observations": of("A").select(
            time.alias("DATE"), encounter, _pick(LAB_ITEMS, number).alias("DESCRIPTION"),
            _text("l_quantity").alias("VALUE"),
            F.when(number % 2 == 0, "mg/dL").alias("UNITS"),
        ),
        "medications": of("R").select(
            time.alias("START"), encounter, _pick(GIVEN_DRUGS, F.col("l_partkey")).alias("DESCRIPTION"),
            F.when(number % 2 == 0, "Pain").alias("REASONDESCRIPTION"),
        ),
        "procedures": of("N").select(
            time.alias("START"), encounter, _pick(fixed.SIGNATURE_PROCEDURES, F.col("l_partkey")).alias("DESCRIPTION"),
            F.when(number % 2 == 0, "Bleeding").alias("REASONDESCRIPTION"),
        ),
        "conditions": lines.select(
            time.alias("START"), encounter, _pick(CONDITIONS, F.col("l_partkey")).alias("DESCRIPTION")
        ),
    }


ENCOUNTER_SQL = f"""
e_stays AS (
  SELECT 'e' || o_orderkey::VARCHAR AS encounter_id, 'p' || o_custkey::VARCHAR AS patient_id,
    o_orderdate AS started, o_orderdate + to_days((o_orderkey % 9)::INTEGER) AS stopped,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'inpatient'
      WHEN '3-MEDIUM' THEN 'inpatient' ELSE 'ambulatory' END AS encounter_class,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Encounter' ELSE o_orderpriority END AS description
  FROM orders),
e_lagged AS (
  SELECT *, lag(stopped) OVER (PARTITION BY patient_id ORDER BY started, encounter_id) AS previous_discharge
  FROM e_stays),
e_gaps AS (
  SELECT *, CASE WHEN (epoch_us(started) - epoch_us(previous_discharge)) / 86400e6 BETWEEN 0 AND 30
    THEN (epoch_us(started) - epoch_us(previous_discharge)) / 86400e6 END AS gap FROM e_lagged),
e_conditions AS (
  SELECT 'e' || l_orderkey::VARCHAR AS encounter_id, {sql_pick(CONDITIONS, 'l_partkey')} AS name FROM lineitem),
e_harm AS (
  SELECT encounter_id, min(name) AS first_name FROM e_conditions
  WHERE list_contains({sql_list(fixed.HARM_CONDITIONS)}, name) GROUP BY encounter_id),
e_people AS (
  SELECT 'p' || c_custkey::VARCHAR AS patient_id, DATE '1950-01-01' + (c_custkey * 7 % 15000)::INTEGER AS born,
    CASE c_nationkey % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'M' ELSE 'F' END AS gender FROM customer)
"""
