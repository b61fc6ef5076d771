import gzip

import pytest
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.sources import admissions as A
from tracewell.sources import csv_tables as R
from tracewell.sources import encounters as E
from tracewell.sources import hospital as H


def text_table(spark, header, *rows):
    names = header.split(",")
    return spark.createDataFrame(list(rows), ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="module")
def foreign(spark):
    return {
        "stays": text_table(spark, "PAT_ENC_CSN_ID,AGE,GENDER,HOSP_ADMSN_TIME,HOSP_DISCH_TIME",
                            (" 1 ", "67.0", "F", "2026-09-01T07:12:00", "2026-09-07T14:40:00Z"),
                            ("2", "old", " M", "2026-09-01 08:05:00", "")),
        "labs": text_table(spark, "PAT_ENC_CSN_ID,RESULT_TIME,COMPONENT_NAME,ORD_VALUE,UNIT",
                           ("1", "2026-09-01T08:01:00", " CREAT ", "0.9", "mg/dL"),
                           ("1", "2026-09-01T08:01:00", " CREAT ", "0.9", "mg/dL"),
                           ("1", "2026-09-04T06:10:00", "Lactic  acid", "4.1", ""),
                           ("9", "2026-09-04T06:10:00", "CREAT", "4.1", ""),
                           ("2", "", "CREAT", "4.1", "")),
        "meds": text_table(spark, "PAT_ENC_CSN_ID,TAKEN_TIME,MEDICATION_NAME",
                           ("1", "2026-09-03T22:41:00", "NARCAN")),
        "transfers": text_table(spark, "PAT_ENC_CSN_ID,EFFECTIVE_TIME,DEPARTMENT_NAME",
                                ("1", "2026-09-04T07:02:00", " MICU ")),
    }


def test_foreign_headers_and_synonyms(foreign):
    cases, events = H.conform(foreign)
    rows = {r["case_id"]: r for r in cases.collect()}
    assert (rows["1"]["age"], rows["2"]["age"], rows["2"]["gender"]) == (67, 0, "M")
    assert rows["1"]["discharged_at"].isoformat() == "2026-09-07T14:40:00"
    assert rows["2"]["discharged_at"] is None and rows["1"]["label"] is None
    got = sorted((r["event_type"], r["value"], r["details"]) for r in events.where("case_id = '1'").collect())
    assert got == [("admission", "Inpatient admission", ""), ("lab", "Creatinine", "0.9 mg/dL"),
                   ("lab", "Lactate", "4.1"), ("medication", "Naloxone", ""), ("transfer", "MICU", "")]
    assert events.where("case_id = '2'").count() == 1 and events.where("case_id = '9'").count() == 0


def test_event_id_is_the_content_hash(foreign):
    import hashlib

    events = H.conform(foreign)[1]
    row = events.where("event_type = 'medication'").head()
    raw = "medication|2026-09-03T22:41:00|Naloxone|"
    assert row["event_id"] == hashlib.sha1(raw.encode()).hexdigest()[:16]


def test_iso_text_keeps_a_fraction(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:07",), ("2026-01-01 00:00:07.000123",)], "t string")
    assert [r[0] for r in df.select(C.iso_text(F.col("t").cast("timestamp"))).collect()] == [
        "2026-01-01T00:00:07", "2026-01-01T00:00:07.000123"]


def test_missing_columns_and_times_are_errors(foreign):
    with pytest.raises(ValueError, match="lacks value"):
        H.map_columns(foreign["labs"].drop("ORD_VALUE"), "labs")
    mapped = H.map_columns(foreign["labs"].drop("UNIT"), "labs")
    assert mapped.where("units != ''").count() == 0
    stays = H.map_columns(foreign["stays"], "stays").withColumn("admitted", F.lit(""))
    with pytest.raises(Exception, match="without admission time"):
        H.hospital_cases(stays).collect()


def test_first_alias_wins():
    mapping = H.header_mapping(["DATE", "Result Time!", "result_time", "csn", "test", "value"], "labs")
    assert mapping["time"] == "DATE" and mapping["encounter_id"] == "csn"


def test_ordinals_follow_time(foreign):
    events = H.with_case_ordinals(H.conform(foreign)[1])
    rows = events.where("case_id = '1'").orderBy("case_ordinal").collect()
    assert [r["case_ordinal"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["event_type"] for r in rows][0] == "admission"
    again = H.with_case_ordinals(H.conform(foreign)[1].repartition(3))
    assert again.select("event_id", "case_ordinal").exceptAll(events.select("event_id", "case_ordinal")).count() == 0


def test_transfers_judge_the_route(spark):
    rows = [(1, "admit", "Emergency Department", "2026-01-01 00:00:00"), (1, "transfer", "MICU", "2026-01-01 05:00:00"),
            (1, "transfer", "Medicine", "2026-01-02 05:00:00"), (1, "transfer", "Trauma SICU (TSICU)", "2026-01-03 05:00:00"),
            (1, "transfer", "Coronary Care Unit (CCU)", "2026-01-03 09:00:00"), (2, "transfer", "MICU", "2026-01-01 05:00:00"),
            (2, "discharge", None, "2026-01-09 05:00:00")]
    df = spark.createDataFrame(rows, "hadm_id int, eventtype string, careunit string, intime string")
    got = [r["details"] for r in A.transfer_events(df).orderBy("hadm_id", "ts").collect()]
    assert got == [
        "Planned or direct admission to intensive care from Emergency Department.",
        "Unplanned escalation to intensive care from Medicine.",
        "Planned or direct admission to intensive care from Trauma SICU (TSICU).",
        "Planned or direct admission to intensive care from direct.",
    ]


def test_readmission_gap_limits(spark):
    rows = [(1, 1, "2026-01-01", "2026-01-05"), (1, 2, "2026-02-04", "2026-02-05"), (1, 3, "2026-03-08", "2026-03-09"),
            (1, 4, "2026-03-08", "2026-03-10"), (2, 5, "2026-01-01", None), (2, 6, "2026-01-03", "2026-01-04")]
    df = spark.createDataFrame(
        [(*r, "EW") for r in rows],
        "subject_id int, hadm_id int, admittime string, dischtime string, admission_type string")
    gaps = {r["hadm_id"]: r["readmission_gap_days"] for r in A.admission_stays(df).collect()}
    # 30 days exactly counts, 31 does not, an overlap (negative gap) does not
    assert gaps == {1: None, 2: 30.0, 3: None, 4: None, 5: None, 6: None}
    details = {r["hadm_id"]: r["details"] for r in A.admission_events(A.admission_stays(df)).collect()}
    assert details[2] == "Readmission within 30 days: 30.0 days after the previous discharge. EW admission."
    assert details[1] == "EW admission."


def test_procedures_at_midday_and_code_fallback(spark):
    p = spark.createDataFrame([(1, "2026-01-01", "A", 10), (1, "2026-01-01", "B", 9)],
                              "hadm_id int, chartdate string, icd_code string, icd_version int")
    t = spark.createDataFrame([("A", 10, "Reopening of site")], "icd_code string, icd_version int, long_title string")
    rows = sorted((r["value"], r["ts"].hour) for r in A.procedure_events(p, t).collect())
    assert rows == [("ICD-9 B", 12), ("Reopening of site", 12)]


def test_encounters(spark):
    patients = spark.createDataFrame([("p1", "1990-06-01", "F")], "Id string, BIRTHDATE string, GENDER string")
    stays = spark.createDataFrame(
        [("e1", "2020-05-31 00:00:00", "2020-06-02 00:00:00", "p1", "inpatient", "Stay"),
         ("e2", "2020-06-10 12:00:00", None, "p1", "", None), ("e3", None, None, "p1", "", None),
         ("e4", "2020-01-01 00:00:00", None, "p9", "wellness", "Check")],
        "Id string, START string, STOP string, PATIENT string, ENCOUNTERCLASS string, DESCRIPTION string")
    conditions = spark.createDataFrame(
        [("e1", "Postoperative hemorrhage"), ("e1", "Adverse reaction to anticoagulant therapy"), ("e2", "Gout")],
        "ENCOUNTER string, DESCRIPTION string")
    timed = E.timed_encounters(stays)
    cases = {r["encounter_id"]: r for r in E.encounter_cases(patients, timed, conditions).collect()}
    assert set(cases) == {"e1", "e2", "e4"}
    assert (cases["e1"]["age"], cases["e1"]["label"], cases["e1"]["scenario"]) == (
        29, True, "Adverse reaction to anticoagulant therapy")
    assert (cases["e4"]["age"], cases["e4"]["gender"], cases["e4"]["scenario"]) == (0, "U", "wellness")
    blank = spark.createDataFrame([], "DATE string, START string, ENCOUNTER string, DESCRIPTION string, VALUE string, "
                                      "UNITS string, REASONDESCRIPTION string")
    events = {r["encounter_id"]: r for r in E.encounter_events(timed, blank, blank, blank).collect()}
    assert events["e2"]["details"] == (
        "Readmission within 30 days: 8.5 days after the previous discharge. inpatient admission. Encounter.")


def test_csv_readers(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    with gzip.open(tmp_path / "hosp" / "labs.csv.gz", "wt") as f:
        f.write("hadm_id,charttime,dod,note\n1,2026-01-01 00:00:00,bad,x\n2,broken,2020-01-01,\n")
    few = R.read_columns(spark, str(tmp_path), "hosp/labs", ["hadm_id", "note"])
    assert few.columns == ["hadm_id", "note"] and few.count() == 2
    typed = R.read_typed(spark, str(tmp_path / "hosp" / "labs.csv.gz"))
    kinds = dict(typed.dtypes)
    assert kinds["charttime"] == "timestamp" and kinds["dod"] == "timestamp"
    rows = typed.orderBy("hadm_id").collect()
    assert rows[0]["dod"] is None and rows[1]["charttime"] is None and rows[1]["dod"].year == 2020
    text = R.read_text_columns(spark, str(tmp_path / "hosp" / "labs.csv.gz"))
    assert set(dict(text.dtypes).values()) == {"string"} and text.where("note = ''").count() == 1
    report = R.load_tables(spark, {"hosp.labs": str(tmp_path / "hosp" / "labs.csv.gz")}, str(tmp_path / "out"))
    row = report.head()
    assert row["same"] and row["source_rows"] == 2
    assert spark.read.parquet(str(tmp_path / "out" / "hosp" / "labs")).count() == 2
    assert R.is_time_column("CHARTTIME") and R.is_time_column("dod") and not R.is_time_column("note")


def test_warehouse_read(spark):
    spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").createOrReplaceTempView("wide_table")
    assert R.read_warehouse(spark, "wide_table", ["a", "c"]).columns == ["a", "c"]
