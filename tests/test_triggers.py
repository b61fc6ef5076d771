import pytest
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.operators import timeline as T

DAY = "2026-09-01 "


def features_of(make_events, rows, **options):
    events = make_events([("c", k, DAY + t, v, d) for k, t, v, d in rows])
    return T.trigger_features(events, **options).head().asDict()


ADMITTED = ("admission", "08:00:00", "Inpatient admission", "")


@pytest.mark.parametrize(
    "text,expected",
    [("2.4 mg/dL", 2.4), ("<5", None), ("", None), (" 7 ", 7.0), ("1d", None), ("1_000", 1000.0),
     (".5", 0.5), ("5.", 5.0), ("1e3 x", 1000.0), ("-3", -3.0), ("nan", None), ("inf", float("inf")),
     ("abc 5", None), ("\t12\tx", 12.0), (None, None), ("1__0", None)],
)
def test_numeric_prefix(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.numeric_prefix(F.col("t"))).head()[0] == expected


@pytest.mark.parametrize("unit", ["Medical Intensive Care Unit (MICU)", "Coronary Care Unit (CCU)",
                                  "Neuro Stepdown"])
def test_unit_names_fire_unplanned_escalation(make_events, unit):
    f = features_of(make_events, [ADMITTED, ("transfer", "20:00:00", unit,
                                             "Unplanned escalation from Med/Surg.")])
    assert f["unplanned_icu_transfer"] == 1.0 and f["repeat_icu_escalation"] == 0.0


def test_planned_transfer_is_no_escalation_but_unplanned_is(make_events):
    planned = features_of(make_events, [("transfer", "08:10:00", "MICU", "Planned admission")])
    assert planned["unplanned_icu_transfer"] == 0.0
    # "planned" must be looked for after "unplanned" is taken out
    mixed = features_of(make_events, [("transfer", "08:10:00", "MICU", "unplanned, not planned")])
    assert mixed["unplanned_icu_transfer"] == 0.0


def test_escalation_reads_the_unit_name_only(make_events):
    f = features_of(make_events, [("transfer", "08:10:00", "Med/Surg", "back from the ICU")])
    assert f["unplanned_icu_transfer"] == 0.0


def test_two_moves_are_a_repeat(make_events):
    f = features_of(make_events, [("transfer", "08:10:00", "MICU", ""), ("transfer", "09:10:00", "CCU", "")])
    assert f["repeat_icu_escalation"] == 1.0


def test_antidote_timing_is_strict(make_events):
    at = [("procedure", "10:00:00", "Operation", ""), ("medication", "10:00:00", "Naloxone", "")]
    assert features_of(make_events, at)["antidote_after_treatment_start"] == 0.0
    later = [at[0], ("medication", "10:00:01", "Naloxone", "")]
    f = features_of(make_events, later)
    assert f["antidote_given"] == 1.0 and f["antidote_after_treatment_start"] == 1.0


def test_without_anchor_labs_count_and_antidotes_do_not(make_events):
    f = features_of(make_events, [("lab", "10:00:00", "Lactate", "5.0 mmol/L")])
    assert f["critical_post_treatment_lab"] == 1.0
    f = features_of(make_events, [ADMITTED, ("note", "09:00:00", "n", "naloxone")])
    assert f["antidote_given"] == 0.0


def test_specific_antidote_suppresses_the_context_test(make_events):
    f = features_of(make_events, [("medication", "10:00:00", "Naloxone with dextrose 50", "")])
    assert f["antidote_given"] == 1.0 and f["context_dependent_reversal_agent"] == 0.0


def test_anchor_falls_back(make_events):
    rows = [("c", "medication", DAY + "09:00:00", "x", ""), ("c", "procedure", DAY + "10:00:00", "y", "")]
    anchor = lambda kind, r: T.treatment_anchor(make_events(r), kind).head()["anchor_at"]
    assert anchor("procedure", rows).hour == 10
    assert anchor("procedure", rows[:1]).hour == 9
    assert anchor("admission", rows).hour == 10
    assert anchor("admission", [("c", "lab", DAY + "01:00:00", "x", "")]) is None
    with pytest.raises(ValueError):
        T.treatment_anchor(make_events(rows), "discharge")


def test_trends_use_all_labs_against_the_first_draw(make_events):
    rows = [("lab", "07:00:00", "Hemoglobin", "12.0"), ("procedure", "08:00:00", "Operation", ""),
            ("lab", "09:00:00", "Hemoglobin", "10.0"),
            ("lab", "07:00:00", "Creatinine", "0.8"), ("lab", "09:00:00", " creatinine ", "1.6")]
    f = features_of(make_events, rows)
    assert f["hemoglobin_drop"] == 1.0 and f["creatinine_doubled"] == 1.0


def test_first_draw_of_equal_times_is_the_first_listed(make_events):
    rows = [("lab", "07:00:00", "Hemoglobin", "10.0"), ("lab", "07:00:00", "Hemoglobin", "12.5")]
    assert features_of(make_events, rows)["hemoglobin_drop"] == 0.0
    assert features_of(make_events, rows[::-1])["hemoglobin_drop"] == 1.0


def test_hemoglobin_series_are_not_merged(make_events):
    rows = [("lab", "07:00:00", "hgb", "12.0"), ("lab", "09:00:00", "Hemoglobin", "8.0")]
    assert features_of(make_events, rows)["hemoglobin_drop"] == 0.0
    only = [("lab", "07:00:00", "hgb", "12.0"), ("lab", "09:00:00", "hgb", "8.0")]
    assert features_of(make_events, only)["hemoglobin_drop"] == 1.0


def test_creatinine_base_of_zero_never_doubles(make_events):
    rows = [("lab", "07:00:00", "creatinine", "0"), ("lab", "09:00:00", "creatinine", "4")]
    assert features_of(make_events, rows)["creatinine_doubled"] == 0.0


def test_lab_types_are_counted_as_written(make_events):
    rows = [("lab", "07:00:00", "WBC", "20"), ("lab", "08:00:00", "wbc", "20"),
            ("lab", "09:00:00", "WBC", "22"), ("lab", "09:00:00", "Lactate", "<5")]
    assert features_of(make_events, rows)["abnormal_lab_types_count"] == 2.0


def test_limits_are_strict(make_events):
    f = features_of(make_events, [("lab", "07:00:00", "Hemoglobin", "9.0"), ("lab", "07:00:00", "WBC", "12.0")])
    assert f["abnormal_post_treatment_lab"] == 0.0


def test_notes_and_readmission_and_theatre(make_events):
    f = features_of(make_events, [
        ("admission", "08:00:00", "Inpatient admission", "Readmission within 30 days"),
        ("note", "09:00:00", "Progress", "Code Blue called"),
        ("procedure", "10:00:00", "Washout", "emergent"),
        ("procedure", "11:00:00", "Reclosure of wound", ""),
        ("medication", "12:00:00", "Packed RBC", ""),
    ])
    for name in ("readmission_30d", "rapid_response_called", "unplanned_return_to_or", "transfusion_given"):
        assert f[name] == 1.0
    prose = features_of(make_events, [("procedure", "10:00:00", "Biopsy or scan", "unscheduled")])
    assert prose["unplanned_return_to_or"] == 1.0


def test_cases_without_events_are_zero_and_order_does_not_matter(make_events, make_cases):
    rows = [("a", "lab", DAY + "07:00:00", "Hemoglobin", "12"), ("a", "lab", DAY + "08:00:00", "Hemoglobin", "7"),
            ("a", "procedure", DAY + "06:00:00", "x", "")]
    events = make_events(rows)
    both = T.trigger_features(events, make_cases([("a", True), ("b", False)]))
    assert {r["case_id"]: r["hemoglobin_drop"] for r in both.collect()} == {"a": 1.0, "b": 0.0}
    shuffled = T.trigger_features(events.repartition(3, "event_id"))
    assert shuffled.exceptAll(T.trigger_features(events)).count() == 0


def test_evidence_wording(make_events):
    rows = [("c", "procedure", DAY + "08:00:00", "Operation", ""),
            ("c", "medication", DAY + "09:00:00", "NALOXONE 0.4", ""),
            ("c", "transfer", DAY + "10:00:00", "Neuro Stepdown", "Moved."),
            ("c", "lab", DAY + "11:00:00", "Lactate", "4.50 mmol/L")]
    texts = [r["text"] for r in T.trigger_evidence(make_events(rows)).orderBy("section", "ts").collect()]
    assert texts == [
        "Antidote **Naloxone** given after treatment began (opioid oversedation)",
        "Transfer to Neuro Stepdown: Moved.",
        "Post-treatment Lactate = 4.5 (critical)",
    ]


def test_general_number(spark):
    values = [0.0, 2.5, 123456.0, 1234567.0, 0.0001, 0.00008, 100.0, -7.125, 1e-10, 12345678.9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(C.general_number(F.col("x"))).collect()] == [f"{v:g}" for v in values]


def test_waiting_days(spark):
    df = spark.createDataFrame(
        [("2026-09-12 11:00:00",), (None,), ("2026-09-25 00:00:00",)], "d string"
    ).select(F.col("d").cast("timestamp").alias("discharged_at"))
    now = F.lit("2026-09-19 12:00:00").cast("timestamp")
    rows = T.with_waiting(df, now).collect()
    assert [(r["waiting_days"], r["stale"]) for r in rows] == [(7, True), (None, False), (0, False)]
