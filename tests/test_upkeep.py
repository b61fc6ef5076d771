"""Store, nightly cycle, stream, counterfactual edits, equivalence, review queue."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import counterfactual as CF
from tracewell.operators import merge
from tracewell.operators import scoring as S
from tracewell.operators import timeline as T
from tracewell.plans import nightly
from tracewell.plans.equivalence import equivalence_report
from tracewell.plans.review import review_queue
from tracewell.sources.store import CaseStore, StoreMoved
from tracewell.streaming.drops import watch_drops

KEY = ["source", "case_id"]
MODEL = S.ScoringModel(
    "logistic", ["antidote_after_treatment_start", "abnormal_lab_types_count"],
    weights={"antidote_after_treatment_start": 1.0, "abnormal_lab_types_count": 0.5}, intercept=-1.0)


def drop(spark, stays, labs=(), meds=(), transfers=()):
    make = lambda rows, names: spark.createDataFrame(
        list(rows), ", ".join(f"{n} string" for n in names.split(",")))
    return {
        "stays": make(stays, "encounter_id,age,sex,admitted,discharged"),
        "labs": make(labs, "encounter_id,time,name,value,units"),
        "meds": make(meds, "encounter_id,time,name"),
        "transfers": make(transfers, "encounter_id,time,to_unit"),
    }


@pytest.fixture
def first_drop(spark):
    return drop(
        spark,
        [("1", "67", "F", "2026-09-01T07:12:00", ""), ("2", "44", "M", "2026-09-01T08:05:00", "2026-09-02T11:20:00"),
         ("3", "81", "F", "2026-09-01T19:40:00", "")],
        labs=[("1", "2026-09-01T08:01:00", "Creatinine", "0.9", "mg/dL")],
        meds=[("1", "2026-09-01T18:00:00", "Hydromorphone"), ("2", "2026-09-01T10:00:00", "Ondansetron")],
    )


@pytest.fixture
def second_drop(spark):
    return drop(
        spark,
        [("1", "67", "F", "2026-09-01T07:12:00", "2026-09-07T14:40:00"),
         ("2", "44", "M", "2026-09-01T08:05:00", "2026-09-02T11:20:00"), ("3", "81", "F", "2026-09-01T19:40:00", "")],
        labs=[("1", "2026-09-01T08:01:00", "Creatinine", "0.9", "mg/dL"),
              ("1", "2026-09-04T06:10:00", "Lactate", "4.1", "mmol/L")],
        meds=[("1", "2026-09-03T22:41:00", "NARCAN")],
    )


def ids(df):
    return sorted(r["case_id"] for r in df.collect())


def test_nightly_drops_rank_only_after_discharge(spark, tmp_path, first_drop, second_drop):
    store = CaseStore(spark, str(tmp_path / "store"))
    first, run = nightly.ingest_and_rank(store, first_drop, MODEL)
    census = first.census.head()
    assert (census["total"], census["in_house"], census["discharged"]) == (3, 2, 1)
    assert first.events_appended == 6 and run is not None
    assert ids(store.read("scores")) == ["2"] and nightly.pending(store).count() == 0

    # the same delivery again changes nothing and scores nothing
    again, none = nightly.ingest_and_rank(store, first_drop, MODEL)
    assert again.events_appended == 0 and none is None

    second, run2 = nightly.ingest_and_rank(store, second_drop, MODEL)
    assert second.events_appended == 2 and ids(store.read("scores").where(F.col("run_id") == run2)) == ["1"]
    score = store.read("scores").where("case_id = '1'").head()
    parts = store.read("contributions").where("case_id = '1'")
    assert score["score"] == pytest.approx(1 / (1 + 2.718281828459045 ** -(-1 + 1.0 + 0.5)))
    assert merge.run_contributions(store.read("scores"), store.read("contributions")).where(
        "case_id = '1'").count() == parts.count() == 2

    ordinals = [r["case_ordinal"] for r in store.events().where("case_id = '1'").orderBy("case_ordinal").collect()]
    assert ordinals == list(range(5))


def test_last_write_reopens_a_stay(spark, tmp_path, first_drop, second_drop):
    store = CaseStore(spark, str(tmp_path / "store"))
    nightly.ingest(store, second_drop)
    nightly.ingest(store, first_drop)
    assert store.cases().where("case_id = '1'").head()["discharged_at"] is None


def test_unseen_events_are_numbered_on(spark, make_events):
    at = "2026-01-01 00:00:0"
    old = make_events([("a", "lab", at + "1", "x", "1"), ("a", "lab", at + "2", "y", "1")])
    new = make_events([("a", "lab", at + "1", "x", "1"), ("b", "lab", at + "3", "z", "1")] +
                      [("a", "lab", at + str(i), f"n{i}", "1") for i in range(3, 9)])
    new = new.withColumn("event_id", F.concat_ws("|", "value", F.col("ts").cast("string")))
    old = old.withColumn("event_id", F.concat_ws("|", "value", F.col("ts").cast("string")))
    got = merge.unseen_events(old, new.unionByName(new))
    rows = sorted((r["case_id"], r["case_ordinal"], r["value"]) for r in got.collect())
    assert rows == [("a", 2 + i, f"n{3 + i}") for i in range(6)] + [("b", 0, "z")]


def test_store_errors_and_reviews(spark, tmp_path, first_drop):
    store = CaseStore(spark, str(tmp_path / "store"))
    assert store.cases().count() == 0
    nightly.ingest(store, first_drop)
    stray = spark.createDataFrame([("hospital", "99", 0.5)], "source string, case_id string, score double")
    with pytest.raises(KeyError):
        store.write_scores(stray, stray, "logistic")
    with pytest.raises(KeyError):
        store.append_events(store.events().limit(1).withColumn("case_id", F.lit("99")))
    review = lambda case, decision: spark.createDataFrame(
        [("hospital", case, "me", decision, None)],
        "source string, case_id string, reviewer string, decision string, notes string")
    store.record_reviews(review("2", "unclear"))
    store.record_reviews(review("2", "harm"))
    with pytest.raises(Exception, match="decision must be one of"):
        store.record_reviews(review("2", "maybe"))
    assert store.read("reviews").count() == 2


def test_store_round_trip(spark, tmp_path, make_events):
    store = CaseStore(spark, str(tmp_path / "store"))
    cases = spark.createDataFrame([("test", "c", 0, 5, "U", None, "x", "y")],
                                  "source string, case_id string, source_ordinal int, age int, gender string, "
                                  "label boolean, label_source string, scenario string")
    events = make_events([("c", "note", "2026-01-01 00:00:07.123456", "", "long text " * 300)])
    store.replace_cases(cases, events)
    store.replace_cases(cases, events)
    row = store.case_events("test").head()
    assert store.events().count() == 1 and row["ts"].microsecond == 123456 and row["value"] == ""
    assert store.ordered_cases().head()["label"] is None
    store.compact("events")
    assert store.events().count() == 1 and store.events("other").count() == 0


def test_files_without_a_commit_are_not_read(spark, tmp_path, first_drop):
    store = CaseStore(spark, str(tmp_path / "store"))
    nightly.ingest(store, first_drop)
    before = store.events().count()
    store.events().write.partitionBy("source").parquet(str(tmp_path / "store" / "events" / "part=99999999-dead"))
    assert store.events().count() == before


def test_stream_takes_each_drop_once(spark, tmp_path):
    folder, store = tmp_path / "in", CaseStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    header = "role,encounter_id,age,sex,admitted,discharged,time,name,value,units,to_unit\n"
    (folder / "one.csv").write_text(
        header + "stays,1,67,F,2026-09-01T07:12:00,,,,,,\nlabs,1,,,,,2026-09-01T08:01:00,CREAT,0.9,mg/dL,\n")
    run = lambda: watch_drops(spark, str(folder), store, str(tmp_path / "ckpt"), MODEL).awaitTermination()
    run()
    assert store.events().count() == 2 and store.read("scores").count() == 0
    (folder / "two.csv").write_text(
        header + "stays,1,67,F,2026-09-01T07:12:00,2026-09-07T14:40:00,,,,,\n"
        "labs,1,,,,,2026-09-01T08:01:00,CREAT,0.9,mg/dL,\nmeds,1,,,,,2026-09-03T22:41:00,Narcan,,,\n")
    run()
    run()
    assert store.events().count() == 3 and store.read("scores").count() == 1
    assert store.events().where("value = 'Naloxone'").count() == 1


# --- counterfactual edits --------------------------------------------------------
@pytest.fixture(scope="module")
def cohort(make_events, make_cases):
    at = "2026-01-01 0"
    rows = []
    for i in range(120):
        rows += [(f"c{i}", "admission", at + "1:00:00", "Inpatient admission", ""),
                 (f"c{i}", "medication", at + "2:00:00.250", "Vancomycin 1g" if i % 2 else "Saline", "Given"),
                 (f"c{i}", "procedure", at + "3:00:00", "Control of hemorrhage", None),
                 (f"c{i}", "lab", at + "4:00:00", "Hemoglobin", "6.5")]
    cases = make_cases([(f"c{i}", i < 60 if i < 110 else None) for i in range(120)])
    return cases, make_events(rows)


def test_undo_gives_back_the_input(cohort):
    cases, events = cohort
    change = CF.apply(cases, events, "run-1")
    back = CF.undo(change.events, change.log)
    assert back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0
    n = change.counts.head()
    assert (n["positives"], n["negatives"], n["silenced"], n["darkened"], n["benign_triggered"]) == (60, 50, 27, 9, 9)
    assert change.events.count() == events.count() - n["rows_deleted"] + n["rows_inserted"]
    assert n["rows_inserted"] == change.log.where("action = 'insert'").count()


def test_only_chosen_cases_change(cohort):
    cases, events = cohort
    change = CF.apply(cases, events, "run-1")
    marks = CF.chosen_cases(cases, CF.Shares(), 7)
    touched = change.log.select(*KEY).distinct()
    assert touched.join(marks.where("silent or benign"), KEY, "left_anti").count() == 0
    dark = marks.where("dark")
    assert dark.where("not silent").count() == 0
    assert change.events.where("event_type = 'lab'").join(dark, KEY, "left_semi").count() == 0
    added = change.log.where("action = 'insert' and row_json like '%medication%'")
    values = {r[0] for r in added.select(F.get_json_object("row_json", "$.value")).collect()}
    assert len(values) == 9  # nine benign cases, nine different templates


def test_second_run_is_refused_or_starts_over(cohort):
    cases, events = cohort
    first = CF.apply(cases, events, "run-1")
    with pytest.raises(RuntimeError):
        CF.apply(cases, first.events, "run-2", earlier_log=first.log)
    forced = CF.apply(cases, first.events, "run-2", earlier_log=first.log, force=True)
    assert forced.events.exceptAll(first.events).count() == 0
    dry = CF.plan_counts(CF.chosen_cases(cases, CF.Shares(), 7)).head()
    assert dry["rows_deleted"] == 0 and dry["silenced"] == 27


# --- equivalence and review ----------------------------------------------------------
def test_equivalence(cohort):
    cases, events = cohort
    cases = cases.select("*", F.lit(1).alias("age"), F.lit("F").alias("gender"), F.lit("s").alias("scenario"),
                         F.lit("l").alias("label_source"), F.lit(1).alias("source_ordinal"))
    features = T.trigger_features(events)
    scores = MODEL.score(features)
    same = equivalence_report(cases, events, features, scores, cases.repartition(3), events, features, scores).head()
    assert same["equivalent"] and same["max_score_delta"] == 0.0 and same["same_order"]
    fewer = equivalence_report(cases, events, features, scores, cases.where("case_id != 'c1'"),
                               events.where("event_type != 'lab'"), features,
                               scores.withColumn("score", F.col("score") + 0.25)).head()
    assert not fewer["equivalent"] and fewer["unmatched_cases"] == 1
    assert fewer["event_mismatches"] == 120 and fewer["max_score_delta"] == pytest.approx(0.25)


def test_review_queue(spark, cohort):
    cases, events = cohort
    cases = cases.withColumn("discharged_at", F.lit("2026-01-05 00:00:00").cast("timestamp"))
    features = T.trigger_features(events)
    scores, pushes = MODEL.score(features), MODEL.contributions(features)
    reviews = cases.limit(5).select(*KEY)
    findings = cases.select(*KEY, F.lit(0).alias("case_ordinal"), F.lit(0).alias("position"),
                            F.lit("Text.").alias("sentence"), F.lit("neutral").alias("label"), F.lit(0.5).alias("probability"))
    now = F.lit("2026-01-12 00:00:00").cast("timestamp")
    queue = review_queue(cases, events, scores, pushes, 7, now, reviews, findings)
    rows = queue.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 8))
    assert not {r["case_id"] for r in rows} & set(ids(reviews))
    first = rows[0]
    assert first["waiting_days"] == 7 and first["stale"] and first["event_count"] == 4
    assert [e["event_type"] for e in first["timeline"]] == ["admission", "medication", "procedure", "lab"]
    assert [f["sentence"] for f in first["findings"]] == ["Text."]
    assert first["reason"].startswith("Unplanned OR return: Control of hemorrhage")


# --- nothing is lost -----------------------------------------------------------------
HEADER = "role,encounter_id,age,sex,admitted,discharged,time,name,value,units,to_unit\n"


def test_second_stream_on_the_same_store(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "store"))
    for n in (1, 2):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        (folder / "drop.csv").write_text(
            HEADER + "stays,1,67,F,2026-09-01T07:12:00,,,,,,\n" +
            "".join(f"labs,1,,,,,2026-09-0{n}T08:0{i}:00,CREAT,0.{i},mg/dL,\n" for i in range(3)))
        watch_drops(spark, str(folder), store, str(tmp_path / f"ckpt{n}")).awaitTermination()
    assert store.events().count() == 7


def test_the_last_of_repeated_stays_wins(spark, tmp_path):
    folder, store = tmp_path / "in", CaseStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "drop.csv").write_text(
        HEADER + "".join(f"stays,1,{age},F,2026-09-01T07:12:00,,,,,,\n" for age in (40, 10, 30, 20)))
    watch_drops(spark, str(folder), store, str(tmp_path / "ckpt")).awaitTermination()
    row = store.cases().head()
    assert row["age"] == 20 and row["source_ordinal"] == 4


def test_without_positions_the_winner_does_not_depend_on_partitions(spark):
    rows = [("s", "1", None, age) for age in (10, 40, 20, 30)]
    df = spark.createDataFrame(rows, "source string, case_id string, source_ordinal bigint, age int")
    assert {merge.last_by_key(df.repartition(n), KEY, "source_ordinal").head()["age"] for n in (1, 2, 3, 4)} == {40}


@pytest.mark.parametrize("field", ["discharged", "time"])
def test_unreadable_times_are_errors(spark, tmp_path, field):
    store = CaseStore(spark, str(tmp_path / "store"))
    bad = {"discharged": "", "time": "2026-09-01T08:00:00", field: "soon"}
    tables = drop(spark, [("1", "5", "F", "2026-09-01T07:12:00", bad["discharged"])], meds=[("1", bad["time"], "x")])
    with pytest.raises(Exception, match="not a time: soon"):
        nightly.ingest(store, tables)
    nightly.ingest(store, drop(spark, [("1", "5", "F", "2026-09-01T07:12:00", " ")], meds=[("1", " ", "x")]))
    assert store.events().count() == 1


def test_a_moved_log_and_a_broken_log_are_errors(spark, tmp_path, first_drop):
    store = CaseStore(spark, str(tmp_path / "store"))
    nightly.ingest(store, first_drop)
    at = store.last()
    store.upsert_cases(store.cases())
    with pytest.raises(StoreMoved):
        store.write("cases", store.cases(), full=True, after=at)
    assert store.cases().count() == 3 and store.last() == at + 1
    (tmp_path / "store" / "commits" / f"{at:012d}.json").write_text("no commit")
    with pytest.raises(Exception):
        store.upsert_cases(store.cases())


def test_a_run_id_is_recorded_once(spark, tmp_path, first_drop):
    store = CaseStore(spark, str(tmp_path / "store"))
    nightly.ingest(store, first_drop)
    scores = store.cases().select(*KEY, F.lit(0.5).alias("score"))
    parts = store.cases().select(*KEY, F.lit("f").alias("feature"), F.lit(1.0).alias("contribution"))
    for _ in range(2):
        store.write_scores(scores, parts, "logistic", run_id="run")
    assert merge.run_contributions(store.read("scores"), store.read("contributions")).count() == 3


def test_equivalence_counts_what_one_side_lacks(spark, cohort):
    cases, events = cohort
    cases = cases.select("*", F.lit(1).alias("age"), F.lit("F").alias("gender"), F.lit("s").alias("scenario"),
                         F.lit("l").alias("label_source"), F.lit(1).alias("source_ordinal"))
    features = T.trigger_features(events)
    none = equivalence_report(cases, events, features, MODEL.score(features), cases, events, features.limit(0), MODEL.score(features.limit(0))).head()
    assert not none["equivalent"] and none["unmatched_features"] == none["unmatched_scores"] == 120
    turned = events.withColumn("case_ordinal", F.lit(100) - F.col("case_ordinal"))
    moved = equivalence_report(cases, events, features, MODEL.score(features), cases, turned, features, MODEL.score(features)).head()
    assert not moved["equivalent"] and moved["moved_events"] == 120 and moved["event_mismatches"] == 0
