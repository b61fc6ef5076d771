"""Census and coverage that follow from what commits added and replaced."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.functions import fixed_values as fixed
from tracewell.operators.cohort import stay_census
from tracewell.operators.timeline import trigger_features
from tracewell.operators.trust import trigger_coverage
from tracewell.plans.coverage import kept_coverage
from tracewell.sources import commit_log as L
from tracewell.sources.store import CaseStore

KINDS = "source string, case_id string, label boolean, discharged_at string"
EVENT = "source string, case_id string, event_id string, event_type string, ts string, value string, details string"


def stays(spark, rows):
    return spark.createDataFrame(rows, KINDS).withColumn("discharged_at", F.col("discharged_at").cast("timestamp"))


def events(spark, rows):
    at = F.col("ts").cast("timestamp")
    return spark.createDataFrame([("s", *r, None) for r in rows], EVENT).withColumn("ts", at)


def told(df):
    return sorted(tuple(r) for r in df.select("source", "total", "in_house", "discharged").collect())


def rates(df):
    return sorted(repr(tuple(r[n] for n in sorted(df.columns))) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return CaseStore(spark, str(tmp_path / "store"), buckets=8)


def test_the_census_follows_the_commits(spark, store, monkeypatch):
    assert told(store.census()) == []
    out = "2026-01-03 00:00:00"
    monkeypatch.setattr(L, "CHECKPOINT", 3)
    drops = [
        [("s", str(i), None, None) for i in range(20)],
        [("s", str(i), True, out) for i in range(10, 25)] + [("t/ü", "1", None, None)],
        [("s", "3", None, out), ("s", "12", None, None), ("t/ü", "1", None, out), ("t/ü", "2", None, None)],
        [("t/ü", "2", None, None)],
    ]
    for rows in drops:
        store.upsert_cases(stays(spark, rows))
        assert told(store.census()) == told(stay_census(store.cases()))
    assert told(store.census()) == [("s", 25, 10, 15), ("t/ü", 2, 1, 1)]
    assert told(store.census("s")) == [("s", 25, 10, 15)]
    store.write("cases", store._conform(stays(spark, [("s", "new", None, None)]), "cases"), full=False)
    assert told(store.census("s")) == [("s", 26, 11, 15)]
    store.compact("cases")
    assert told(store.census("s")) == [("s", 26, 11, 15)]
    store.write("cases", store._conform(stays(spark, [("u", "1", None, None)]), "cases"), full=True)
    assert told(store.census()) == [("u", 1, 1, 0)]


def test_the_census_reads_no_case(spark, store, monkeypatch):
    store.upsert_cases(stays(spark, [("s", str(i), None, None) for i in range(20)]))
    def fail(*_):
        raise AssertionError("cases were read")
    monkeypatch.setattr(store, "read_folders", fail)
    assert told(store.census()) == [("s", 20, 20, 0)]


def test_folders_without_counts_are_counted(spark, store):
    store.upsert_cases(stays(spark, [("s", str(i), None, None) for i in range(20)]))
    folder = os.path.join(store.root, "commits")
    for name in os.listdir(folder):
        if name.endswith(".json"):
            path = os.path.join(folder, name)
            with open(path) as f:
                writes = json.load(f)
            for w in writes:
                w.pop("census")
            with open(path, "w") as f:
                json.dump(writes, f)
            if os.path.exists(check := os.path.join(folder, f".{name}.crc")):
                os.unlink(check)
    store.upsert_cases(stays(spark, [("s", "1", None, "2026-01-03 00:00:00")]))
    assert told(store.census()) == told(stay_census(store.cases())) == [("s", 20, 19, 1)]


def test_coverage_counts_touched_buckets_only(spark, store):
    whole = lambda: trigger_coverage(trigger_features(store.events(), store.cases()), store.cases(), fixed.TRIGGER_MEANINGS)
    store.upsert_cases(stays(spark, [("s", str(i), i % 3 == 0 if i % 4 else None, None) for i in range(60)]))
    at = "2026-01-0{} 00:00:00".format
    store.append_events(events(spark, [(str(i), f"m{i}", "medication", at(2), "Naloxone") for i in range(0, 60, 5)]))
    first = kept_coverage(store)
    assert first.counted == first.live == 8 and rates(first.coverage) == rates(whole())
    again = kept_coverage(store)
    assert again.counted == 0 and rates(again.coverage) == rates(whole())
    store.append_events(events(spark, [("7", "p", "procedure", at(1), "Appendectomy"), ("7", "n", "medication", at(3), "Naloxone")]))
    one = kept_coverage(store)
    assert one.counted == 1 and rates(one.coverage) == rates(whole()) != rates(first.coverage)
    store.upsert_cases(stays(spark, [("s", "5", True, None), ("other", "5", False, None)]))
    two = kept_coverage(store)
    assert two.counted == 2 and two.live == 9 and rates(two.coverage) == rates(whole())
    assert kept_coverage(store, anchor="admission").counted == 9
    # counts of replaced parts are gone
    assert store.read("coverage").select("source", "bucket").distinct().count() == 9
