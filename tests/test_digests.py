"""The hash tree: what it finds, what it clears, and what it leaves unread."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import digests as D
from tracewell.plans import equivalence as E

KEY = ["source", "case_id"]
NAMES = "source string, case_id string, case_ordinal bigint, event_id string, event_type string, t string, value string, details string"
FIELDS = (0, 1, 3, 4, 5, 6, 7)


def frame(spark, rows):
    return spark.createDataFrame(rows, NAMES).withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def random_rows(rng, n=600):
    pick = lambda: rng.choice([None, "a", "b", ""])
    return [("s", rng.choice([None, *map(str, range(40))]), i, f"e{i % 50}", "lab", rng.choice([None, "2026-01-01 00:00:00"]), pick(), pick())
            for i in range(n)]


def brute(a, b):
    """Surplus per row, and the keys with an event of equal number on both sides at other places."""
    content = lambda rows: Counter(tuple(r[i] for i in FIELDS) for r in rows)
    x, y = content(a), content(b)
    surplus = {r: x[r] - y[r] for r in x | y if x[r] != y[r]}
    places = lambda rows, c: Counter(r[2] for r in rows if tuple(r[i] for i in FIELDS) == c)
    moved = {r[:2] for r in x if x[r] == y[r] and places(a, r) != places(b, r)}
    return surplus, moved


@pytest.mark.parametrize("seed", range(3))
def test_the_tree_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    a = random_rows(rng)
    b = [list(r) for r in a]
    for r in rng.sample(b, 6):
        r[6], r[7] = r[7], r[6]             # also where one of them is null
    for r in rng.sample(b, 6):
        r[2] += 1000
    b = [tuple(r) for r in b] + rng.sample(a, 3)
    rng.shuffle(b)
    surplus, moved = brute(a, b)
    left, right = frame(spark, a), frame(spark, b).repartition(3)
    report = E.compare_events(left, right)
    assert (report.found.left_rows, report.found.right_rows) == (600, 603)
    assert report.mismatches == len({r[:2] for r in surplus}) and report.moved == len(moved)
    got = E.event_mismatches(left, right).withColumn("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    names = ["source", "case_id", "event_id", "event_type", "t", "value", "details"]
    assert {tuple(r[n] for n in names): r["surplus"] for r in got.collect()} == surplus


def test_equal_copies_meet_no_rows(spark, monkeypatch):
    rows = random_rows(random.Random(9))
    left, right = frame(spark, rows), frame(spark, rows[::-1])
    def fail(*_):
        raise AssertionError("rows were compared")
    monkeypatch.setattr(E, "moved_events", fail)
    monkeypatch.setattr(E, "differing_keys", fail)
    report = E.compare_events(left, right)
    assert report.found.buckets == [] and report.mismatches == report.moved == 0
    assert E.event_mismatches(left, right).count() == 0


def test_only_differing_buckets_are_read(spark):
    rows = random_rows(random.Random(4))
    other = [(*r[:6], "new", r[7]) if r[1] == "7" else r for r in rows]
    left, right = frame(spark, rows), frame(spark, other)
    found = D.differing_buckets(left, right, KEY, E.EVENT_FIELDS)
    assert len(found.buckets) == 1
    assert found.among(left, KEY).count() < 40
    assert {r["case_id"] for r in D.differing_keys(left, right, KEY, E.EVENT_FIELDS, ["case_ordinal"]).collect()} == {"7"}


def test_empty_sides(spark):
    rows = frame(spark, random_rows(random.Random(1), 20))
    none = rows.limit(0)
    assert E.compare_events(none, none) == E.EventReport(D.Differences(0, 0, []))
    report = E.compare_events(rows, none)
    assert report.found.right_rows == 0 and report.moved == 0
    assert report.mismatches == rows.select(*KEY).distinct().count()
