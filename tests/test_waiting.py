"""The stale flag as a stream: timers, late, repeated and reopened stays, scores in time and too late."""

import datetime as dt

import pytest

from tracewell.streaming.waiting import NEWS, watch_waiting

T = lambda s: dt.datetime.fromisoformat(s)


@pytest.fixture
def stream(spark, tmp_path):
    def run(rows):
        if rows:
            data = [("s", c, kind, T(at), T(out) if out else None) for c, kind, at, out in rows]
            spark.createDataFrame(data, NEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "news"))
        watch_waiting(spark, str(tmp_path / "news"), str(tmp_path / "flags"), str(tmp_path / "ckpt")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "flags")).collect()
        return sorted((r["case_id"], r["discharged_at"], r["stale_at"] - r["discharged_at"], r["late"]) for r in got)

    return run


def test_flags(stream):
    week = dt.timedelta(days=7)
    flag = lambda c, out, late=False: (c, T(out), week, late)
    assert stream([
        ("waits", "stay", "2026-01-02", "2026-01-01 10:30:00.250"), ("open", "stay", "2026-01-02", None),
        ("scored", "stay", "2026-01-02", "2026-01-01"), ("scored", "score", "2026-01-02", None),
        ("reopened", "stay", "2026-01-02", "2026-01-01"), ("old", "stay", "2026-01-02", "2025-12-01"),
        ("twice", "stay", "2026-01-02", "2026-01-01"), ("twice", "stay", "2026-01-02", "2026-01-01"),
    ]) == [flag("old", "2025-12-01")]
    # seven days pass by the clock of other deliveries; a score after that comes too late, a repeat changes nothing
    second = stream([
        ("reopened", "stay", "2026-01-05", None), ("clock", "stay", "2026-01-20", None),
        ("late", "stay", "2026-01-20", "2026-01-03"), ("twice", "stay", "2026-01-20", "2026-01-01"),
    ])
    want = [flag("late", "2026-01-03"), flag("old", "2025-12-01"), flag("twice", "2026-01-01"), flag("waits", "2026-01-01 10:30:00.250")]
    assert [(c, o, w) for c, o, w, _ in second] == [(c, o, w) for c, o, w, _ in want]
    third = stream([
        ("waits", "score", "2026-01-21", None), ("old", "stay", "2026-01-21", "2025-12-01"),
        ("open", "stay", "2026-01-21", "2026-01-20"), ("late", "stay", "2026-01-21", "2026-01-15"),
    ])
    assert [(c, o) for c, o, _, _ in third] == [(c, o) for c, o, _, _ in want]
    # the corrected discharge of `late` waits anew
    last = stream([("clock", "stay", "2026-03-01", None)])
    assert {(c, o) for c, o, _, _ in last} - {(c, o) for c, o, _, _ in want} == {("late", T("2026-01-15")), ("open", T("2026-01-20"))}
    assert stream([]) == last


def test_a_score_may_come_first(stream):
    assert stream([("a", "score", "2026-01-01", None), ("b", "score", "2026-01-01", None)]) == []
    got = stream([("a", "stay", "2026-01-02", "2026-01-01"), ("b", "stay", "2026-01-02", "2025-12-01"), ("x", "stay", "2026-06-01", None)])
    assert [c for c, *_ in got] == ["b"]        # stale before it was scored
