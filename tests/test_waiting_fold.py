"""The fold of deliveries into the state of the stale flags, against a plain fold case by case."""

import datetime as dt
import random

from tracewell.streaming.waiting import DAY, NEWS, SCORE, STATE, STAY, flags_of, folded

START = dt.datetime(2026, 1, 1)
MS = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def plain(held, rows, before, after, days):
    """(state, flags) after a batch."""
    told, by_case = [], {}
    for _, case, kind, at, out in rows:
        by_case.setdefault(case, []).append((MS(at), kind == SCORE, MS(out) if out else None))
    for case in {*held, *by_case}:
        discharged, delivered, scored, flagged = held.get(case, (None, None, None, False))
        for at, score, out in sorted(by_case.get(case, []), key=lambda r: (r[0], r[1], r[2] or 0)):
            if score:
                scored = at if scored is None else min(at, scored)
            elif delivered is None or at >= delivered:
                if out != discharged and delivered is not None:
                    scored, flagged = None, False
                discharged, delivered = out, at
        due = None if discharged is None else discharged + days * DAY
        if due is not None and not flagged and (scored is None or scored >= due) and due <= after:
            told.append((case, discharged, case in by_case and due <= before))
            flagged = True
        held[case] = (discharged, delivered, scored, flagged)
    return sorted(told)


def test_batches_against_a_plain_fold(spark):
    rng = random.Random(5)
    held, clock = {}, 0
    state = spark.createDataFrame([], STATE)
    for batch in range(3):
        rows = []
        for _ in range(150):
            at = START + dt.timedelta(days=4 * batch + rng.randrange(1, 5))
            out = START + dt.timedelta(days=rng.randrange(-9, 6)) if rng.random() < 0.8 else None
            kind = SCORE if rng.random() < 0.25 else STAY
            rows.append(("s", f"c{rng.randrange(40)}", kind, at, out if kind == STAY else None))
        after = max(MS(r[3]) for r in rows)
        news = spark.createDataFrame(rows + rows[:20], NEWS)
        out = folded(state, news, clock, after, 7)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
        want = plain(held, rows, clock, after, 7)
        got = [(r["case_id"], MS(r["discharged_at"]), r["late"]) for r in flags_of(out, 7).collect()]
        assert sorted(got) == want and (batch == 0 or want)
        assert {r["case_id"]: tuple(r["held"]) for r in out.collect()} == held
        state, clock = out.localCheckpoint(), after
