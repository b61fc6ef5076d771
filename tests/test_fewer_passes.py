"""Steps that read, move or ask less than they did, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import metrics as M
from tracewell.operators import note_model as NM
from tracewell.operators import ordering as O
from tracewell.operators import scoring as S
from tracewell.operators.resample import stratified_folds
from tracewell.schema import KEY
from tracewell.sources import store as ST


def test_terms_meet_without_a_join(spark):
    """Each term carries its frequency from where its rows meet; no table of frequencies is joined to the terms."""
    df = spark.createDataFrame([(1, "pump ran pump"), (2, "pump stopped"), (2, "ran"), (None, "pump")], "id int, text string")
    found = NM.tfidf(df, ["id"], "text")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.term): (r.tf, r.df) for r in found.collect()}
    assert got[1, "pump"] == (2, 3) and got[2, "ran"] == (1, 2) and got[None, "pump"] == (1, 3) and got[1, "pump ran pump"] == (1, 1)


@pytest.mark.parametrize("kind", ["logistic", "tree"])
def test_cross_validation_from_counts(spark, monkeypatch, kind):
    """Folds are fitted and measured from counted vectors, and give what their rows give."""
    rng = random.Random(4)
    rows = [("s", f"c{i}", float(rng.randint(0, 2)), float(rng.randint(0, 1)), rng.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "source string, case_id string, a double, b double, label boolean")
    folded = stratified_folds(df, 5, 7).persist()
    measured = []
    for fold in range(5):
        model = S.ScoringModel.fit(folded.where(F.col("fold") != fold), kind, names=["a", "b"])
        measured.append(M.ranking_quality(model.score(folded.where(F.col("fold") == fold))).head())
    monkeypatch.setattr(S.ScoringModel, "fit", None)
    got = S.cross_validation(df, ["a", "b"], kind)
    for name in ("roc_auc", "average_precision"):
        assert got[f"cv_{name}_mean"] == pytest.approx(sum(r[name] for r in measured) / 5, abs=1e-12)


@pytest.mark.parametrize("long_key", [3, 2_000_000])
def test_short_keys_need_no_ranges(spark, monkeypatch, long_key):
    monkeypatch.setattr(O, "LONG_KEY", long_key)
    monkeypatch.setattr(O, "LOOKED_AT", 1.0)
    if long_key > 3:
        monkeypatch.setattr(O, "_ranged", None)
    rows = [(k, i) for i, k in enumerate(["a", "b", None, "a", "a", None, "c", None, "a", "b"])]
    df = spark.createDataFrame(rows, "k string, t int").repartition(3)
    got = {(r.k, r.t): r.n for r in O.number_within(df, ["k"], [F.col("t")], "n").collect()}
    assert got == {(k, i): sum(1 for x, j in rows if x == k and j <= i) for k, i in rows}


@pytest.mark.parametrize("first_asked", [1, 1 << 40])
def test_a_few_events_find_the_parts_that_hold_them(spark, tmp_path, make_events, make_cases, monkeypatch, first_asked):
    monkeypatch.setattr(ST, "FIRST_ASKED", first_asked)
    asked, plain = [], ST.may_hold
    monkeypatch.setattr(ST, "may_hold", lambda filters, incoming: asked.append(1) or plain(filters, incoming))
    store = ST.CaseStore(spark, str(tmp_path / "store"), buckets=1)
    store.upsert_cases(make_cases([("c", True)]))
    drop = [("c", "lab", "2026-01-01 00:00:00", "WBC", "5"), ("c", "lab", "2026-01-02 00:00:00", "WBC", "6")]
    assert store.append_events(make_events(drop)) == 2
    asked.clear()
    assert store.append_events(make_events(drop)) == 0
    assert len(asked) == (1 if first_asked == 1 else 2)
    assert store.append_events(make_events([*drop, ("c", "lab", "2026-01-03 00:00:00", "WBC", "7")])) == 1
    assert store.events().select(*KEY, "event_id").distinct().count() == 3
