import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import metrics as M
from tracewell.operators import queue as Q
from tracewell.operators import resample as R
from tracewell.operators import trust


def scored_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.random() < 0.3
        score = round(min(1.0, max(0.0, rng.gauss(0.6 if label else 0.4, 0.2))), 1)
        rows.append((f"c{i}", score, label))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        [("test", c, s, y) for c, s, y in scored_rows()],
        "source string, case_id string, score double, label boolean",
    ).withColumn("discharged_at", F.lit(None).cast("timestamp"))


def test_ranking_quality_against_brute_force(scored):
    rows = scored_rows()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap, tp_before = 0.0, 0
    for cut in sorted({s for _, s, _ in rows}, reverse=True):
        tp, k = sum(p >= cut for p in pos), sum(s >= cut for _, s, _ in rows)
        ap += (tp - tp_before) / len(pos) * tp / k
        tp_before = tp
    brier = sum((s - y) ** 2 for _, s, y in rows) / len(rows)
    got = M.ranking_quality(scored).head()
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    assert got["brier"] == pytest.approx(brier) and got["pr_lift"] == pytest.approx(ap / (len(pos) / len(rows)))


def test_one_class_has_no_ranking_measures(scored):
    got = M.ranking_quality(scored.where("label")).head()
    assert got["roc_auc"] is None and got["average_precision"] is None and got["brier"] is not None


def test_unlabelled_rows_are_left_out(scored):
    more = scored.unionByName(scored.limit(50).withColumn("label", F.lit(None).cast("boolean")))
    assert M.ranking_quality(more).head()["cases"] == 400


def test_confusion_and_sweep_agree(scored):
    at = M.confusion(scored, 0.5).head()
    row = M.threshold_sweep(scored).where("threshold = 0.5").head()
    assert row["flagged"] == at["tp"] + at["fp"] and row["f1"] == pytest.approx(at["f1"])
    nothing = M.confusion(scored, 2.0).head()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0.0, 0.0, 0.0)


def test_capacities_beyond_the_cohort_are_left_out(scored):
    few = scored.limit(60)
    table = M.capacity_table(Q.top_of_queue(few, 200), few).orderBy("reviewing_top").collect()
    assert [r["reviewing_top"] for r in table] == [10, 25, 50]


def test_gain_curve_against_brute_force(scored):
    rows = sorted(scored_rows(), key=lambda r: (-r[1], r[0]))
    want = []
    for step in range(41):
        cut = round(step / 40 * len(rows))
        want.append((cut / len(rows), sum(y for _, _, y in rows[:cut]) / sum(y for _, _, y in rows)))
    got = trust.gain_curve(scored, Q.queue_order()).orderBy("step").collect()
    assert [(r["review_share"], r["harm_found"]) for r in got] == want
    at = trust.lift_at(trust.gain_curve(scored, Q.queue_order()), 0.1).head()
    assert at["harm_found"] == want[4][1] and at["lift_multiple"] == pytest.approx(want[4][1] / 0.1)


def test_gain_curve_edges(scored):
    none = trust.gain_curve(scored.where("not label"), Q.queue_order()).collect()
    assert len(none) == 41 and all(r["harm_found"] == 0 for r in none)
    empty = trust.gain_curve(scored.where("false"), Q.queue_order()).collect()
    assert [(r["review_share"], r["harm_found"]) for r in empty] == [(0.0, 0.0), (1.0, 1.0)]


def test_ties_put_the_oldest_discharge_first(spark):
    rows = [("s", "new", 0.9, "2026-09-12 11:00:00"), ("s", "old", 0.9, "2026-09-05 16:00:00"),
            ("s", "open", 0.9, None), ("s", "top", 0.95, None)]
    df = spark.createDataFrame(rows, "source string, case_id string, score double, d string").withColumn(
        "discharged_at", F.col("d").cast("timestamp"))
    ranked = Q.top_of_queue(df, 10).orderBy("rank").collect()
    assert [r["case_id"] for r in ranked] == ["top", "old", "new", "open"]
    assert Q.top_of_queue(df, 0).count() == 1


# --- trust ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def audited(spark):
    """100 positives, 100 negatives: perfect, partial, rare and dead features."""
    rows = []
    for i in range(200):
        label = i < 100
        rows.append(("test", f"c{i}", label, float(label), float(label or i % 2), float(i < 5), 0.0))
    return spark.createDataFrame(
        rows, "source string, case_id string, label boolean, perfect double, partial double, "
        "rare double, dead double",
    )


def test_leakage_by_feature(audited):
    meanings = {n: n for n in ("perfect", "partial", "rare", "dead")}
    coverage = trust.trigger_coverage(audited.drop("label"), audited, meanings)
    rows = {r["feature"]: r for r in trust.leakage_by_feature(coverage).collect()}
    assert rows["perfect"]["leaking"] and rows["perfect"]["separation"] == pytest.approx(1.0)
    assert not rows["partial"]["leaking"] and not rows["rare"]["leaking"]
    assert rows["dead"]["dead"] and rows["dead"]["support"] == 0
    assert [r["trigger"] for r in trust.dark_triggers(coverage).collect()] == ["dead"]
    assert trust.weak_triggers(coverage).count() == 0
    order = [r["trigger"] for r in trust.by_lift(coverage).collect()]
    assert order[-1] == "dead" and set(order[:2]) == {"perfect", "rare"}


def test_null_labels_count_as_cases_only(audited):
    more = audited.withColumn("label", F.when(F.col("case_id") != "c0", F.col("label")))
    row = trust.trigger_coverage(audited.drop("label"), more, {"perfect": "p"}).head()
    assert row["cases"] == 100 and row["labelled_cases"] == 99 and row["base_rate"] == pytest.approx(99 / 199)


def test_giveaways_count_once_per_case(make_events, make_cases):
    at = "2026-01-01 00:00:00"
    rows = [(f"c{i}", "medication", at, "Tell ", "") for i in range(40) for _ in range(3)]
    rows += [(f"c{i}", "procedure", at, "Common", "") for i in range(80)]
    rows += [(f"c{i}", "lab", at, "Lab", "1") for i in range(40)] + [("c1", "medication", at, " ", "")]
    labels = make_cases([(f"c{i}", i < 40) for i in range(80)])
    rates = trust.value_label_rates(make_events(rows), labels)
    got = {r["value"]: (r["support"], r["label_rate"]) for r in rates.collect()}
    assert got == {"Tell": (40, 1.0), "Common": (80, 0.5)}
    found = trust.giveaway_values(rates)
    assert [r["value"] for r in found.collect()] == ["Tell"]
    assert trust.giveaway_values(rates, min_support=41).count() == 0


# --- samples ---------------------------------------------------------------------
@pytest.mark.parametrize("positives,negatives,target", [(460, 540, 0.1), (50, 950, 0.1), (500, 500, 0.5),
                                                        (900, 100, 0.3)])
def test_prevalence_hits_the_target(make_cases, positives, negatives, target):
    cases = make_cases([(f"c{i}", i < positives) for i in range(positives + negatives)])
    kept = R.downsample_to_prevalence(cases, target)
    n, p = kept.count(), kept.where("label").count()
    assert abs(p / n - target) < 0.005
    assert kept.select("case_id").distinct().count() == n
    assert kept.exceptAll(R.downsample_to_prevalence(cases.repartition(3), target)).count() == 0
    summary = R.resample_summary(cases, kept, target).head()
    assert summary["kept"] + summary["dropped"] == positives + negatives


def test_prevalence_edges(make_cases):
    one_class = make_cases([(f"c{i}", True) for i in range(20)])
    assert R.downsample_to_prevalence(one_class).count() == 20
    for bad in (0.0, 1.0, -1, 2):
        with pytest.raises(ValueError):
            R.downsample_to_prevalence(one_class, bad)
    seeds = [set(r["case_id"] for r in R.downsample_to_prevalence(
        make_cases([(f"c{i}", i < 100) for i in range(200)]), 0.2, s).collect()) for s in (1, 2)]
    assert seeds[0] != seeds[1]


def test_split_guards_and_sizes(make_cases):
    with pytest.raises(ValueError):
        R.stratified_split(make_cases([(f"c{i}", i < 2) for i in range(9)]))
    with pytest.raises(ValueError):
        R.stratified_split(make_cases([(f"c{i}", True) for i in range(20)]))
    split = R.stratified_split(make_cases([(f"c{i}", i < 31) for i in range(101)]))
    counts = {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts[(True, True)] + counts[(False, True)] == 31
    assert abs(counts[(True, True)] - 31 * 0.307) <= 1


def test_folds_are_even_per_class(make_cases):
    folds = R.stratified_folds(make_cases([(f"c{i}", i < 33) for i in range(120)]), 5)
    sizes = [r["count"] for r in folds.groupBy("label", "fold").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 120
    assert max(s for s in sizes if s < 10) - min(sizes) <= 1


def test_samples_are_exact_when_sources_share_ids(spark):
    rows = [(s, f"c{i}", i % 3 == 0) for s in ("a", "b") for i in range(500)]
    cases = spark.createDataFrame(rows, "source string, case_id string, label boolean")
    for seed in range(4):
        keep, n = R.prevalence_plan(334, 666, 0.1)
        kept = R.downsample_to_prevalence(cases, 0.1, seed)
        assert kept.where("label").count() == keep and kept.where("not label").count() == n
    split = R.stratified_split(cases, 0.3)
    assert split.where("is_test").count() == 300
