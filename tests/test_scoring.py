import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import scoring as S
from tracewell.operators.queue import headline_reason, ranked_contributions


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        label = rng.random() < 0.25
        a, b = float(rng.random() < (0.8 if label else 0.1)), float(rng.randrange(4))
        noise = float(rng.random() < 0.5)
        rows.append(("test", f"c{i}", a, b * (1.5 if label else 1.0), noise, label))
    return spark.createDataFrame(
        rows, "source string, case_id string, alpha double, beta double, noise double, label boolean"
    ).cache()


@pytest.fixture(scope="module")
def features(cohort):
    return cohort.drop("label")


def test_logistic_reaches_the_balanced_optimum(cohort):
    model = S.ScoringModel.fit(cohort)
    rows = cohort.collect()
    pos = sum(r["label"] for r in rows)
    grad = dict(model.weights) | {"_": 0.0}
    for r in rows:
        z = model.intercept + sum(w * r[n] for n, w in model.weights.items())
        weight = len(rows) / (2 * pos) if r["label"] else len(rows) / (2 * (len(rows) - pos))
        error = weight * (1 / (1 + math.exp(-z)) - r["label"])
        grad["_"] += error
        for n in model.weights:
            grad[n] += error * r[n]
    assert max(abs(g) for g in grad.values()) < 1e-3


def test_contributions_add_up_to_the_logit(cohort, features):
    model = S.ScoringModel.fit(cohort)
    rows = model.breakdown(features).collect()
    assert len(rows) == 400 and all(abs(r["gap"]) < 1e-9 for r in rows)
    parts = model.contributions(features)
    assert parts.where("value = 0 or contribution = 0").count() == 0


def test_tree_contributions_are_the_change_from_the_root(cohort, features):
    model = S.ScoringModel.fit(cohort, "tree")
    root = model.nodes[1].risk
    rows = model.breakdown(features).collect()
    assert len(rows) == 400
    assert all(abs(root + r["sum_of_path_changes"] - r["probability"]) < 1e-6 for r in rows)
    absent = model.contributions(features).where("value = 0").collect()
    assert absent and all(r["description"].endswith("absent") for r in absent)
    assert S.ScoringModel.fit(cohort, "tree").feature_table(cohort.sparkSession).count() == 3


def test_training_report(cohort, features):
    trained = S.train(features, cohort.select("source", "case_id", "label"))
    r = trained.report
    assert r["roc_auc"] > 0.85 and r["n_train"] + r["n_test"] == 400 and r["n_test"] == 120
    assert r["cv_roc_auc_mean"] > 0.8 and r["cv_roc_auc_std"] >= 0
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 120
    assert trained.sweep.count() == 17
    assert trained.model.weights["alpha"] > 0


def test_single_class_and_unknown_type_are_refused(cohort, features):
    with pytest.raises(ValueError):
        S.ScoringModel.fit(cohort.where("label"))
    with pytest.raises(ValueError):
        S.ScoringModel.fit(cohort, "forest")
    with pytest.raises(ValueError):
        S.train(features, cohort.where("label").select("source", "case_id", "label"))


def test_null_labels_do_not_train(cohort):
    more = cohort.unionByName(
        cohort.limit(40).withColumn("case_id", F.concat(F.lit("x"), "case_id"))
        .withColumn("label", F.lit(None).cast("boolean")))
    a, b = S.ScoringModel.fit(cohort), S.ScoringModel.fit(more)
    assert all(abs(a.weights[n] - b.weights[n]) < 1e-6 for n in a.weights)


def test_feature_matrix_fills_and_sorts(spark, features):
    cases = features.select("source", "case_id")
    extra = features.limit(3).select("source", "case_id", F.lit(2.0).alias("aaa"))
    wide = S.feature_matrix(cases, features, extra)
    assert wide.columns == ["source", "case_id", "aaa", "alpha", "beta", "noise"]
    assert wide.where("aaa = 2").count() == 3 and wide.where("aaa = 0").count() == 397


def test_ablation(cohort):
    cases = cohort.select("source", "case_id", "label")
    one = lambda c, e: cohort.select("source", "case_id", "noise")
    two = lambda c, e: cohort.select("source", "case_id", "alpha")
    rows = {r["arm"]: r for r in S.ablation(cases, cohort, {"noise": [one], "both": [one, two]}).collect()}
    assert rows["both"]["average_precision"] > rows["noise"]["average_precision"]


def test_headline_reason_falls_back(spark, make_cases):
    listed = make_cases([("a", None), ("b", None), ("c", None)])
    evidence = spark.createDataFrame(
        [("test", "a", 1, None, None, "later"), ("test", "a", 0, None, None, "first")],
        "source string, case_id string, section int, ts timestamp, case_ordinal bigint, text string")
    pushes = spark.createDataFrame(
        [("test", "a", "hemoglobin_drop", 1.0), ("test", "b", "hemoglobin_drop", 0.5),
         ("test", "b", "other", 0.9), ("test", "c", "other", -1.0)],
        "source string, case_id string, feature string, contribution double")
    got = {r["case_id"]: r["reason"] for r in headline_reason(listed, evidence, pushes).collect()}
    assert got == {"a": "first", "b": "other", "c": "Flagged for a second look"}
    assert ranked_contributions(pushes, 1).count() == 3
