"""Newton steps against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators.newton import distinct_vectors, fit_logistic

NAMES = ["a", "b c", "d"]


def make(rng, n, scale=1.0):
    rows = []
    for _ in range(n):
        x = [float(rng.random() < 0.5), scale * rng.randrange(5), rng.gauss(0, 1) if rng.random() < 0.1 else 0.0]
        label = rng.random() < 1 / (1 + math.exp(1 - x[0] - 0.3 * x[1] / scale + x[2]))
        rows.append((*x, label))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, `b c` double, d double, label boolean")


def gradient(rows, beta, up, down, ridge):
    out = np.array([0.0, *(ridge * b for b in beta[1:])])
    for *x, label in rows:
        z = beta[0] + sum(b * v for b, v in zip(beta[1:], x))
        out += (up if label else down) * (1 / (1 + math.exp(-z)) - label) * np.array([1.0, *x])
    return out


@pytest.mark.parametrize(("n", "scale", "ridge", "up"), [(300, 1.0, 1.0, 1.5), (40, 100.0, 0.5, 1.0), (200, 1.0, 0.01, 30.0)])
def test_gradient_vanishes(spark, n, scale, ridge, up):
    rows = make(random.Random(n), n, scale)
    fit = fit_logistic(frame(spark, rows), NAMES, up, 1.0, ridge)
    beta = [fit.intercept, *(fit.weights[c] for c in NAMES)]
    assert np.abs(gradient(rows, beta, up, 1.0, ridge)).max() / n < 1e-10
    assert max(abs(g) for g in fit.gradient.values()) < 1e-10 and fit.steps < 30


def test_order_and_partitions_change_nothing(spark):
    rows = make(random.Random(5), 500)
    first = fit_logistic(frame(spark, rows).coalesce(1), NAMES, 2.0, 1.0)
    random.Random(1).shuffle(rows)
    assert fit_logistic(frame(spark, rows).repartition(7), NAMES, 2.0, 1.0) == first


def test_classes_that_a_feature_separates(spark):
    rows = [(1.0, 0.0, 0.0, True)] * 50 + [(0.0, 0.0, 0.0, False)] * 50
    fit = fit_logistic(frame(spark, rows), NAMES, 1.0, 1.0)
    assert 2 < fit.weights["a"] < 10 and fit.weights["b c"] == 0.0
    beta = [fit.intercept, *fit.weights.values()]
    assert np.abs(gradient(rows, beta, 1.0, 1.0, 1.0)).max() < 1e-8


def test_a_step_reads_distinct_vectors(spark):
    df = frame(spark, [(float(i % 2), 1.0, -0.0 if i % 3 else 0.0, i % 5 == 0) for i in range(1000)])
    got = distinct_vectors(df, NAMES)
    assert got.count() == 2 and got.agg(F.sum(F.col("positive") + F.col("negative"))).first()[0] == 1000
