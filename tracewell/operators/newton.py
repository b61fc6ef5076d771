"""Ridge logistic regression by Newton steps, each from one grouped aggregate.

The objective is the weighted log loss, summed, plus half the squared norm of the weights (the intercept is free).
Rows are first counted by their distinct feature vector and class, so a step reads the vectors that
differ, and its aggregate holds the loss, the gradient and the Hessian: (d + 1)(d + 4) / 2 + 1 sums for d features. The
solution of the (d + 1) x (d + 1) system is all that the driver does.

Sums are exact decimals, so the same rows give the same weights in any order and partitioning.
The objective is convex, and a step that does not lower it is halved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import materialize

EXACT = "decimal(38,16)"
STEPS = 60


@dataclass
class Fit:
    weights: dict[str, float]
    intercept: float
    gradient: dict[str, float]      # at the solution, per row; "" is the intercept's
    loss: float
    steps: int


def distinct_vectors(labelled: DataFrame, names: list[str], *by: str) -> DataFrame:
    """Feature vectors (x0, x1, ...) with the number of positive and of negative rows, for each value of the columns `by`."""
    count = lambda c: F.count_if(c).cast("double")
    columns = [F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)]
    # -0.0 and 0.0 are one value to the grouping
    return labelled.select(*columns, "label", *by).groupBy(*[f"x{i}" for i in range(len(names))], *by).agg(
        count(F.col("label")).alias("positive"), count(~F.col("label")).alias("negative"))


def _columns(d: int, beta: np.ndarray, weight_positive: float, weight_negative: float) -> tuple[dict[str, Column], list[Column]]:
    """What a row of vectors is given, one after the other, and the sums over all rows."""
    x = [F.lit(1.0), *(F.col(f"x{i}") for i in range(d))]
    logit = reduce(lambda a, b: a + b, (F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)))
    z, up, down = F.col("z"), F.col("positive") * weight_positive, F.col("negative") * weight_negative
    exact = lambda c: F.sum(c.cast(EXACT))
    p = 1 / (1 + F.exp(-z))
    # log(1 + exp(-|z|)) on both sides of zero
    tail = F.log1p(F.exp(-F.abs(z)))
    loss = up * (F.greatest(-z, F.lit(0.0)) + tail) + down * (F.greatest(z, F.lit(0.0)) + tail)
    error, curve = (up + down) * p - up, (up + down) * p * (1 - p)
    sums = [
        exact(F.col("loss")), *(exact(F.col("error") * c) for c in x),
        *(exact(F.col("curve") * x[i] * x[j]) for i, j in combinations_with_replacement(range(d + 1), 2)),
    ]
    return {"z": logit, "loss": loss, "error": error, "curve": curve}, sums


def _measure(vectors: DataFrame, d: int, beta: np.ndarray, weights: tuple[float, float], ridge: float):
    """Loss, gradient and Hessian at beta, in one aggregate."""
    columns, sums = _columns(d, beta, *weights)
    rows = vectors.withColumn("z", columns.pop("z")).withColumns(columns)
    got = [float(v) for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    hessian = np.zeros((d + 1, d + 1))
    for value, (i, j) in zip(got[d + 2:], combinations_with_replacement(range(d + 1), 2), strict=True):
        hessian[i, j] = hessian[j, i] = value
    free = np.array([0.0, *[ridge] * d])
    total = got[0] + 0.5 * float(free @ beta**2)
    return total, np.array(got[1:d + 2]) + free * beta, hessian + np.diag(free)


def fit_logistic(
    labelled: DataFrame, names: list[str], weight_positive: float, weight_negative: float,
    ridge: float = 1.0, tolerance: float = 1e-12,
) -> Fit:
    """labelled: features and a boolean label on every row; rows of both classes weigh as given."""
    vectors = materialize(distinct_vectors(labelled, names), "vectors")
    return fit_logistic_vectors(vectors, names, weight_positive, weight_negative, ridge, tolerance)


def fit_logistic_vectors(
    vectors: DataFrame, names: list[str], weight_positive: float, weight_negative: float,
    ridge: float = 1.0, tolerance: float = 1e-12,
) -> Fit:
    """vectors: a written table of distinct_vectors."""
    n = float(vectors.agg(F.sum(F.col("positive") + F.col("negative"))).first()[0])
    d, weights = len(names), (weight_positive, weight_negative)
    beta = np.zeros(d + 1)
    loss, gradient, hessian = _measure(vectors, d, beta, weights, ridge)
    for steps in range(1, STEPS + 1):
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if np.abs(gradient).max() / n < tolerance:
            break
        size = 1.0
        while True:
            found = _measure(vectors, d, beta - size * move, weights, ridge)
            if found[0] <= loss or size < 1e-6:
                break
            size /= 2
        if found[0] >= loss and np.abs(found[1]).max() >= np.abs(gradient).max():
            break               # as low as doubles tell
        beta = beta - size * move
        loss, gradient, hessian = found
    told = dict(zip(["", *names], (gradient / n).tolist(), strict=True))
    return Fit(dict(zip(names, beta[1:].tolist(), strict=True)), float(beta[0]), told, loss, steps)
