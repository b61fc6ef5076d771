"""Interpretable scoring: fit, score, and take each score apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators import metrics as M
from tracewell.operators.exact_tree import Node, fit_tree_vectors, importances, leaf_paths, node_of
from tracewell.operators.newton import distinct_vectors, fit_logistic_vectors
from tracewell.operators.resample import class_sizes, stratified_folds, stratified_split
from tracewell.schema import KEY
from tracewell.session import materialize

MODEL_TYPES = ("logistic", "tree")
TREE_DEPTH = 5
TREE_LEAF = 10
ABSENT = " — absent"


def feature_matrix(cases: DataFrame, *feature_tables: DataFrame) -> DataFrame:
    """All features of all cases, names sorted, absent values zero."""
    wide = cases.select(*KEY)
    names = []
    for features in feature_tables:
        names += [c for c in features.columns if c not in KEY]
        wide = wide.join(features, KEY, "left")
    return wide.select(*KEY, *sorted(names)).fillna(0.0, names)


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in (*KEY, "label", "is_test", "fold")]


def _balanced(vectors: DataFrame) -> tuple[float, float]:
    """What a positive and a negative row weigh, so that both classes weigh the same."""
    sizes = vectors.agg(F.coalesce(F.sum("positive"), F.lit(0.0)), F.coalesce(F.sum("negative"), F.lit(0.0))).first()
    positives, negatives = map(int, sizes)
    if not positives or not negatives:
        raise ValueError("the labelled sample holds one class only")
    n = positives + negatives
    return n / (2 * positives), n / (2 * negatives)


# --- logistic -------------------------------------------------------------------
def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """Probability from weights, as one column expression."""
    logit = F.lit(float(intercept))
    for name, weight in weights.items():
        logit = logit + F.col(name) * F.lit(float(weight))
    return 1 / (1 + F.exp(-logit))


def linear_contributions(
    features: DataFrame, weights: dict[str, float], meanings: dict[str, str] | None = None
) -> DataFrame:
    """(case, feature, value, weight, contribution), one row per feature that counts."""
    meanings = meanings or {}
    long = features.select(*KEY, *[F.col(n).cast("double") for n in weights]).unpivot(
        KEY, list(weights), "feature", "value"
    )
    weight = C.lookup(F.col("feature"), {k: float(v) for k, v in weights.items()})
    described = F.coalesce(C.lookup(F.col("feature"), meanings), F.col("feature"))
    return (
        long.where(F.col("value") != 0)
        .withColumn("weight", weight)
        .withColumn("contribution", F.col("value") * F.col("weight"))
        .where(F.col("contribution") != 0)
        .withColumn("description", described)
    )


def score_breakdown(
    features: DataFrame, contributions: DataFrame, score: Column, intercept: float
) -> DataFrame:
    """Baseline plus contributions is the logit of the score; `gap` is the difference."""
    sums = contributions.groupBy(*KEY).agg(F.sum("contribution").alias("sum_of_contributions"))
    logit = F.lit(float(intercept)) + F.col("sum_of_contributions")
    p = F.col("probability")
    return (
        features.select(*KEY, score.alias("probability"))
        .join(sums, KEY, "left")
        .fillna(0.0, ["sum_of_contributions"])
        .select(
            *KEY, F.lit(float(intercept)).alias("baseline_log_odds"), "sum_of_contributions",
            logit.alias("logit"), "probability",
            (logit - F.log(p / (1 - p))).alias("gap"),
        )
    )


@dataclass
class ScoringModel:
    """A fitted model. Scoring stays inside Spark for both families."""

    model_type: str
    names: list[str]
    threshold: float = fixed.FLAG_THRESHOLD
    meanings: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    gradient: dict[str, float] = field(default_factory=dict)
    nodes: dict[int, Node] = field(default_factory=dict)

    @classmethod
    def fit(
        cls, labelled: DataFrame, model_type: str = "logistic",
        threshold: float = fixed.FLAG_THRESHOLD, meanings: dict[str, str] | None = None,
        names: list[str] | None = None, seed: int = 7,
    ) -> ScoringModel:
        """labelled: features with a non-null label on every row to learn from."""
        if model_type not in MODEL_TYPES:
            raise ValueError(f"model_type must be one of {MODEL_TYPES}, got {model_type!r}")
        names = names or feature_names(labelled)
        known = labelled.where(F.col("label").isNotNull())
        vectors = materialize(distinct_vectors(known, names), "vectors")
        return cls.fit_vectors(vectors, names, model_type, threshold, meanings)

    @classmethod
    def fit_vectors(
        cls, vectors: DataFrame, names: list[str], model_type: str = "logistic",
        threshold: float = fixed.FLAG_THRESHOLD, meanings: dict[str, str] | None = None,
    ) -> ScoringModel:
        """vectors: a written table of newton.distinct_vectors; all that a fit needs of its rows."""
        weights = _balanced(vectors)
        model = cls(model_type, names, threshold, meanings or {})
        if model_type == "logistic":
            fitted = fit_logistic_vectors(vectors, names, *weights)
            model.weights, model.intercept, model.gradient = fitted.weights, fitted.intercept, fitted.gradient
        else:
            model.nodes = fit_tree_vectors(vectors, names, *weights, TREE_DEPTH, TREE_LEAF)
            model.weights = importances(model.nodes, names)
        return model

    def _scored(self, features: DataFrame) -> DataFrame:
        if self.model_type == "logistic":
            return features.withColumn("score", linear_score(self.weights, self.intercept))
        leaf = node_of(self.nodes, lambda i: F.col(f"`{self.names[i]}`"))
        risks = {n.id: n.risk for n in self.nodes.values() if n.feature is None}
        return features.withColumn("_leaf", leaf).withColumn("score", C.lookup(F.col("_leaf"), risks))

    def score(self, features: DataFrame) -> DataFrame:
        return self._scored(features).drop("_leaf")

    def contributions(self, features: DataFrame) -> DataFrame:
        """Each feature's push on each score."""
        if self.model_type == "logistic":
            return linear_contributions(features, self.weights, self.meanings)
        spark = features.sparkSession
        # One row per leaf and feature on its path; at most 2 ** depth leaves.
        paths = F.broadcast(
            spark.createDataFrame(
                leaf_paths(self.nodes, self.names), "_leaf int, feature string, delta double"
            )
        )
        value = F.element_at(
            F.create_map(*[x for n in self.names for x in (F.lit(n), F.col(n))]), F.col("feature")
        )
        named = F.coalesce(C.lookup(F.col("feature"), self.meanings), F.col("feature"))
        return (
            self._scored(features)
            .join(paths, "_leaf")
            .withColumn("value", value)
            .select(
                *KEY, "feature", "value", F.col("delta").alias("weight"),
                F.col("delta").alias("contribution"),
                F.when(F.col("value") == 0, F.concat(named, F.lit(ABSENT))).otherwise(named)
                .alias("description"),
            )
        )

    def breakdown(self, features: DataFrame) -> DataFrame:
        if self.model_type == "logistic":
            return score_breakdown(
                features, self.contributions(features), linear_score(self.weights, self.intercept),
                self.intercept,
            )
        sums = self.contributions(features).groupBy(*KEY).agg(
            F.sum("contribution").alias("sum_of_path_changes")
        )
        return (
            self.score(features).select(*KEY, F.col("score").alias("probability"))
            .join(sums, KEY, "left").fillna(0.0, ["sum_of_path_changes"])
        )

    def feature_table(self, spark) -> DataFrame:
        """Weight per feature by magnitude: log-odds, or split importance for a tree."""
        label = "log_odds_weight" if self.model_type == "logistic" else "split_importance"
        rows = [(n, self.meanings.get(n, n), round(w, 4)) for n, w in self.weights.items()]
        return spark.createDataFrame(
            rows, f"feature string, meaning string, {label} double"
        ).orderBy(F.desc(F.abs(label)), "feature")


@dataclass
class Trained:
    model: ScoringModel
    report: dict
    sweep: DataFrame


def train(
    features: DataFrame, labels: DataFrame, model_type: str = "logistic",
    threshold: float = fixed.FLAG_THRESHOLD, test_size: float = 0.3, seed: int = 7,
    meanings: dict[str, str] | None = None, cross_validate: bool = True,
) -> Trained:
    """Fit on a stratified part, measure on the rest and by cross-validation."""
    known = labels.where(F.col("label").isNotNull()).select(*KEY, "label")
    table = features.join(known, KEY).persist()
    names = feature_names(features)
    split = stratified_split(table, test_size, seed).persist()
    model = ScoringModel.fit(
        split.where(~F.col("is_test")), model_type, threshold, meanings, names, seed
    )
    held_out = model.score(split.where(F.col("is_test"))).select(*KEY, "score", "label").persist()
    quality = M.ranking_quality(held_out).head().asDict()
    hits = M.confusion(held_out, threshold).head().asDict()
    positives, negatives = class_sizes(table)
    report = {
        "model_type": model_type,
        "n_train": positives + negatives - quality["cases"],
        "n_test": quality["cases"],
        "positive_rate": positives / (positives + negatives),
        **{k: quality[k] for k in ("roc_auc", "average_precision", "brier")},
        **hits,
        "threshold": threshold,
    }
    report["pr_baseline"] = report["positive_rate"]
    report["pr_lift"] = (
        report["average_precision"] / report["positive_rate"]
        if report["average_precision"] is not None
        else None
    )
    if cross_validate:
        report |= cross_validation(table, names, model_type, seed)
    sweep = M.threshold_sweep(held_out)
    return Trained(model, report, sweep)


def cross_validation(
    table: DataFrame, names: list[str], model_type: str = "logistic", seed: int = 7
) -> dict:
    """Mean and population deviation of both ranking measures over stratified folds.

    The rows are read once: a fit and its measures need how many rows of each class a fold has of each distinct vector.
    """
    k = min(5, *class_sizes(table))
    if k < 2:
        return {f"cv_{m}_{s}": None for m in ("roc_auc", "average_precision") for s in ("mean", "std")}
    counted = materialize(distinct_vectors(stratified_folds(table, k, seed), names, "fold"), "folds")
    at = [f"x{i}" for i in range(len(names))]
    measured = []
    for fold in range(k):
        others = counted.where(F.col("fold") != fold).groupBy(*at).agg(
            F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
        model = ScoringModel.fit_vectors(materialize(others, "vectors"), names, model_type)
        held_out = counted.where(F.col("fold") == fold).select(
            *[F.col(x).alias(n) for x, n in zip(at, names, strict=True)], "positive", "negative")
        measured.append(M.counted_ranking_quality(model.score(held_out)).head())

    def spread(name: str) -> tuple[float, float]:
        values = [row[name] for row in measured]
        mean = sum(values) / k
        return mean, (sum((v - mean) ** 2 for v in values) / k) ** 0.5

    auc, ap = spread("roc_auc"), spread("average_precision")
    return {
        "cv_roc_auc_mean": auc[0], "cv_roc_auc_std": auc[1],
        "cv_average_precision_mean": ap[0], "cv_average_precision_std": ap[1],
    }


Extractor = Callable[[DataFrame, DataFrame], DataFrame]


def ablation(
    cases: DataFrame, events: DataFrame, arms: dict[str, list[Extractor]],
    model_type: str = "logistic", seed: int = 7,
) -> DataFrame:
    """The same cohort scored with several sets of feature extractors."""
    rows = []
    for name, extractors in arms.items():
        features = feature_matrix(cases, *[extract(cases, events) for extract in extractors])
        r = train(features, cases, model_type, seed=seed).report
        rows.append((name, r["average_precision"], r["cv_average_precision_mean"], r["roc_auc"],
                     r["pr_baseline"], r["pr_lift"]))
    return cases.sparkSession.createDataFrame(
        rows,
        "arm string, average_precision double, cv_average_precision_mean double, roc_auc double, "
        "pr_baseline double, pr_lift double",
    )
