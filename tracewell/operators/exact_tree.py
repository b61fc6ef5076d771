"""A decision tree by exact split search, level by level.

Every value that a feature takes is a possible split. Rows are counted once by their distinct vector and class. For a level, the
vectors of its nodes are turned into rows (node, feature, value) with their counts, and prefix sums in
that order, over ranges so that a feature with very many values is split over tasks, give the counts on both sides of every value. One
row per node, its best split, reaches the driver: at most 2 ** depth.

Classes weigh as given. A split maximises the fall of the weighted Gini impurity; ties go to the earlier feature, then to
the smaller value. The threshold lies half way to the next value. Counts are whole numbers, so the tree does
not depend on order or partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.newton import distinct_vectors
from tracewell.operators.ordering import running_totals
from tracewell.session import materialize

LEAST_GAIN = 1e-9       # of the weighted rows


@dataclass
class Node:
    """Children of node n are 2 n and 2 n + 1; `feature` is None in a leaf."""
    id: int
    risk: float
    feature: int | None = None
    threshold: float | None = None
    gain: float = 0.0


def _purity(positive: Column, negative: Column) -> Column:
    return (positive * positive + negative * negative) / (positive + negative)


def node_of(nodes: dict[int, Node], value) -> Column:
    """The leaf of a row; value(i) is the column of feature i."""
    def walk(n: int) -> Column:
        node = nodes[n]
        if node.feature is None:
            return F.lit(n)
        return F.when(value(node.feature) <= F.lit(float(node.threshold)), walk(2 * n)).otherwise(walk(2 * n + 1))

    return walk(1)


def level_splits(vectors: DataFrame, d: int, weights: tuple[float, float], leaf: int) -> DataFrame:
    """(node, feature, value, score, p, n): the best split of each node of vectors, and its weighted counts."""
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"x{i}").alias("value")) for i in range(d)])).alias("at")
    counts = vectors.select("node", long, "positive", "negative").groupBy("node", "at.feature", "at.value").agg(
        F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    counts = materialize(counts, "counts")
    # sums from the first row of all; what stands before a node and feature is known from their totals
    upto = running_totals(counts, [F.col("node"), F.col("feature"), F.col("value")], {"p_upto": "positive", "n_upto": "negative"})
    totals = counts.groupBy("node", "feature").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"), F.min("value").alias("first"))
    starts = upto.join(totals, ["node", "feature"]).where(F.col("value") == F.col("first")).select(
        "node", "feature", "p", "n", (F.col("p_upto") - F.col("positive")).alias("p_before"), (F.col("n_upto") - F.col("negative")).alias("n_before"))
    # one row per node and feature
    sides = upto.join(F.broadcast(starts), ["node", "feature"]).withColumns({
        "pl": F.col("p_upto") - F.col("p_before"), "nl": F.col("n_upto") - F.col("n_before")})
    sides = sides.withColumns({"pr": F.col("p") - F.col("pl"), "nr": F.col("n") - F.col("nl")})
    sides = sides.where((F.col("pl") + F.col("nl") >= leaf) & (F.col("pr") + F.col("nr") >= leaf))
    up, down = weights
    score = _purity(F.col("pl") * up, F.col("nl") * down) + _purity(F.col("pr") * up, F.col("nr") * down)
    best = F.max(F.struct(score.alias("score"), (-F.col("feature")).alias("feature"), (-F.col("value")).alias("value"), "p", "n")).alias("best")
    return sides.groupBy("node").agg(best).select(
        "node", (-F.col("best.feature")).alias("feature"), (-F.col("best.value")).alias("value"), "best.score", "best.p", "best.n")


def fit_tree(labelled: DataFrame, names: list[str], weight_positive: float, weight_negative: float, depth: int, leaf: int) -> dict[int, Node]:
    """labelled: features and a boolean label on every row."""
    vectors = materialize(distinct_vectors(labelled, names), "vectors")
    return fit_tree_vectors(vectors, names, weight_positive, weight_negative, depth, leaf)


def fit_tree_vectors(vectors: DataFrame, names: list[str], weight_positive: float, weight_negative: float, depth: int, leaf: int) -> dict[int, Node]:
    """vectors: a written table of distinct_vectors."""
    up, down = weight_positive, weight_negative
    p, n = vectors.agg(F.sum("positive"), F.sum("negative")).first()
    nodes = {1: Node(1, p * up / (p * up + n * down))}
    for level in range(depth):
        placed = vectors.withColumn("node", node_of(nodes, lambda i: F.col(f"x{i}"))).where(F.col("node") >= 2**level)
        splits = []
        for r in level_splits(placed, len(names), (up, down), leaf).collect():
            p, n = r["p"] * up, r["n"] * down
            gain = r["score"] - (p * p + n * n) / (p + n)
            if gain > LEAST_GAIN:
                splits.append((r["node"], r["feature"], r["value"], gain))
        if not splits:
            break
        # the next value on the other side, and what the sides hold, in one aggregate
        asked = []
        for node, feature, value, _ in splits:
            here, x = F.col("node") == node, F.col(f"x{feature}")
            asked.append(F.min(F.when(here & (x > value), x)).alias(f"next{node}"))
            for side, inside in ((0, x <= value), (1, x > value)):
                asked += [F.sum(F.when(here & inside, F.col(c)).otherwise(0.0)).alias(f"{c}{2 * node + side}") for c in ("positive", "negative")]
        got = placed.agg(*asked).first()
        for node, feature, value, gain in splits:
            held = nodes[node]
            held.feature, held.threshold, held.gain = feature, (value + got[f"next{node}"]) / 2, gain
            for child in (2 * node, 2 * node + 1):
                p, n = got[f"positive{child}"] * up, got[f"negative{child}"] * down
                nodes[child] = Node(child, p / (p + n))
    return nodes


def importances(nodes: dict[int, Node], names: list[str]) -> dict[str, float]:
    """Each feature's share of all the impurity that splits took away."""
    total = sum(n.gain for n in nodes.values()) or 1.0
    return {name: sum(n.gain for n in nodes.values() if n.feature == i) / total for i, name in enumerate(names)}


def leaf_paths(nodes: dict[int, Node], names: list[str]) -> list[tuple[int, str, float]]:
    """Per leaf, the change in risk along its path summed by split feature."""
    rows, pending = [], [(1, {})]
    while pending:
        at, changes = pending.pop()
        node = nodes[at]
        if node.feature is None:
            rows += [(at, name, delta) for name, delta in sorted(changes.items()) if abs(delta) >= 1e-9]
            continue
        name = names[node.feature]
        for child in (2 * at, 2 * at + 1):
            pending.append((child, {**changes, name: changes.get(name, 0.0) + nodes[child].risk - node.risk}))
    return rows
