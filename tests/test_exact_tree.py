"""The tree against a search in plain Python."""

import random

import pytest

from tracewell.operators import exact_tree as E

NAMES = ["a", "b", "c d"]


def make(rng, n):
    rows = []
    for _ in range(n):
        x = (float(rng.randrange(2)), rng.randrange(8) / 2, round(rng.gauss(0, 2), 1))
        rows.append((*x, rng.random() < 0.1 + 0.5 * x[0] * (x[1] > 2) + 0.3 * (x[2] > 1)))
    return rows


def searched(rows, up, down, depth, leaf):
    """Node: (risk, feature, threshold)."""
    nodes = {}

    def purity(p, n):
        return (p * p + n * n) / (p + n)

    def grow(node, rows, level):
        count = lambda rs: (sum(r[-1] for r in rs), sum(not r[-1] for r in rs))
        p, n = count(rows)
        nodes[node] = [p * up / (p * up + n * down), None, None]
        best = None
        for f in range(len(NAMES)):
            values = sorted({r[f] for r in rows})
            for value, nxt in zip(values, values[1:]):
                left = [r for r in rows if r[f] <= value]
                if min(len(left), len(rows) - len(left)) < leaf:
                    continue
                pl, nl = count(left)
                score = purity(pl * up, nl * down) + purity((p - pl) * up, (n - nl) * down)
                if best is None or score > best[0]:
                    best = (score, f, (value + nxt) / 2)
        if level < depth and best and best[0] - purity(p * up, n * down) > E.LEAST_GAIN:
            _, f, t = best
            nodes[node][1:] = [f, t]
            grow(2 * node, [r for r in rows if r[f] <= t], level + 1)
            grow(2 * node + 1, [r for r in rows if r[f] > t], level + 1)

    grow(1, rows, 0)
    return nodes


@pytest.mark.parametrize(("n", "depth", "leaf"), [(400, 3, 10), (60, 5, 1), (30, 2, 20)])
def test_tree_equals_a_plain_search(spark, n, depth, leaf):
    rows = make(random.Random(n), n)
    df = spark.createDataFrame(rows, "a double, b double, `c d` double, label boolean")
    nodes = E.fit_tree(df.repartition(3), NAMES, 2.0, 0.75, depth, leaf)
    got = {k: [v.risk, v.feature, v.threshold] for k, v in nodes.items()}
    want = searched(rows, 2.0, 0.75, depth, leaf)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], abs=1e-12) and got[k][1:] == want[k][1:]
    share = E.importances(nodes, NAMES)
    assert sum(share.values()) == pytest.approx(1.0 if len(nodes) > 1 else 0.0)
    leaves = df.withColumn("leaf", E.node_of(nodes, lambda i: df[f"`{NAMES[i]}`"])).groupBy("leaf").count().collect()
    assert {r["leaf"] for r in leaves} == {k for k, v in nodes.items() if v.feature is None} and all(r["count"] >= leaf for r in leaves)


def test_one_class_of_vectors_is_a_root(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, i % 2 == 0) for i in range(40)], "a double, b double, `c d` double, label boolean")
    nodes = E.fit_tree(df, NAMES, 1.0, 1.0, 5, 1)
    assert list(nodes) == [1] and nodes[1].risk == 0.5 and E.leaf_paths(nodes, NAMES) == []
