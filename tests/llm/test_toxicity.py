"""Toxicity by held-out accuracy; folds, order and defined cases."""

import random
import zlib

import pytest

from tracewell.llm import toxicity as T
from tracewell.llm.queries import QUERIES


def corpus(rng, n, first=0):
    """Texts of made-up words; toxic ones hold insults or words that begin with `grumpf`."""
    docs, labels = [], []
    for i in range(first, first + n):
        words = ["".join(rng.choice(["ba", "ri", "to", "len", "és"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(3, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron,"]) if i % 2 else "grumpf" + rng.choice(["ba", "ri", "to"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(random.Random(1), 900)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    y = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, dict(labels), d, y


def test_features_name_every_value():
    assert len(T.features("You are an 1d1ot!", {"idiot": 2.0})) == len(T.NAMES)
    named = dict(zip(T.NAMES, T.features("you IDIOT st.upid 1diot grumpfling", {"^grum": 3.0}), strict=True))
    assert named["fixed_count"] == 1 and named["near_second"] == 2 and named["beginning_count"] == 1
    assert named["evidence"] == 3.0 and named["hidden_density"] == 40.0


def test_held_out_accuracy(fitted):
    docs, labels, d, y = fitted
    rows = T.toxicity_scores(d, y).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_rows_are_not_read(fitted):
    docs, labels, d, y = fitted
    other = y.selectExpr("doc_id", "IF(pmod(crc32(CAST(doc_id AS string)), 3) = 1, 1 - toxic, toxic) AS toxic")
    scores = lambda df: {r.doc_id: r.score for r in df.collect()}
    assert scores(T.toxicity_scores(d, y)) == pytest.approx(scores(T.toxicity_scores(d, other)), abs=1e-12)


def test_defined_cases(spark, fitted):
    docs, labels, d, y = fitted
    model = T.fit_toxicity(d, y)
    long = "ba ri to " * 100_000
    rows = [(1, None), (2, ""), (3, long), (None, "you moron, idiot moron idiot"), (3, long)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("0.5 AS score", "1 AS predicted", "'r' AS row", "2 AS features", "*", "1 AS label")
    got = model.score(odd).collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1, 0] and got[0].score == got[1].score
    left = T.drop_toxic(odd.union(d.selectExpr("0.5", "1", "'r'", "2", "*", "1")), y.unionByName(spark.createDataFrame([(3, None), (None, 1)], "doc_id bigint, toxic int")))
    assert left.columns == odd.columns
    assert 0.7 * len(docs) < left.count() < 0.8 * len(docs) + 5
    none = T.toxicity_scores(odd, y.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == 5
    assert T.toxicity_scores(odd.limit(0), y.limit(0)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_toxicity"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)
