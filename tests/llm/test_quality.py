"""Statistics by plain loops, the learner by held-out accuracy and known rules."""

import random
from collections import Counter

from tracewell.llm import quality as Q
from tracewell.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def slow(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def fast(df):
    return [tuple(r[s] for s in Q.STATISTICS) for r in df.collect()]


def test_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é#|\n\t\x0b" + " " * 6) for _ in range(rng.choice([0, 3, 30, 300]))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert fast(Q.statistics(df)) == [slow(t) for t in texts]


def test_defined_cases(spark):
    long = " ".join(f"w{i % 9000}" for i in range(30_000))
    texts = [None, "", "\n \n", "a b", "a a a", long, long, "a\nb\na \na", "\U0001f600 x\r\n\r\nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("1 AS row", "2 AS words", "3 AS kept", "*", "4 AS n_words").coalesce(1)
    assert fast(Q.statistics(df)) == [slow(t) for t in texts]
    out = Q.judge(df, Q.DecisionList()).collect()
    assert [r.kept for r in out] == [False] * len(texts)
    assert Q.statistics(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    assert Q.learn_rules(df, labels).rules == [] == Q.learn_rules(df.limit(0), labels.limit(0)).rules


def test_learned_list(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        kind = rng.choice(["good", "good", "signs", "long"])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8) if kind != "long" else 15)) for _ in range(rng.randint(60, 150))]
        if kind == "signs":
            words = [w[:-1] + "#" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind == "good") if rng.random() > 0.02 else rng.randint(0, 1)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    rules = Q.learn_rules(d, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert 1 <= len(rules.rules) <= Q.RULES
    kept = {r.row.doc_id: r.kept for r in Q.judge(d, rules).collect()}
    assert sum(kept[i] == bool(y) for i, y in labels) >= 0.96 * len(labels)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    df = QUERIES["op9_quality_rules"](spark, folder)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow(texts[r.doc_id])
        assert tuple(r[s] for s in Q.STATISTICS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule is None)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(marks[r.doc_id], r.kept) for r in rows if r.doc_id in marks and not r.base_failed]
    assert sum(bool(a) == b for a, b in judged) >= 0.95 * len(judged)
