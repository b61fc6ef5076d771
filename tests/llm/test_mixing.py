"""The mix against a plain loop over the tree and sorted leaves, and against SQL."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tracewell.llm.mixing import Tree, mix, mix_sql
from tracewell.llm.queries import ORACLES, QUERIES

SPACE = " \t\n\x0b\x0c\r"


def tokens(text):
    return len([w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w])


def fill(budget, children):
    """children: name -> (weight, capacity). Shortages go round until none is left."""
    got, open_, left = {}, {n for n, (w, c) in children.items() if w > 0 and c > 0}, budget
    while open_:
        weight = sum(children[n][0] for n in open_)
        full = {n for n in open_ if children[n][1] * weight <= left * children[n][0]}
        if not full:
            return {**got, **{n: int(left * children[n][0] / weight + 1e-6) for n in open_}}
        got.update((n, children[n][1]) for n in full)
        left -= sum(children[n][1] for n in full)
        open_ -= full
    return got


def brute(rows, tree, share, epochs, seed):
    """rows: (doc_id, text, lang, source, domain) -> times per row index."""
    leaves = defaultdict(list)
    for i, r in enumerate(rows):
        leaves[r[4] or "", r[2] or "", r[3] or ""].append(i)
    size = {k: sum(tokens(rows[i][1]) for i in v) for k, v in leaves.items()}
    def level(budget, names, weights, depth, prefix):
        out = fill(budget, {n: (weights.get(n, tree.other), epochs * sum(v for k, v in size.items() if k[:depth] == (*prefix, n))) for n in names})
        return out
    times = [0] * len(rows)
    top = level(int(sum(size.values()) * share), {k[0] for k in size}, tree.domains, 1, ())
    for d, bd in top.items():
        for l, bl in level(bd, {k[1] for k in size if k[0] == d}, tree.langs, 2, (d,)).items():
            for s, b in level(bl, {k[2] for k in size if k[:2] == (d, l)}, tree.sources, 3, (d, l)).items():
                own = leaves[d, l, s]
                whole, rest = divmod(b, size[d, l, s])
                place = lambda i: hashlib.md5(f"{seed}:{whole + 1}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()
                by = defaultdict(list)
                for i in own:
                    by[place(i)].append(i)
                upto = 0
                for i in own:
                    times[i] = whole
                for p in sorted(by):
                    upto += sum(tokens(rows[i][1]) for i in by[p])
                    if upto > rest:
                        break
                    for i in by[p]:
                        times[i] += 1
    return times


def make(rng, n):
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        rows.append((i if rng.random() > 0.05 else rng.choice([None, 3]), rng.choice([None, "", "w " * rng.randint(1, 40), "x\ty" * 9]), rng.choice(["en", "en", "de", None]), source, rng.choice(["web", "web", "books", None])))
    return rows


@pytest.mark.parametrize("share,epochs,seed", [(0.6, 2, 42), (0.95, 1, 7), (1.7, 2, 1), (0.02, 3, 5), (2.5, 2, 3)])
def test_random_trees(spark, share, epochs, seed):
    rng = random.Random(seed)
    rows = make(rng, 400)
    tree = Tree(domain="dom", domains={"web": 60, "books": 40}, langs={"en": 1, "de": 90}, sources={"a": 5, "b": 0})
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, dom string").selectExpr("1 AS n", "2 AS id", "'k' AS place", "'q' AS row", "*", "8 AS epochs").repartition(3)
    got = mix(df, tree, share, epochs, seed)
    assert got.columns == [*df.columns, "times"]
    want = brute(rows, tree, share, epochs, seed)
    key = lambda r: repr(tuple(r))
    assert sorted(key((r.doc_id, r.text, r.lang, r.source, r.dom, r.times)) for r in got.collect()) == sorted(key((*r, t)) for r, t in zip(rows, want) if t)


def test_shortage_stays_with_siblings(spark):
    rows = [(i, "w " * 10, "en", s, d) for i, (d, s) in enumerate([("web", "small")] + [("web", "large")] * 50 + [("books", "x")] * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, dom string")
    out = mix(df, Tree(domain="dom", other=1), 0.5, 1, 0)
    taken = {r.dom: r.n for r in out.groupBy("dom").agg({"times": "sum"}).toDF("dom", "n").collect()}
    assert taken == {"web": 25, "books": 25}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, dom string")
    assert mix(df, Tree(domain="dom")).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "s", "d")], df.schema)
    assert mix(blank, Tree(domain="dom")).count() == 0


def test_whole_table_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = duck.execute(ORACLES["op6_source_mix"])
    names = [d[0] for d in cursor.description]
    df = QUERIES["op6_source_mix"](spark, folder)
    assert "Python" not in df._jdf.queryExecution().toString()
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
    assert len(mix_sql(Tree(domain="lang"), "doc_id")) > 100
