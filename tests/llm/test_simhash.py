"""Fingerprints by their definition, links by comparing all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tracewell.llm import simhash as S
from tracewell.llm.components import components
from tracewell.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in SPACE else c for c in text or "")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints):
    """print -> smallest print reachable."""
    prints, root = sorted(set(prints)), {}
    arr = np.array(prints, dtype=np.uint64)
    for p in prints:
        if p in root:
            continue
        root[p], todo = p, [p]
        while todo:
            at = np.uint64(todo.pop())
            for q in arr[np.bitwise_count(arr ^ at) <= 2].tolist():
                if q not in root:
                    root[q] = p
                    todo.append(q)
    return root


def test_anchors_cover():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 1 << 32, 2000, dtype=np.uint64).astype(np.uint32)
    home = S.anchor(half)
    assert (np.bitwise_count(home ^ half) <= 1).all() and (S.anchor(home) == home).all()


@pytest.mark.parametrize("many", [4096, 16])
def test_links(spark, monkeypatch, many):
    monkeypatch.setattr(S, "MANY", many)
    rng = random.Random(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            prints.append(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    for _ in range(120):           # one crowded anchor: the upper half is the same
        prints.append(base ^ rng.getrandbits(3) << rng.randrange(28))
    want = slow_groups(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(set(prints))]
    got = {r.node % (1 << 64): r.root for r in S.print_groups(spark.createDataFrame(signed, "print bigint").repartition(3)).collect()}
    by = lambda pairs: sorted(sorted(g) for g in pairs)
    groups = {}
    for p, r in got.items():
        groups.setdefault(r, []).append(p)
    expected = {}
    for p, r in want.items():
        expected.setdefault(r, []).append(p)
    assert by(groups.values()) == by(g for g in expected.values() if len(g) > 1)


def test_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(500, 501), (7, 7)], "a bigint, b bigint"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(5, None), (3, ""), (9, " \n"), (4, "One"), (6, "one"), (8, "a b"), (2, long), (None, long), (2, long), (None, "only here now")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 AS print", "1 AS component_id", "2 AS root")
    got = sorted(((r.doc_id, r.print % (1 << 64), r.component_id) for r in S.simhash_groups(df).collect()), key=repr)
    prints = {t: slow_print(t) for _, t in rows}
    want = [(i, prints[t], {None: 3, "": 3, " \n": 3, "One": 4, "one": 4, "a b": 8, long: 2, "only here now": None}[t]) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert S.simhash_groups(df.limit(0)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {r.doc_id: slow_print(r.text) for r in rows}
    root = slow_groups(prints.values())
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    want = {i: (f"{p:016x}", first[root[p]]) for i, p in prints.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, folder).collect()} == want
