"""Substring dedup against a brute-force search over all windows."""

import hashlib
import random

import pytest

from tracewell.llm.automaton import SuffixAutomaton
from tracewell.llm.queries import QUERIES
from tracewell.llm.substring import substring_dedup

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def brute(rows, window):
    """rows: (doc_id, text) with distinct ids; returns id -> (n_words, n_removed, kept)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = words_of(text)
        drop = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                drop[s:s + window] = [True] * window
            seen.add(w)
        kept = [w for w, d in zip(words, drop) if not d]
        out[i] = (len(words), sum(drop), " ".join(kept))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


def test_automaton_gives_matching_statistics():
    rng = random.Random(3)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(4)]
        automaton, done = SuffixAutomaton(), []
        for t in texts:
            found = automaton.add(t)
            for e in range(1, len(t) + 1):
                best = 0
                for n in range(1, e + 1):
                    run = t[e - n:e]
                    before = [d[x:x + n] for d in done for x in range(len(d) - n + 1)]
                    before += [t[x:x + n] for x in range(e - n)]
                    if run in before:
                        best = n
                assert found[e - 1] == best
            done.append(t)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2 + 20 * seed)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            words += p
        rows.append((i * 3, rng.choice(SPACE).join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for window, k in ((20, 8), (6, 3)):
        assert result(substring_dedup(df, window=window, seed=k)) == brute(rows, window)


def test_crowded_seeds_change_nothing(spark, monkeypatch):
    from tracewell.llm import substring

    monkeypatch.setattr(substring, "CROWDED", 2)
    rng = random.Random(9)
    line = " ".join(f"c{i}" for i in range(25))
    rows = [(i, " ".join(rng.choice("xyz") for _ in range(i % 7)) + " " + line + " " + line[:i]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(substring_dedup(df)) == brute(rows, 20)


def test_defined_cases(spark):
    long = " ".join(f"é{i}" for i in range(20_000))
    period = "a b " * 60
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, long), (6, long), (7, period), (None, long), (8, "x y " * 25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = df.selectExpr("*", "1 AS key", "2 AS seeds", "3 AS tid", "4 AS spans", "5 AS n_words")
    got = result(substring_dedup(clash))
    assert got == brute(rows, 20)
    assert got[6][1] == got[None][1] == 20_000 and got[2] == (0, 0, "")
    twice = result(substring_dedup(df.union(df)))
    assert twice == got
    assert substring_dedup(df.limit(0)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in brute(rows, 20).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, folder).collect()}
    assert got == want


def test_rows_without_an_id_and_the_largest_id(spark):
    """Each null id row is a document of its own; the largest bigint is an id like any other."""
    line = " ".join(f"w{i}" for i in range(25))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(30))
    rows = [(2**63 - 1, own("max")), (5, line), *((None, f"{own(k)} {line}") for k in range(40)), (2**63 - 1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(df).collect()), key=repr)
    want = [(2**63 - 1, 30, 0), (5, 25, 0), *[(None, 55, 25)] * 40, (2**63 - 1, 0, 0)]
    assert got == sorted(want, key=repr)
