"""Periodic runs against comparing every pair of words."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import periodic as P
from tracewell.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], []
    for c in text or "":
        if c in SPACES:
            if word:
                out.append("".join(word))
            word = []
        else:
            word.append(c)
    return [*out, "".join(word)] if word else out


def brute(words, shortest=12):
    """(start, length, period) of every run, period by period; the smallest period of a stretch counts."""
    numbers = {}
    t = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    found = {}
    for q in range(1, len(t) // 2 + 1):
        same = np.concatenate([[False], t[q:] == t[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= q and b - a + q >= shortest:
                found.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def damaged(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def streams(rng):
    """Words with few letters, repeated blocks, repeats of repeats, and a sequence without cubes."""
    letters = [str(i) for i in range(rng.choice([1, 2, 3, 30]))]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 6)):
        a = rng.randint(0, len(words))
        b = rng.randint(a, len(words))
        words = words[:b] + words[a:b] * rng.randint(1, 4) + words[b - rng.randint(0, b - a):]
        words = words[:900]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = streams(rng)
        numbers = np.array([int(w) for w in words], dtype=np.int64)
        for shortest in (2, 12):
            want = brute(words, shortest)
            for at_once in (1, 7, 1 << 16) if len(words) < 200 else (100, 1 << 16):
                assert P.find_runs(numbers, len(words) // 2, shortest, at_once).tolist() == [list(w) for w in want]


def test_sequence_whose_polynomial_hashes_collide():
    bits = np.array([bin(i).count("1") & 1 for i in range(1 << 13)], dtype=np.int64)
    for stream in (bits, np.concatenate([bits, bits[:5000]])):
        assert P.find_runs(stream, len(stream) // 2, 12).tolist() == [list(w) for w in brute(stream.tolist())]


def test_words_are_compared_where_hashes_lie(monkeypatch):
    honest, calls = P.W.mix, []

    def lying(x):
        calls.append(1)
        return honest(x) if len(calls) > 40 else np.zeros_like(x)

    monkeypatch.setattr(P.W, "mix", lying)
    numbers = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 5 + list(range(50)), dtype=np.int64)
    assert P.find_runs(numbers, 45, 12).tolist() == [[0, 40, 8]]
    assert len(calls) > 40


def test_state_is_bounded_and_repeats_cost_no_more():
    catcher = P.SquareCatcher(150_000)
    for _ in range(300):
        catcher.append(np.zeros(1000, dtype=np.int64))
        assert sum(len(x.windows) + len(x.blocks) for x in catcher.levels) < 8 * 300_000
        assert sum(len(x.open) for x in catcher.levels) < 8 * len(catcher.levels)
    assert catcher.finish().tolist() == [[0, 300_000, 1]]


def test_texts_do_not_touch():
    lines = ["a b " * 3, "a b " * 3, "", "a b " * 6, "x"]
    got = P.text_runs(pa.array(lines))
    assert [(n, r.tolist()) for n, r, _ in got] == [(6, []), (6, []), (0, []), (12, [[0, 12, 2]]), (1, [])]
    assert got[3][2] == "a b" and got[4][2] == "x"


def test_defined_cases(spark):
    long = "w" * 300_000 + " " + "one two three " * 100_000
    rows = [(1, None), (2, ""), (3, long), (None, "x " * 12), (None, "x " * 12), (4, "é ü " * 12 + "\t\n"), (5, "\x1f " * 13)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("1 AS runs", "2 AS n_words", "'c' AS collapsed", "*")
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(df).collect()}
    assert got == {
        (1, 0): ([], ""), (2, 0): ([], ""), (3, 300_001): ([(1, 300_000, 3)], "w" * 300_000 + " one two three"),
        (None, 12): ([(0, 12, 1)], "x"), (4, 12): ([(0, 12, 1)], "é ü"), (5, 13): ([(0, 13, 1)], "\x1f"),
    }
    assert P.periodic_runs(df).count() == len(rows) and P.periodic_runs(df.limit(0)).count() == 0


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        words = damaged(r.doc_id, split(texts[r.doc_id]))
        runs = brute(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
    assert sum(r.n_runs > 0 for r in rows) > 10


def test_damage_of_odd_ids(spark, tmp_path):
    text = " ".join(str(i % 97) for i in range(400))
    hit = next(i for i in range(10**6, 10**7) if zlib.crc32(str(i).encode()) % 10 == 0)
    ids = [None, -1, hit, hit, 2**63 - 1]
    df = spark.createDataFrame([(i, t) for i in ids for t in (text, None, "")], "doc_id bigint, text string")
    df.withColumn("h", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect():
        words = split(text) if r.n_words else []
        want = brute(damaged(r.doc_id, words) if r.doc_id is not None else words)
        assert r.n_runs == len(want)
