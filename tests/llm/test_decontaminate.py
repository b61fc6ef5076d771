"""Leaks against the containment of every document and item."""

import random

import pytest

from tracewell.llm import decontaminate as D
from tracewell.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def shingle_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in SPACE else c for c in text or "")
    words = [w for w in text.split(" ") if w]
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(docs, items, threshold=0.8):
    out = []
    sets = [(i, shingle_set(t)) for i, t in items]
    for d, text in docs:
        own = shingle_set(text)
        for i, s in sets:
            if s and len(s & own) / len(s) >= threshold - 1e-12:
                out.append((d, i, len(s), len(s & own)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect()), key=repr)


def test_sketch_cannot_miss():
    for size in range(1, 400):
        for threshold in (0.5, 0.8, 1.0):
            assert D.sketch_size(size, threshold) >= min(size, size - D.needed(size, threshold) + 1)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_edited_items_in_long_documents(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(2)
    word = lambda: rng.choice(["The", "of", "éa"]) if rng.random() < 0.3 else f"w{rng.randrange(900)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 9, 30, 60, 130])))) for i in range(30)]
    docs = []
    for d in range(80):
        words = [word() for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            leak = rng.choice(items)[1].upper().split()
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = "edit"
            at = rng.randint(0, len(words))
            words[at:at] = leak
        docs.append((d, rng.choice(SPACE).join(words)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert want and found(D.leaked_items(d, b)) == want
    left = D.drop_leaks(d.selectExpr("'x' AS item_id", "*"), b)
    assert left.columns == ["item_id", "doc_id", "text"]
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {w[0] for w in want}


def test_defined_cases(spark):
    item = "one two three four five six"
    long = " ".join(f"w{i}" for i in range(30_000)) + " " + item
    docs = [(1, None), (2, ""), (3, long), (None, item), (3, long), (4, "one two")]
    items = [(7, item), (7, item), (8, None), (9, ""), (None, "one two"), (None, item)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS n_shared")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "5 AS doc_id")
    want = brute(docs, [(7, item), (None, item)])
    assert found(D.leaked_items(d, b)) == want and len(want) == 6
    assert found(D.leaked_items(d, b.limit(0))) == [] == found(D.leaked_items(d.limit(0), b))
    assert D.drop_leaks(d, b.limit(0)).count() == 6


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert found(QUERIES["op2_benchmark_leaks"](spark, folder)) == brute(docs, items)
