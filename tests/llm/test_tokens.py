"""Counts after edits against encoding the edited text whole."""

import random

import pytest

from tracewell.llm.pii import find_spans, redact
from tracewell.llm.queries import QUERIES, RANKS
from tracewell.llm.tokens import Counter, TokenTree, count_tokens, recount_tokens


@pytest.fixture(scope="module")
def counter():
    with open(RANKS, "rb") as file:
        return Counter(file.read())


def consistent(tree):
    for i in range(1, tree.width):
        assert tree.chars[i] == tree.chars[2 * i] + tree.chars[2 * i + 1]
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


@pytest.mark.parametrize("seed", range(4))
def test_random_edits(counter, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", " ", " ", "\n", "'", "s", "re", "1", "!", "é", "的", "\t", "  ", "ll"]
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    for _ in range(150):
        text = make(rng.choice([3, 40, 400]))
        tree = TokenTree(*counter.cut(text))
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 2, 9, 200]))
            new = make(rng.choice([0, 2, 12, 60]))
            want = text[:a] + new + text[b:]
            text, encoded = tree.edit(counter, text, a, b, new)
            assert text == want and tree.total == counter.whole(text) and tree.chars[1] == len(text)
            leaves = [x for c, _ in tree.leaves for x in c]
            assert leaves == counter.cut(text)[0]
            consistent(tree)
            tree = TokenTree.from_bytes(tree.to_bytes())


def test_only_the_edited_region_is_encoded(counter):
    text = "one two three " * 5000
    tree = TokenTree(*counter.cut(text))
    text, encoded = tree.edit(counter, text, 30_000, 30_003, "XYZ")
    assert encoded <= 6 and tree.total == counter.whole(text)


def test_defined_cases(spark, counter):
    long = "word " * 300_000
    edit = lambda a, b, t: {"start": a, "end": b, "text": t}
    rows = [(1, None, [edit(0, 5, "new")]), (2, "", None), (3, long, [edit(5, 2, "x"), edit(10**9, 10**9, " end"), edit(-4, None, None)]), (None, "a b", [edit(0, 1, None)]), (None, "a b", [])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, edits array<struct<start: int, end: int, text: string>>").selectExpr("0 AS tree", "1 AS n_tokens", "*")
    got = recount_tokens(df, RANKS).collect()
    want = ["new", "", "word " + "x" + long[5:] + " end", " b", "a b"]
    assert [r.text for r in got] == want
    assert [r.n_tokens for r in got] == [counter.whole(t) for t in want]
    assert recount_tokens(df.limit(0), RANKS).count() == 0


def test_stored_trees(spark, counter):
    df = spark.createDataFrame([(1, "some text here"), (2, None)], "doc_id bigint, text string")
    trees = count_tokens(df, RANKS)
    assert [r.n_tokens for r in trees.orderBy("doc_id").collect()] == [counter.whole("some text here"), 0]
    edited = df.join(trees, "doc_id").selectExpr("*", "array(named_struct('start', 5, 'end', 9, 'text', 'words')) AS edits")
    got = {r.doc_id: (r.text, r.n_tokens) for r in recount_tokens(edited, RANKS, tree_column="tree").collect()}
    assert got == {1: ("some words here", counter.whole("some words here")), 2: ("words", counter.whole("words"))}


def test_whole_table(spark, counter):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_token_counts"](spark, folder).collect()
    assert len(rows) == len(texts) and any(r.n_edits for r in rows)
    for r in rows:
        text = texts[r.doc_id]
        assert r.n_tokens_before == counter.whole(text)
        assert r.n_tokens == counter.whole(redact(text, find_spans(text)))
