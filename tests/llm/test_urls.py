"""Verdicts against plain string tests, digests with forced collisions, and SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from tracewell.llm import urls as U
from tracewell.llm.queries import BLOCKED_HOSTS, ORACLES, QUERIES, URL_RULES

RULES = [U.Rule(*r) for r in URL_RULES]


def brute(url, entries, rules):
    host = path = ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if m:
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in rules if host and under(r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    if best:
        return host, path, best.host + best.path, best.verdict
    parts = [p for p in path.split("/")[1:]]
    for e in entries:
        h, slash, p = e.partition("/")
        if host and under(h) and (not slash or (path + "/").startswith("/" + p + "/")):
            return host, path, None, "block"
    return host, path, None, "allow"


def got(df):
    return [(r.host, r.path, r.rule, r.verdict) for r in df.collect()]


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_random_urls(spark, monkeypatch, block):
    monkeypatch.setattr(U, "BLOCK_BYTES", block)
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "example", "net", "org", "com", "EN"])
    entries = ["b.com", "a.example.org", "a.com/x", "com/b/en", "bad.a"]
    urls = [None, "", "no scheme", "http://", "x://B.com?://", "http://a.b.com#://q"]
    for _ in range(400):
        host = ".".join(label() for _ in range(rng.randint(1, 4)))
        urls.append(rng.choice(["http", "HTTPS", ""]) + "://" + host + rng.choice(["", "/", "/en/", "/fr/x", "/x", "/xy", "/b/en/q", "?a=/en/", "#/de/"]))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").selectExpr("1 AS row", "'h' AS host", "*").coalesce(1)
    listed = spark.createDataFrame([(e,) for e in [*entries, "b.com", "", None]], "entry string")
    assert got(U.judge_urls(df, listed, RULES)) == [brute(u, entries, RULES) for u in urls]
    assert set(got(U.judge_urls(df, listed.limit(0), []))) == {(*brute(u, [], [])[:2], None, "allow") for u in urls}
    assert U.judge_urls(df.limit(0), listed, RULES).count() == 0


def test_colliding_digests_need_the_string(tmp_path, monkeypatch):
    monkeypatch.setattr(U, "digests", lambda texts: np.array([len(t) for t in texts], dtype=np.uint64))
    file = tmp_path / "list"
    file.write_bytes(U.pack(["ab.c", "xy.c", "long.example"]))
    a = U.DigestArray(str(file))
    assert a.holds([b"xy.c", b"ab.c", b"zz.c", b"q", b"long.example"]).tolist() == [True, True, False, False, True]


def test_whole_table_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = duck.execute(ORACLES["op8_url_filter"]).fetchall()
    rows = [tuple(r) for r in QUERIES["op8_url_filter"](spark, folder).collect()]
    key = lambda r: repr(r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert all(r[1:] == brute(pages[r[0]], BLOCKED_HOSTS, RULES) for r in rows)
