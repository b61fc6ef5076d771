"""Repairs against searching all edit sequences, and the query against its SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from tracewell.llm import conversations as C
from tracewell.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def searched(signature):
    """Cheapest (cost, audit, roles) by trying every edit sequence, with up to two inserted turns at each place."""
    best = {}

    def go(at, cost, audit, roles):
        if cost > best.get("bound", 10**9):
            return
        if at == len(signature):
            for more in ("", "u", "a", "ua"):
                whole = roles + more
                if GOOD.fullmatch(whole):
                    key = (cost + 3 * len(more), audit + "I" * len(more))
                    if key < best.get("key", (10**9, "")):
                        best.update(key=key, roles=whole, bound=key[0])
            return
        letter = signature[at]
        stays = 3 if letter.isupper() else 0
        for more in ("", "u", "a", "ua", "au"):
            c, a, r = cost + 3 * len(more), audit + "I" * len(more), roles + more
            go(at + 1, c + 4, a + "D", r)
            if letter != "x":
                if letter.lower() != "o":
                    go(at + 1, c + stays, a + "K", r + letter.lower())
                for new in "ua":
                    go(at + 1, c + 3 + stays, a + "R", r + new)

    best["bound"] = 7 * len(signature) + 6
    go(0, 0, "", "")
    return best["key"], best["roles"]


def test_every_short_signature():
    automaton, count = C.SuffixAutomaton(), 0
    letters = "suaoSUAOx"
    rng = random.Random(4)
    some = ["", *letters, *(a + b for a in letters for b in letters), *("".join(rng.choice(letters) for _ in range(n)) for n in (3, 4) for _ in range(40))]
    for signature in some:
        assert automaton.repair(signature) == searched(signature)[0]
        count += 1
    assert count == len(some)


def test_equal_endings_are_one_node():
    automaton = C.SuffixAutomaton()
    automaton.repair("suauaua")
    before = len(automaton.nodes)
    automaton.repair("xuauaua")
    automaton.repair("uaua")
    assert before == 7 and len(automaton.nodes) == 8


@pytest.mark.parametrize("part", [1, 3, 100_000])
def test_dealing_by_endings_changes_nothing(spark, part):
    rng = random.Random(part)
    some = {"".join(rng.choice("suaSUx") for _ in range(rng.randint(0, 5))) + rng.choice(["", "ua" * 9, "ua" * 40]) for _ in range(300)}
    got = {r.signature: (r.cost, r.audit) for r in C.signature_repairs(spark.createDataFrame([(s,) for s in some], "signature string"), part).collect()}
    assert got == {s: C.SuffixAutomaton().repair(s) for s in some}


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        letter = role[0] if role and role[0] in "sua" else "o"
        letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        if fault:
            counts[fault] += 1
    (cost, audit), roles = searched(letters)
    out, at, place = [], 0, 0
    for edit in audit:
        full = {"u": "user", "a": "assistant"}
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            out.append((full[roles[place]], ""))
        else:
            out.append((rows[at][1] if edit == "K" else full[roles[place]], rows[at][2]))
            at += 1
        place += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return cost, audit, out, counts, gaps, sum(p not in ("su", "ua", "au") for p in pairs)


CONVERSATIONS = {
    1: [(0, "system", "Be kind."), (1, "user", "Hi?"), (2, "assistant", "Hello.")],
    2: [(0, "user", None), (1, None, "Who"), (None, "assistant", "First.")],
    3: [(5, "assistant", "A."), (5, "assistant", "A."), (9, "tool", "x"), (9, "", "y.")],
    4: [(0, "user", "cut off"), (3, "user", "end! \n"), (3, "ugly", "kept?")],
    5: [(2, "system", "only.")],
    6: [(1, "user", ""), (1, "user", " \t")],
    None: [(None, None, None), (7, "user", "q?")],
    8: [(2**62, "user", "q?"), (-2**62, "assistant", "a.")],
}


def test_rows_of_every_kind(spark):
    rows = [(c, t, r, x, "clash") for c, rs in CONVERSATIONS.items() for t, r, x in rs]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, head string").repartition(3)
    plan = C.repair_plan(df)
    repaired = C.repaired_rows(df, plan)
    told = {r.conv_id: r for r in plan.collect()}
    out = {}
    for r in sorted(repaired.collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    digests = {r.conv_id: r.repaired_sha256 for r in C.repaired_digests(repaired).collect()}
    assert set(told) == set(CONVERSATIONS)
    for conv, rs in CONVERSATIONS.items():
        cost, audit, texts, counts, gaps, illegal = plain_repair(rs)
        got = told[conv]
        assert (got.cost, got.audit, got.gaps, got.illegal, got.n_rows) == (cost, audit, gaps, illegal, len(rs))
        assert {k: got[k] for k in counts} == counts
        assert out.get(conv, []) == texts
        if texts:
            assert digests[conv] == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in texts).encode()).hexdigest()
    empty = df.limit(0)
    assert C.repair_plan(empty).count() == 0 and C.repaired_rows(empty, C.repair_plan(empty)).count() == 0


def test_long_conversation(spark):
    df = spark.range(30_000).selectExpr("7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, '.') AS text")
    plan = C.repair_plan(df)
    got = plan.first()
    assert (got.cost, got.audit) == (0, "K" * 30_000)
    assert C.repaired_rows(df, plan).count() == 30_000


def both(spark, folder):
    got = QUERIES["op13_conversation_repair"](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet' || if('{folder}' LIKE '/root%', '', '/*.parquet'))")
    cursor = duck.execute(ORACLES["op13_conversation_repair"])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = [{n: v for n, v in zip(names, r, strict=True)} for r in cursor.fetchall()]
    order = sorted(names)
    return sorted(repr([r[n] for n in order]) for r in got.collect()), sorted(repr([r[n] for n in order]) for r in want)


def test_query_equals_sql(spark):
    got, want = both(spark, FOLDER)
    assert got == want and len(got) > 10


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", None, "tool", "", "ugly"], ["Yes.", "No!", "cut", "", None, " \t", "é? \n", "."]
    rows = [(rng.choice([None, -3, *range(40)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(c, t, "user", "Lost?") for c in range(1000, 1400) for t in (0,)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = both(spark, str(tmp_path))
    assert got == want
    assert any("''" in r for r in got)
