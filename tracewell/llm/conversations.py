"""Conversation structure repair over a suffix-shared DAWG.

A conversation should be an optional system turn and then pairs of a user and an assistant turn: its role initials
match `(s?(ua)+)?`. Each row has a first fault: blank (no character but white space), duplicate (role and
text stand earlier in the conversation), truncated (its last such character is none of `.!?`). Edits are

    K keep      costs 0; the row's initial must fit the grammar
    R rerole    costs 3; to user or assistant
    D delete    costs 4; blank and duplicate rows must go
    I insert    costs 3; an empty turn of user or assistant

and a truncated row that stays costs 3 more. The repair is the cheapest sequence of edits, of equal ones the one whose
initials come first in ASCII order.

1. Rows are dealt by conversation, sorted, and folded as they stream by into one signature per
   conversation: a letter per row, lower case for a sound row (s, u, a, o for any other role), upper case for a
   truncated one, x for one that must go.
2. Distinct signatures are dealt by their endings. Each part is an automaton built from the end: a node is a
   letter and the node behind it, so equal endings of all conversations are one node. A node and a state of the grammar (start, behind
   the system turn, behind a user turn, behind an assistant turn) have the cost to go and the first edit of the best audit, worked out
   once. In each state an edit leads to one state only, so equally cheap edits differ in their first letter, and the audit suffix of
   a node is its first edit followed by that of a known node: it is read off along the signature. An
   ending that is shared by more signatures than a part should hold is dealt by more letters; endings shorter than that are nodes in each part.
3. Costs and audits join the conversations by signature. An audit goes to its conversation's rows as a row
   of its own that sorts first, so that the rows are repaired as they stream by.

No conversation is held in memory but its signature, its audit and 16 bytes per distinct row.

Defined cases: null roles and texts are one space; rows stand by turn (nulls first), then by role and text; a null conversation id is a
conversation; repeated rows are duplicates; an empty table has no conversations; columns other than those named are not looked at. A
span of turns beyond the range of a bigint has null gaps.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import shuffle_partitions
from tracewell.session import materialize

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# Signatures of one part, and the letters of their endings that deal them at first.
PART_SIGNATURES = 100_000
ENDING = 8

START, SYSTEM, USER, ASSISTANT = range(4)
# The state behind the one role that can be inserted, or that a row can be given, in each state.
NEXT = (USER, USER, ASSISTANT, USER)
GIVEN = ("user", "user", "assistant", "user")
FITS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})

SIGNATURE = "conv_id bigint, n_rows bigint, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
LEGAL = {"su", "ua", "au"}


class Folded:
    """One conversation's rows, as far as they have streamed by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.letters: list[str] = []
        self.seen: set[bytes] = set()
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.before: str | None = None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            if turn != self.turn:           # turns come in order
                self.turns += 1
            self.turn = self.high = turn
            self.low = turn if self.low is None else self.low
        key = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        said = text.rstrip(SPACES)
        if not said:
            fault = "blank"
        elif key in self.seen:
            fault = "duplicate"
        else:
            fault = None if said[-1] in ENDS else "truncated"
        self.seen.add(key)
        if fault:
            self.faults[fault] += 1
        letter = initial if initial in ("s", "u", "a") else "o"
        self.letters.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        gaps = gaps if gaps < 1 << 63 else None
        return (self.conv_id, len(self.letters), "".join(self.letters), gaps, *self.faults.values(), self.illegal)


def _batches(rows, schema: pa.Schema, size: int = 2000):
    """Record batches of the tuples; long strings make a batch shorter."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight > 8 << 20:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _tuples(batches, names: list[str]):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


_COUNTS = pa.schema([(n, pa.string() if n == "signature" else pa.int64()) for n in "conv_id n_rows signature gaps blank duplicate truncated illegal".split()])


def _fold(batches):
    def rows():
        now = None
        for conv_id, turn, role, text in _tuples(batches, ["conv_id", "turn", "role", "text"]):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.row()
                now = Folded(conv_id)
            now.add(turn, role, text)
        if now is not None:
            yield now.row()

    return _batches(rows(), _COUNTS)


class SuffixAutomaton:
    """Nodes are (letter, node behind); values are worked out when a node is made."""

    def __init__(self):
        self.nodes: dict[tuple[str, int], int] = {}
        # behind the last row: nothing is missing, or a user turn, an assistant turn, or both are inserted
        self.cost = [(0, 2 * INSERT, INSERT, 0)]
        self.edit = [("", "I", "I", "")]

    def node(self, letter: str, behind: int) -> int:
        key = (letter, behind)
        found = self.nodes.get(key)
        if found is None:
            found = self.nodes[key] = len(self.cost)
            cost, edit = _best(letter, self.cost[behind])
            self.cost.append(cost)
            self.edit.append(edit)
        return found

    def repair(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature, read off its nodes from the front."""
        path = [0]
        for letter in reversed(signature):
            path.append(self.node(letter, path[-1]))
        state, audit = START, []
        for at in range(len(signature), -1, -1):
            while True:
                edit = self.edit[path[at]][state]
                audit.append(edit)
                if edit != "I":
                    break
                state = NEXT[state]
            state = _after(edit, signature[-at].lower() if at else "", state)
        return self.cost[path[-1]][START], "".join(audit)


def _after(edit: str, initial: str, state: int) -> int:
    return FITS[state][initial] if edit == "K" else NEXT[state] if edit == "R" else state


def _best(letter: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost to go and first edit of every state in front of a row, from the costs behind it."""
    initial = letter.lower()
    stays = TRUNCATED if letter.isupper() else 0
    found = []
    for state in range(4):
        ways = [(DELETE + behind[state], "D")]
        if letter != "x":
            ways.append((REROLE + stays + behind[NEXT[state]], "R"))
            if initial in FITS[state]:
                ways.append((stays + behind[FITS[state][initial]], "K"))
        found.append(min(ways))
    for _ in range(2):          # a third inserted turn would lead back to a state already met
        found = [min(found[state], (INSERT + found[NEXT[state]][0], "I")) for state in range(4)]
    return tuple(c for c, _ in found), tuple(e for _, e in found)


_AUDIT = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def _repair_signatures(batches):
    automaton = SuffixAutomaton()

    def rows():
        for (signature,) in _tuples(batches, ["signature"]):
            yield (signature, *automaton.repair(signature))

    return _batches(rows(), _AUDIT)


def signature_repairs(signatures: DataFrame, part_signatures: int = PART_SIGNATURES) -> DataFrame:
    """signature, cost and audit of distinct signatures, dealt so that equal endings meet."""
    letters = ENDING
    while True:
        # counts only; one more round for each doubling of the letters
        ending = F.substring("signature", -letters, letters) if letters else F.lit("")
        ending = F.when(F.length("signature") > letters, ending).otherwise(F.col("signature"))
        held = signatures.groupBy(ending.alias("ending")).agg(F.count("*").alias("n"), F.max(F.length("signature")).alias("longest"))
        crowded = held.where(F.col("n") > part_signatures).agg(F.max("longest")).first()[0]
        if crowded is None or crowded <= letters:
            break
        letters *= 2
    dealt = signatures.repartition(shuffle_partitions(signatures), ending)
    return dealt.mapInArrow(_repair_signatures, "signature string, cost bigint, audit string")


def _ordered(rows: DataFrame, *extra: Column) -> DataFrame:
    order = ["conv_id", *extra, F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition(shuffle_partitions(rows), "conv_id").sortWithinPartitions(*order)


def plain_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"))


def repair_plan(rows: DataFrame, **columns: str) -> DataFrame:
    """Per conversation conv_id, n_rows, signature, gaps, blank, duplicate, truncated, illegal, cost and audit."""
    folded = materialize(_ordered(plain_rows(rows, **columns)).mapInArrow(_fold, SIGNATURE), "signatures")
    repairs = signature_repairs(folded.select("signature").distinct())
    return folded.join(repairs, "signature")


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches):
    """Rows behind their conversation's audit to the repaired rows."""
    def rows():
        audit, at, state, place, left = "", 0, START, 0, 0
        for conv_id, head, role, text in _tuples(batches, ["conv_id", "head", "role", "text"]):
            if head:
                audit, at, state, place = text, 0, START, 0
                left = len(audit) - len(audit.rstrip("I"))
                continue
            while audit[at] == "I":
                yield conv_id, place, GIVEN[state], ""
                state, place, at = NEXT[state], place + 1, at + 1
            edit = audit[at]
            at += 1
            if edit != "D":
                yield conv_id, place, role if edit == "K" else GIVEN[state], text
                state, place = _after(edit, role[:1], state), place + 1
            if at == len(audit) - left:         # the last row
                for _ in range(left):
                    yield conv_id, place, GIVEN[state], ""
                    state, place, at = NEXT[state], place + 1, at + 1

    return _batches(rows(), _REPAIRED)


def repaired_rows(rows: DataFrame, plan: DataFrame, **columns: str) -> DataFrame:
    """conv_id, place, role and text of every repaired conversation's rows; a conversation's rows follow
    each other in one partition, by place."""
    heads = plan.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("head"))
    both = plain_rows(rows, **columns).withColumn("head", F.lit(False)).unionByName(heads)
    return _ordered(both, F.col("head").desc()).mapInArrow(_apply, "conv_id bigint, place bigint, role string, text string")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _digest(batches):
    def rows():
        state = None
        last = None
        for conv_id, place, role, text in _tuples(batches, ["conv_id", "place", "role", "text"]):
            if place == 0:
                if state is not None:
                    yield last, state.hexdigest()
                state = sha256(f"{role}:{text}".encode())
            else:
                state.update(f"\n{role}:{text}".encode())
            last = conv_id
        if state is not None:
            yield last, state.hexdigest()

    return _batches(rows(), _DIGEST)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the sha256 of `role:text` of its rows, joined by line feeds; none without rows. Works on
    `repaired_rows` as they stream by."""
    return repaired.mapInArrow(_digest, "conv_id bigint, repaired_sha256 string")
