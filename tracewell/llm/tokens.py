"""Token counts that survive edits.

A text is cut into pre-tokens, each encoded on its own, so a text's count is the sum of
its pre-tokens' counts. Each document keeps them as the leaves of a segment tree (a leaf
holds up to LEAF pre-tokens) with subtree sums of characters and tokens. An edit

1. finds the first pre-token it can touch by descending the tree along the character sums,
2. cuts the new text again from there until a boundary falls on an old one behind the edit,
3. encodes the pre-tokens between, and
4. updates the sums on the paths of the leaves it replaced.

A pre-token depends on its own characters and at most two more (`\\s+(?!\\S)` and the
contractions look ahead), which is the boundary context of step 1.

The rank file is a parameter; its bytes are broadcast (they are measured first), so
executors need no copy. Defined cases: null and empty texts have 0 tokens; null edits are
none; edits apply in order, each to the text that the one before left; positions beyond
the text are cut to its length, an end before the start is the start, and a null replacement is empty; repeated rows are treated
alike; columns other than those named are not looked at.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The pattern that the rank file belongs to; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTEXT = 2
LEAF = 16
# Pre-tokens whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 200_000
RANKS_BYTES = 32 << 20
EDITS = "array<struct<start: int, end: int, text: string>>"


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def one(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            count = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return count

    def cut(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of every pre-token."""
        found = self.pattern.findall(text)
        return list(map(len, found)), list(map(self.one, found))

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


class TokenTree:
    """Segment tree over leaves of pre-tokens; node 1 is the root, 2 i and 2 i + 1 are below i."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = [(chars[i:i + LEAF], tokens[i:i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, (c, t) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(c), sum(t)
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if position >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves first to last (inclusive) now hold these pre-tokens, in equal shares."""
        count = last - first + 1
        share = -(-len(chars) // count)
        for i in range(count):
            c, t = chars[i * share:(i + 1) * share], tokens[i * share:(i + 1) * share]
            self.leaves[first + i] = (c, t)
            self.chars[self.width + first + i], self.tokens[self.width + first + i] = sum(c), sum(t)
        a, b = (self.width + first) // 2, (self.width + last) // 2
        while a:
            for i in range(a, b + 1):
                self._add_up(i)
            a, b = a // 2, b // 2

    def edit(self, counter: Counter, text: str, start: int, end: int, new: str) -> tuple[str, int]:
        """The edited text, and how many pre-tokens were encoded."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        shift = len(new) - (end - start)
        # The first pre-token that may read a character at or behind start.
        leaf, at = self.locate(min(max(0, start - CONTEXT), self.chars[1] - 1)) if self.chars[1] else (0, 0)
        chars, tokens = self.leaves[leaf]
        keep = 0
        while keep < len(chars) and at + chars[keep] + CONTEXT <= start:
            at += chars[keep]
            keep += 1
        head = (chars[:keep], tokens[:keep])
        text = text[:start] + new + text[end:]
        # Cut again; walk along the old boundaries behind the edit until one is met.
        last, i, old = leaf, keep, at
        fresh_chars, fresh_tokens, done = [], [], at
        for m in counter.pattern.finditer(text, at):
            goal = done - shift
            while old < goal:
                if i < len(self.leaves[last][0]):
                    old += self.leaves[last][0][i]
                    i += 1
                elif last + 1 < len(self.leaves):
                    last, i = last + 1, 0
                else:
                    break
            if done >= start + len(new) and old == goal and goal >= end:
                break
            piece = m[0]
            fresh_chars.append(len(piece))
            fresh_tokens.append(counter.one(piece))
            done = m.end()
        else:
            last, i = len(self.leaves) - 1, len(self.leaves[-1][0])
        tail = (self.leaves[last][0][i:], self.leaves[last][1][i:])
        self.replace(leaf, last, head[0] + fresh_chars + tail[0], head[1] + fresh_tokens + tail[1])
        return text, len(fresh_chars)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(c) for c, _ in self.leaves], dtype="<u4")
        chars = np.array([x for c, _ in self.leaves for x in c], dtype="<u4")
        tokens = np.array([x for _, t in self.leaves for x in t], dtype="<u4")
        return struct.pack("<II", len(sizes), len(chars)) + sizes.tobytes() + chars.tobytes() + tokens.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenTree:
        leaves, n = struct.unpack_from("<II", data)
        sizes, chars, tokens = (np.frombuffer(data, "<u4", k, o).tolist() for k, o in ((leaves, 8), (n, 8 + 4 * leaves), (n, 8 + 4 * leaves + 4 * n)))
        tree, at = cls([], []), 0
        tree.leaves = []
        for size in sizes:
            tree.leaves.append((chars[at:at + size], tokens[at:at + size]))
            at += size
        tree.width = 1 << (leaves - 1).bit_length()
        tree.chars, tree.tokens = [0] * (2 * tree.width), [0] * (2 * tree.width)
        for i, (c, t) in enumerate(tree.leaves):
            tree.chars[tree.width + i], tree.tokens[tree.width + i] = sum(c), sum(t)
        for i in range(tree.width - 1, 0, -1):
            tree._add_up(i)
        return tree


def ranks(spark: SparkSession, path: str):
    """The broadcast bytes of a rank file that the driver can read."""
    with open(path, "rb") as file:
        data = file.read(RANKS_BYTES + 1)
    if len(data) > RANKS_BYTES:
        raise ValueError(f"{path} is larger than {RANKS_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pretokens and tree (bytes) of every row."""
    data = ranks(docs.sparkSession, path)

    def run(batches):
        counter = Counter(data.value)
        for batch in batches:
            trees = [TokenTree(*counter.cut(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([t.total for t in trees], pa.int64()),
                 pa.array([sum(len(c) for c, _ in t.leaves) for t in trees], pa.int64()),
                 pa.array([t.to_bytes() for t in trees], pa.binary())],
                ["doc_id", "n_tokens", "n_pretokens", "tree"],
            )

    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_pretokens bigint, tree binary")


COUNTED = "doc_id bigint, n_pretokens bigint, n_tokens_before bigint, n_edits int, n_encoded bigint, n_tokens bigint, text string, tree binary"


def recount_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                   edits_column: str = "edits", tree_column: str | None = None, state: bool = True) -> DataFrame:
    """Apply each row's edits: counts before and after, pre-tokens encoded again, new text and tree.

    edits_column holds EDITS. tree_column holds the trees of count_tokens; without it
    they are built here. Without `state` the new text and tree are left out.
    """
    data = ranks(docs.sparkSession, path)
    schema = COUNTED if state else COUNTED.removesuffix(", text string, tree binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        counter = Counter(data.value)
        for batch in batches:
            rows = []
            for i, text, edits, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "edits", "tree")), strict=True):
                text = text or ""
                tree = TokenTree(*counter.cut(text)) if stored is None else TokenTree.from_bytes(stored)
                size = sum(len(c) for c, _ in tree.leaves)
                before, encoded = tree.total, 0
                for e in edits or ():
                    text, n = tree.edit(counter, text, e["start"] or 0, e["end"] or 0, e["text"] or "")
                    encoded += n
                row = (i, size, before, len(edits or ()), encoded, tree.total)
                rows.append((*row, text, tree.to_bytes()) if state else row)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types[:len(names)], strict=True)], names)

    base = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"),
        F.col(edits_column).cast(EDITS).alias("edits"),
        (F.col(tree_column) if tree_column else F.lit(None).cast("binary")).alias("tree"),
    )
    return base.mapInArrow(run, schema)
