"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits; bit i is set where over half of the 3-word shingle hashes
have it. Fingerprints that differ in at most two bits are linked, and the components of
these links are the groups.

Anchors are the codewords of a covering code for each half of 32 bits: the perfect
Hamming code on 31 bits (each pattern is within one bit of exactly one codeword) beside one
plain bit. Of two fingerprints within two bits, one half differs in at most one. So a
fingerprint stands at the anchor that covers its half (radius 1), and also visits the
anchors within radius + 1, where a neighbour of its half can stand. Halves that differ in one
bit have different parity, so only halves of odd parity need to visit.

Distinct fingerprints alone are replicated and compared: copies of one text cost one
row. An anchor gives a spanning forest of its links instead of all pairs.

Defined cases: a null or empty text has fingerprint zero; texts of one or two words are
one shingle; a null id never names a component unless all its ids are null; repeated rows
get equal results; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W
from tracewell.llm.common import checkpointed, shuffle_partitions
from tracewell.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
# Up to so many rows an anchor's rows are compared shift by shift with those of other anchors.
FEW = 32
# From so many rows on, an anchor is split by equal parts of the other half.
MANY = 4096


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        found = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], end[:-SHINGLE] + 1])
        found = [digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end[SHINGLE - 1:].tolist(), strict=True)]
    bits = np.unpackbits(np.array(found, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(found)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = W.plain_strings(batch.column("text"))
        prints = np.fromiter((fingerprint(t.as_py().encode()) for t in texts), np.uint64, len(texts))
        yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, print) of every row; print holds the 64 bits as a signed number."""
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return base.mapInArrow(_fingerprints, "doc_id bigint, print bigint")


def _syndromes() -> np.ndarray:
    """Per byte position and value: exclusive or of the numbers 1..31 of its set bits."""
    table = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                number = 8 * byte + bit + 1
                if value >> bit & 1 and number < 32:
                    table[byte, value] ^= np.uint32(number)
    return table


_SYNDROME = _syndromes()


def anchor(half: np.ndarray) -> np.ndarray:
    """The codeword that covers each 32-bit half: at most one of the lower 31 bits flips."""
    half = half.astype(np.uint32)
    s = np.zeros(len(half), dtype=np.uint32)
    for byte in range(4):
        s ^= _SYNDROME[byte][(half >> np.uint32(8 * byte)) & np.uint32(255)]
    flip = np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), np.uint32(0))
    return half ^ flip.astype(np.uint32)


def _replicate(batches):
    """(side * 2^32 + anchor, print, home) of every print: its own anchors and those it visits."""
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        for side in (0, 1):
            half = ((prints >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            home = anchor(half)
            odd = (np.bitwise_count(half) & 1).astype(bool)
            rows = [(home, prints, np.ones(len(prints), dtype=bool))]
            visitors, standing = prints[odd], home[odd]
            near = np.stack([anchor(half[odd] ^ np.uint32(1 << bit)) for bit in range(32)], axis=1) if odd.any() else np.zeros((0, 32), np.uint32)
            near.sort(axis=1)
            fresh = near != standing[:, None]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            who, _ = np.nonzero(fresh)
            rows.append((near[fresh], visitors[who], np.zeros(len(who), dtype=bool)))
            for anchors, values, own in rows:
                place = anchors.astype(np.int64) + (np.int64(side) << np.int64(32))
                yield pa.record_batch([pa.array(place), pa.array(values.view(np.int64)), pa.array(own)], ["place", "print", "home"])


def _close(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def _forest(prints: np.ndarray, home: np.ndarray):
    """A spanning forest of the links among one anchor's rows; two visitors meet elsewhere."""
    if len(prints) > MANY:
        parts = [(prints >> np.uint64(s)) & np.uint64(m) for s, m in _THIRDS[int(_other(prints))]]
    else:
        parts = [np.zeros(len(prints), dtype=np.uint64)]
    for part in parts:
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(order, cut):
            yield from _spread(prints[group], home[group])


# Of a half that differs in at most two bits, one of three parts is equal.
_THIRDS = {side: [(32 * side, 0x7FF), (32 * side + 11, 0x7FF), (32 * side + 22, 0x3FF)] for side in (0, 1)}


def _other(prints: np.ndarray) -> int:
    """The half in which an anchor's rows differ: the one with more distinct values."""
    low = len(np.unique(prints & np.uint64(0xFFFFFFFF)))
    return 0 if low >= len(np.unique(prints >> np.uint64(32))) else 1


def _spread(prints: np.ndarray, home: np.ndarray):
    left = np.ones(len(prints), dtype=bool)
    for first in range(len(prints)):
        if not left[first]:
            continue
        left[first] = False
        front = [first]
        while front:
            at = front.pop()
            open_ = np.flatnonzero(left)
            if not home[at]:
                open_ = open_[home[open_]]
            hit = open_[_close(prints[open_], prints[at])]
            left[hit] = False
            front.extend(hit.tolist())
            for x in hit:
                yield prints[at], prints[x]


def _link(batches):
    """Rows come sorted by place; edges between prints within the distance."""
    kept = None
    for batch in batches:
        place = batch.column("place").to_numpy()
        prints = batch.column("print").to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False)
        if kept is not None:
            place, prints, home = (np.concatenate(x) for x in zip(kept, (place, prints, home), strict=True))
        if not len(place):
            continue
        # the last place may go on in the next batch
        stop = int(np.searchsorted(place, place[-1]))
        kept = (place[stop:], prints[stop:], home[stop:])
        yield _links(place[:stop], prints[:stop], home[:stop])
    if kept is not None:
        yield _links(*kept)


def _links(place, prints, home) -> pa.RecordBatch:
    edges_a, edges_b = [], []
    if len(place):
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        size = np.diff(np.append(begin, len(place)))
        few = np.repeat(size <= FEW, size)
        for lag in range(1, min(FEW, len(place))):
            same = few[:-lag] & (place[lag:] == place[:-lag])
            if not same.any():
                break
            hit = np.flatnonzero(same & (home[lag:] | home[:-lag]) & _close(prints[lag:], prints[:-lag]))
            edges_a.append(prints[hit])
            edges_b.append(prints[hit + lag])
        for g in np.flatnonzero(size > FEW):
            a, b = begin[g], begin[g] + size[g]
            pairs = list(_forest(prints[a:b], home[a:b]))
            if pairs:
                edges_a.append(np.array([p[0] for p in pairs], dtype=np.uint64))
                edges_b.append(np.array([p[1] for p in pairs], dtype=np.uint64))
    a = np.concatenate(edges_a) if edges_a else np.zeros(0, dtype=np.uint64)
    b = np.concatenate(edges_b) if edges_b else np.zeros(0, dtype=np.uint64)
    return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def print_groups(prints: DataFrame) -> DataFrame:
    """(node, root) of every print that has a link; prints: distinct `print`."""
    parts = shuffle_partitions(prints)
    edges = (
        prints.select("print").mapInArrow(_replicate, "place bigint, print bigint, home boolean")
        .repartition(parts, "place").sortWithinPartitions("place")
        .mapInArrow(_link, "a bigint, b bigint")
    )
    return components(edges)


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, print and component_id (smallest doc_id reachable) of every row."""
    marks = checkpointed(fingerprints(docs, id_column, text_column))
    lowest = checkpointed(marks.groupBy("print").agg(F.min("doc_id").alias("lowest")))
    groups = print_groups(lowest)
    rooted = lowest.join(groups, lowest.print == groups.node, "left").select("print", "lowest", F.coalesce("root", "print").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = rooted.join(heads, "root").select("print", "component_id")
    return marks.join(named, "print").select("doc_id", "print", "component_id")
