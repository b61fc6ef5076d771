"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is leaked by a document that contains at least `threshold` of the item's distinct
shingles of five words (A-Z in lower case). Items are short and documents can be thousands of times
longer, so a signature of the document says nothing about a short item inside it. The
sketch therefore stands on the item's side: its smallest shingle hashes, as in
bottom-k MinHash. Items are partitioned by size, and each class takes so many hashes
(`sketch_size` of its largest size) that a document with enough of the shingles must
hold one of them. The search so has no misses, at any length of a document.

Documents are searched in one pass without a shuffle: sketches are broadcast in blocks of items
of at most BLOCK_BYTES, measured before they are collected; a larger benchmark takes one pass per
block. Candidates are verified on the shingles themselves, not on hashes.

Defined cases: items of fewer than five words have no shingle and match nothing; null
and empty texts match nothing; repeated documents each get their rows, repeated items
one; columns other than ids and texts are not looked at and pass through the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W

SHINGLE = 5
THRESHOLD = 0.8
# Shingles of the items of one block, as text; a broadcast block takes about twice this.
BLOCK_BYTES = 16 << 20
LEAK = "item_id bigint, n_shingles int, n_shared int, containment double"


def shingle_texts(text: bytes, k: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()
    return [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]


def needed(size: int, threshold: float) -> int:
    """Fewest shared shingles of `size` that reach the threshold."""
    return int(np.ceil(threshold * size - 1e-9))


def size_class(size: int) -> int:
    """Sizes above 2 ** (c - 1) and up to 2 ** c are class c."""
    return int(size - 1).bit_length()


def sketch_size(size: int, threshold: float) -> int:
    """Hashes that an item of this size keeps: one more than the largest of its class may miss."""
    largest = 1 << size_class(size)
    return min(size, largest - needed(largest, threshold) + 1)


class Sketches:
    """The sketches of a block of items, sorted by hash, and the items' shingles."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float):
        self.ids, self.sets, self.need, hashes, owners = [], [], [], [], []
        for item, text in items:
            own = set(shingle_texts(text))
            if not own:
                continue
            words = W.split(pa.array([text.decode()]), lower=True)
            values = np.unique(W.shingles(W.hashes(words), SHINGLE))[:sketch_size(len(own), threshold)]
            hashes.append(values)
            owners.append(np.full(len(values), len(self.ids)))
            self.ids.append(item)
            self.sets.append(frozenset(own))
            self.need.append(needed(len(own), threshold))
        none = np.zeros(0, dtype=np.uint64)
        values, owner = np.concatenate([none, *hashes]), np.concatenate([none.astype(np.int64), *owners])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.need = np.array(self.need, dtype=np.int64)

    def candidates(self, texts: pa.Array):
        """(row, item) pairs where a text holds a hash of an item's sketch and is long enough."""
        words = W.split(texts, lower=True)
        shingles = W.shingles(W.hashes(words), SHINGLE)
        if not len(shingles) or not len(self.values):
            return []
        rows = words.row
        left = np.searchsorted(self.values, shingles, side="left")
        hit = np.flatnonzero((left < len(self.values)) & (self.values[np.minimum(left, len(self.values) - 1)] == shingles))
        hit = hit[rows[hit] == rows[hit + SHINGLE - 1]]
        right = np.searchsorted(self.values, shingles[hit], side="right")
        size = words.count - SHINGLE + 1
        found = set()
        for at, a, b in zip(rows[hit].tolist(), left[hit].tolist(), right.tolist(), strict=True):
            found.update((at, i) for i in self.owner[a:b].tolist() if size[at] >= self.need[i])
        return sorted(found)

    def leaks(self, texts: pa.Array):
        """(row, item id, shingles, shared) of every verified leak."""
        for at, n in W.pieces(texts):
            part, last, own = texts.slice(at, n), None, set()
            for row, i in self.candidates(part):
                if row != last:
                    last, own = row, set(shingle_texts(part[row].as_py().encode()))
                shared = len(self.sets[i] & own)
                if shared >= self.need[i]:
                    yield at + row, self.ids[i], len(self.sets[i]), shared


def _blocks(items: DataFrame, id_column: str, text_column: str, threshold: float):
    """Broadcast sketches, as many as it takes to keep each within BLOCK_BYTES."""
    rows = items.select(F.col(id_column).cast("bigint").alias("item"), F.col(text_column).alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") * SHINGLE), F.lit(0))).first()[0]
    count = int(size // BLOCK_BYTES) + 1
    spark = items.sparkSession
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block) if count > 1 else rows
        found = sorted(((r.item, r.text.encode()) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r))
        yield spark.sparkContext.broadcast(Sketches(found, threshold))


def leaked_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it leaks."""
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text, threshold):
        part = base.mapInArrow(_search(block), f"doc_id bigint, {LEAK}")
        out = part if out is None else out.union(part)
    return out


def _search(block):
    def run(batches):
        for batch in batches:
            found = list(block.value.leaks(W.plain_strings(batch.column("text"))))
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id").take(rows), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()),
                 pa.array([f[3] / f[2] for f in found], pa.float64())],
                ["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
            )

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    for block in _blocks(items, item_id, item_text, threshold):
        docs = docs.mapInArrow(_without(block, docs.columns.index(text_column)), docs.schema)
    return docs


def _without(block, text: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for row, *_ in block.value.leaks(W.plain_strings(batch.column(text))):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run
