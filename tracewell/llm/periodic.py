"""Periodic runs by online dyadic square catching.

A run of a text is a stretch of words with a smallest period q, as long as max(shortest, 2 q) or longer,
that no neighbouring word extends with period q. It holds squares: two equal halves of q words.

`SquareCatcher` takes appended words. Words are grouped in aligned blocks of 1, 2, 4, 8 ... words. The first
half of a square with period q holds a whole block of B words for the B with 2 B - 1 <= q <= 4 B - 2, and
the block stands again q words later. So every completed block of B words sets a catcher for
these distances: an appended word ends one window of B words, and exactly two blocks are at a catcher's
distance from it. Where window and block are equal, the catcher holds a stretch in which words q apart agree; the catcher of the
next block at the same distance carries the stretch on, and when it no longer does, words are compared one by one at both ends.
A stretch of q words or more is a square, and what stretches of one period cover is its run.

Equal windows are found by 64-bit hashes, built for each block size from two windows of half the size; what is reported
is compared word by word (a hash that lied makes the catcher start again with another seed). The state grows with the words;
each append of m words costs O(m log n). Inside a known run with a period of at most B words, blocks of B
words are not looked at: all their squares are powers of the run's root.

Defined cases: null and empty texts have no words and no runs; a null id changes nothing; repeated rows are treated alike;
very long texts are appended slice by slice; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W

SHORTEST = 12           # words of a run
APPEND = 1 << 16        # words given to the catcher at once
COMPARED = 1 << 20      # words compared at once

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@dataclass
class Level:
    """Blocks of one size: windows and blocks that are still needed, and stretches that may go on."""
    size: int
    seen: int                   # windows that start before are done
    windows: np.ndarray         # hashes of the windows from `windows_at` on
    windows_at: int
    blocks: np.ndarray          # hashes of the blocks from number `blocks_at` on
    blocks_at: int
    open: np.ndarray            # rows (period, first word, word after): stretches up to the last block seen


class LyingHash(Exception):
    pass


class SquareCatcher:
    """Online: append words, read the runs found so far, finish.

    Words are numbers. `shortest` is the least number of words of a run; no period is looked for beyond `longest`.
    """

    def __init__(self, longest: int, shortest: int = SHORTEST, seed: int = 0) -> None:
        self.shortest = shortest
        self.longest = longest
        self.seed = np.uint64(seed)
        self.words = np.zeros(1024, dtype=np.int64)
        self.count = 0
        self.levels: list[Level] = []
        size = 1
        while 2 * size - 1 <= longest:
            none = np.zeros(0, dtype=np.uint64)
            self.levels.append(Level(size, 0, none, 0, none, 0, np.zeros((0, 3), dtype=np.int64)))
            size *= 2
        self.caught: list[np.ndarray] = []      # rows (start, end, period)

    def append(self, new: np.ndarray) -> None:
        need = self.count + len(new)
        if need > len(self.words):
            self.words = np.concatenate([self.words[:self.count], np.zeros(2 * need - self.count, dtype=np.int64)])
        self.words[self.count:need] = new
        self.count = need
        below: Level | None = None
        for level in self.levels:
            if level.size > self.count:
                break
            self._windows(level, below)
            self._catch(level)
            below = level
        # windows that the level above has read are dropped, and so are blocks out of every catcher's reach
        for i, level in enumerate(self.levels):
            above = self.levels[i + 1] if i + 1 < len(self.levels) else None
            keep = max(level.seen if above is None else min(level.seen, above.windows_at + len(above.windows)), level.windows_at)
            level.windows, level.windows_at = level.windows[keep - level.windows_at:].copy(), keep
            first = max((level.seen - 4 * level.size) // level.size, level.blocks_at)
            if first > level.blocks_at:
                level.blocks, level.blocks_at = level.blocks[first - level.blocks_at:].copy(), first

    def _windows(self, level: Level, below: Level | None) -> None:
        """Hashes of all windows that the new words complete, and of the blocks among them."""
        start = level.windows_at + len(level.windows)
        stop = self.count - level.size + 1
        if stop <= start:
            return
        with np.errstate(over="ignore"):
            if below is None:
                fresh = W.mix(self.words[start:stop].astype(np.uint64) + W.BASE + self.seed)
            else:
                half = below.size
                left = below.windows[start - below.windows_at:stop - below.windows_at]
                right = below.windows[start + half - below.windows_at:stop + half - below.windows_at]
                fresh = W.mix(left * W.BASE + right + self.seed)
        level.windows = np.concatenate([level.windows, fresh])
        known = level.blocks_at + len(level.blocks)
        at = np.arange(known * level.size, stop, level.size)
        level.blocks = np.concatenate([level.blocks, level.windows[at - level.windows_at]])

    def _catch(self, level: Level) -> None:
        """Windows not seen yet against the two blocks whose catchers they can meet."""
        size, seen = level.size, level.seen
        stop = level.windows_at + len(level.windows)
        if stop <= seen:
            return
        level.seen = stop
        ends = np.arange(seen, stop, dtype=np.int64)
        found = []
        nearest = (ends - (2 * size - 1)) // size
        hashes = level.windows[seen - level.windows_at:]
        for block in (nearest, nearest - 1):
            place = block - level.blocks_at
            ok = block >= 0
            hit = np.flatnonzero(ok & (hashes == level.blocks[np.where(ok, place, 0)]))
            if len(hit):
                s, t = block[hit] * size, ends[hit]
                inside = t - s <= self.longest
                found.append(np.stack([(t - s)[inside], s[inside], s[inside] + size], axis=1))
        new = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
        if len(new):
            new = new[~self._known(level, new[:, 1], new[:, 2] + new[:, 0])]
        self._merge(level, new, stop)

    def _known(self, level: Level, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a stretch of a known period of at most the block size covers start to end."""
        rows = [r[r[:, 2] <= level.size] for r in self.caught]
        for lower in self.levels:
            if lower.size >= level.size:
                break
            held = lower.open
            square = (held[:, 2] - held[:, 1] >= held[:, 0]) & (held[:, 0] <= level.size)
            held = held[square]
            rows.append(np.stack([held[:, 1], held[:, 2] + held[:, 0], held[:, 0]], axis=1))
        spans = np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)
        if not len(spans):
            return np.zeros(len(start), dtype=bool)
        order = np.argsort(spans[:, 0], kind="stable")
        begins, reach = spans[order, 0], np.maximum.accumulate(spans[order, 1])
        at = np.searchsorted(begins, start, side="right") - 1
        return (at >= 0) & (reach[np.maximum(at, 0)] >= end)

    def _merge(self, level: Level, new: np.ndarray, stop: int) -> None:
        """Stretches of one period in neighbouring blocks are one; those that cannot go on are closed."""
        rows = np.concatenate([level.open, new])
        if not len(rows):
            return
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 2])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(rows)) - 1
        rows = np.stack([rows[first, 0], rows[first, 1], rows[last, 2]], axis=1)
        # the next block's copy has not been appended yet
        goes_on = rows[:, 2] + rows[:, 0] >= stop
        level.open = rows[goes_on]
        self._close(level, rows[~goes_on])

    def _close(self, level: Level, rows: np.ndarray) -> None:
        """Extend stretches word by word at both ends, by less than a block, and keep the runs."""
        rows = rows[rows[:, 2] - rows[:, 1] + 2 * (level.size - 1) >= rows[:, 0]]
        at_once = max(1, COMPARED // level.size)
        for a in range(0, len(rows), at_once):
            period, low, high = rows[a:a + at_once].T
            high = high + self._agree(high, period, level.size, 1)
            low = low - self._agree(low - 1, period, level.size, -1)
            keep = (high - low >= period) & (high - low + period >= self.shortest)
            found = np.stack([low[keep], high[keep] + period[keep], period[keep]], axis=1)
            for start, end, q in found.tolist():
                if not np.array_equal(self.words[start:end - q], self.words[start + q:end]):
                    raise LyingHash
            if len(found):
                self.caught.append(found)

    def _agree(self, start: np.ndarray, period: np.ndarray, size: int, step: int) -> np.ndarray:
        """How many words from start on (in steps of 1 or -1) equal the word `period` later, below `size`."""
        out = np.zeros(len(start), dtype=np.int64)
        alive = np.arange(len(start))
        done, width = 0, 4
        while len(alive) and done < size:
            at = start[alive, None] + step * np.arange(done, min(done + width, size))[None, :]
            far = at + period[alive, None]
            ok = (at >= 0) & (far < self.count)
            same = ok & (self.words[np.where(ok, at, 0)] == self.words[np.where(ok, far, 0)])
            run = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
            out[alive] += run
            alive = alive[run == same.shape[1]]
            done, width = done + width, 2 * width
        return out

    def finish(self) -> np.ndarray:
        """Rows (start, length, period) of all runs, by start and then by period."""
        for level in self.levels:
            self._close(level, level.open)
            level.open = level.open[:0]
        if not self.caught:
            return np.zeros((0, 3), dtype=np.int64)
        found = np.concatenate(self.caught)
        # squares of one stretch merge; the smallest period of equal stretches is the run's
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), dtype=bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[first]
        self.caught = [found]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], axis=1)


def find_runs(words: np.ndarray, longest: int, shortest: int = SHORTEST, at_once: int = APPEND) -> np.ndarray:
    """Rows (start, length, period) of the runs of a stream of word numbers."""
    for seed in range(64):
        catcher = SquareCatcher(longest, shortest, seed)
        try:
            for at in range(0, len(words), at_once):
                catcher.append(words[at:at + at_once])
            return catcher.finish()
        except LyingHash:
            continue
    raise RuntimeError("64 seeds in a row gave equal hashes to different words")


def word_numbers(words: W.Words) -> tuple[np.ndarray, pa.StringArray]:
    """A number for every word, equal for equal words, and the words themselves."""
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    data = words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return array.dictionary_encode().indices.to_numpy().astype(np.int64), array


def text_runs(texts: pa.Array, shortest: int = SHORTEST) -> list[tuple[int, np.ndarray, str]]:
    """Per text: number of words, its runs, and the text without what a run repeats."""
    words = W.split(texts)
    counts = words.count
    if not len(words.start):
        return [(0, np.zeros((0, 3), dtype=np.int64), "")] * len(counts)
    numbers, array = word_numbers(words)
    # texts follow each other in one stream; a number of its own ends each, so no square crosses it
    where = np.arange(len(numbers)) + words.row
    stream = np.empty(len(numbers) + len(counts), dtype=np.int64)
    ends = np.cumsum(counts + 1) - 1
    stream[where] = numbers
    stream[ends] = -1 - np.arange(len(counts))
    runs = find_runs(stream, int(counts.max()) // 2, shortest)
    first = ends - counts
    owner = np.searchsorted(ends, runs[:, 0])
    edge = np.zeros(len(stream) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    repeats = np.cumsum(edge)[where] > 0
    runs[:, 0] -= first[owner]
    cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
    kept = np.flatnonzero(~repeats)
    kept_words = array.take(pa.array(kept)).to_pylist()
    kept_cuts = np.searchsorted(kept, words.first)
    return [(int(n), runs[cuts[i]:cuts[i + 1]], " ".join(kept_words[kept_cuts[i]:kept_cuts[i + 1]])) for i, n in enumerate(counts)]


def _runs(shortest: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = W.plain_strings(batch.column("text"))
            for at, n in W.pieces(texts):
                found = text_runs(texts.slice(at, n), shortest)
                runs = [[{"start": s, "length": m, "period": q} for s, m, q in r.tolist()] for _, r, _ in found]
                columns = [batch.column("doc_id").slice(at, n), pa.array([f[0] for f in found], pa.int64()), pa.array(runs, kind), pa.array([f[2] for f in found], pa.string())]
                yield pa.record_batch(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start and period) and collapsed (the words
    that no run repeats, joined by one space) of every row. One scan, no shuffle."""
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return base.mapInArrow(_runs(shortest), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")
