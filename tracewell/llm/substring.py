"""Substring dedup: remove passages that occur earlier in the corpus.

Suffix automata of shards of the corpus's own passages decide which runs of words occurred before;
equal passages are known by their words and need none. The repeated text of a corpus grows with the corpus, so the automata are not
broadcast: each shard is the text around one seed, lives in one task, and the
documents' passages are streamed through it in corpus order.

1. Seeds. Every window of `window` words picks the smallest hash among its runs of
   `SEED` words. Equal windows pick equal seeds, so a window can only repeat where
   its seed does. Neighbouring windows mostly share a seed; such a run is a passage.
2. Seeds that occur once drop out (one count per seed, one join back).
3. Passages with repeated seeds go to the shard of their seed. Equal passages of one
   batch are settled before the shuffle. A seed that very many passages share is split
   by the whole window, which loses nothing, as only equal windows need to meet.
4. Each shard adds its passages to a suffix automaton in order of (document, start).
   A window is a repeat where the matching statistic reaches the window's length.
5. Each document drops the words that repeated windows cover.

Results are judged on the input, not on what is left of it. Defined cases: null and
empty texts have no words and stay; a null id comes after all others (beside the largest bigint); of rows with one
id, the text with the smaller hash counts as earlier, and rows equal in id and words get the
same result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W
from tracewell.llm.automaton import SuffixAutomaton
from tracewell.llm.common import LAST_ID, key_of, shuffle_partitions

WINDOW = 20
SEED = 8
# From so many passages on, a seed's passages are dealt out window by window.
CROWDED = 4096


def _lowest(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[:len(values) - width + 1], out[width - have:width - have + len(values) - width + 1])
    return out


class Passages:
    """The passages of a piece of a batch: runs of windows with one seed."""

    def __init__(self, texts: pa.Array, window: int, seed: int):
        self.words = words = W.split(texts)
        hashed = W.hashes(words)
        empty = np.zeros(0, dtype=np.int64)
        self.start, self.stop, self.seed, self.row, self.within = empty, empty, empty.astype(np.uint64), empty, empty.astype(np.uint64)
        n = len(hashed) - window + 1
        if n <= 0:
            return
        rows = words.row
        seeds = W.shingles(hashed, seed)
        lowest = _lowest(seeds, window - seed + 1, np.minimum)
        valid = rows[:n] == rows[window - 1:]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (lowest[1:] != lowest[:-1]) | ~valid[:-1] | (rows[1:n] != rows[:n - 1])
        begin = np.flatnonzero(fresh & valid)
        # a passage ends before the next one, or where its text has no window left
        after = np.append(begin[1:], n)
        last = words.first[rows[begin] + 1] - window + 1
        self.start, self.stop = begin, np.minimum(after, last)
        self.seed, self.row = lowest[begin], rows[begin]
        # seeds that stand twice close together, as in periodic text
        top = _lowest(np.concatenate([np.zeros(window - seed, np.uint64), np.where(valid, lowest, 0), np.zeros(window - seed, np.uint64)]), window - seed + 1, np.maximum)
        chosen = np.flatnonzero(seeds == top[:len(seeds)])
        near = (seeds[chosen][1:] == seeds[chosen][:-1]) & (np.diff(chosen) <= window)
        self.within = seeds[chosen][1:][near]


def _count_seeds(window: int, seed: int):
    def run(batches):
        for batch in batches:
            found = []
            texts = W.plain_strings(batch.column("text"))
            for at, n in W.pieces(texts):
                p = Passages(texts.slice(at, n), window, seed)
                found += [p.seed, p.within]
            if found:
                value, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([value.view(np.int64), count.astype(np.int64)], ["seed", "n"])

    return run


def _list_seeds(window: int, seed: int):
    def run(batches):
        for batch in batches:
            keys, tids = batch.column("key").to_numpy(), batch.column("tid").to_numpy()
            texts = W.plain_strings(batch.column("text"))
            for at, n in W.pieces(texts):
                p = Passages(texts.slice(at, n), window, seed)
                pair = np.unique(np.rec.fromarrays([p.row, p.seed]))
                row = at + pair["f0"]
                yield pa.record_batch([pair["f1"].view(np.int64), keys[row], tids[row]], ["seed", "key", "tid"])

    return run


def _member(row_a, value_a, row_b, value_b) -> np.ndarray:
    """Which pairs (row, value) of a are among those of b."""
    if not len(row_b) or not len(row_a):
        return np.zeros(len(row_a), dtype=bool)
    dtype = [("row", np.int64), ("value", np.uint64)]
    a, b = np.empty(len(row_a), dtype), np.empty(len(row_b), dtype)
    a["row"], a["value"], b["row"], b["value"] = row_a, value_a, row_b, value_b
    both = np.concatenate([b, a])
    _, where = np.unique(both, return_inverse=True)
    known = np.zeros(where.max() + 1, dtype=bool)
    known[where[:len(b)]] = True
    return known[where[len(b):]]


def _flat(column: pa.Array, name: str | None = None):
    """(row, value) of a list column, or of one field of a list of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    if name is not None:
        values = values.field(name)
    return pa.compute.list_parent_indices(column).to_numpy(), values.to_numpy(zero_copy_only=False)


PASSAGE = "shard bigint, key bigint, tid bigint, start int, windows int, text binary"


def _send_passages(window: int, seed: int):
    """Passages with repeated seeds; an equal one earlier in the batch settles the later ones."""
    names = [c.split()[0] for c in PASSAGE.split(", ")]

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            tids = batch.column("tid").to_numpy()
            texts = W.plain_strings(batch.column("text"))
            seed_row, seed_value = _flat(batch.column("seeds"), "seed")
            seed_value = seed_value.view(np.uint64)
            crowd = _flat(batch.column("seeds"), "crowded")[1].astype(bool)
            out: dict[bytes, list] = {}
            rows: list[tuple] = []
            for at, n in W.pieces(texts):
                p = Passages(texts.slice(at, n), window, seed)
                inside = (seed_row >= at) & (seed_row < at + n)
                own_row, own = seed_row[inside] - at, seed_value[inside]
                keep = _member(p.row, p.seed, own_row, own)
                crowded = _member(p.row, p.seed, own_row[crowd[inside]], own[crowd[inside]])
                data, ws, we = p.words.data.tobytes(), p.words.start, p.words.end
                first = p.words.first
                for i in np.flatnonzero(keep):
                    a, b, r = int(p.start[i]), int(p.stop[i]), int(p.row[i])
                    spans = [(j, j + 1) for j in range(a, b)] if crowded[i] else [(a, b)]
                    for s, t in spans:
                        text = b" ".join(data[ws[s]:we[t + window - 2]].split())
                        place = (int(keys[at + r]), int(tids[at + r]), s - int(first[r]), t - s)
                        out.setdefault(text, []).append(place + (int(p.seed[i].view(np.int64)), bool(crowded[i])))
            for text, places in out.items():
                places.sort()
                k, t, s, w, shard, split = places[0]
                if split:
                    # only equal windows need to meet
                    shard = int(np.frombuffer(_digest(text), dtype=np.int64)[0])
                rows.append((shard, k, t, s, w, text))
                previous = places[0][:3]
                for k, t, s, w, _, _ in places[1:]:
                    # no text: known to be a repeat; the same row twice is none
                    if (k, t, s) != previous:
                        rows.append((k, k, t, s, w, None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _digest(text: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(text, digest_size=8).digest()


def _runs(flags: list[bool], offset: int, window: int):
    """Word spans covered by flagged windows."""
    a = None
    for i, flag in enumerate([*flags, False]):
        if flag and a is None:
            a = i
        elif not flag and a is not None:
            yield offset + a, offset + i - 1 + window
            a = None


def _judge(window: int):
    """Rows come sorted by shard, document and start; one automaton lives per shard."""

    def run(batches):
        shard, automaton, settled = None, None, {}
        for batch in batches:
            key, tid, a, b = [], [], [], []

            def drop(k, t, spans):
                for x, y in spans:
                    key.append(k), tid.append(t), a.append(x), b.append(y)

            columns = [batch.column(n).to_pylist() for n in ("shard", "key", "tid", "start", "windows", "text")]
            for s, k, t, start, windows, text in zip(*columns, strict=True):
                if text is None:
                    drop(k, t, [(start, start + windows - 1 + window)])
                    continue
                if s != shard:
                    shard, automaton, settled = s, SuffixAutomaton(), {}
                place = settled.setdefault(text, (k, t, start))
                if place != (k, t, start):
                    drop(k, t, [(start, start + windows - 1 + window)])
                    continue
                if (text, k, t, start) in settled:
                    drop(k, t, settled[text, k, t, start])
                    continue
                found = automaton.add(text.split())
                spans = list(_runs([x >= window for x in found[window - 1:]], start, window))
                settled[text, k, t, start] = spans
                drop(k, t, spans)
            yield pa.record_batch(
                [pa.array(key, pa.int64()), pa.array(tid, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                ["key", "tid", "a", "b"],
            )

    return run


def _keep(batches):
    """Each document without its covered words."""
    for batch in batches:
        texts = W.plain_strings(batch.column("text"))
        own = batch.column("tid").to_numpy()
        row, tid = _flat(batch.column("spans"), "tid")
        a, b = _flat(batch.column("spans"), "a")[1], _flat(batch.column("spans"), "b")[1]
        mine = tid == own[row] if len(row) else np.zeros(0, dtype=bool)
        row, a, b = row[mine], a[mine], b[mine]
        n_words, removed, kept = [], [], []
        bound = np.searchsorted(row, np.arange(len(texts) + 1))
        for i, text in enumerate(texts.to_pylist()):
            words = text.encode().split()
            x, y = bound[i], bound[i + 1]
            if x < y:
                delta = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(delta, a[x:y], 1)
                np.add.at(delta, b[x:y], -1)
                keep = (np.cumsum(delta[:-1]) == 0).tolist()
                left = [w for w, k in zip(words, keep, strict=True) if k]
            else:
                left = words
            n_words.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every row of docs."""
    parts = shuffle_partitions(docs)
    # A row is known by its id and text, so that the rows without an id are not one key. The hash tells
    # a null id from the largest one.
    said = F.xxhash64(text_column)
    tid = F.when(F.col(id_column).isNull(), F.xxhash64(text_column, F.lit(1))).otherwise(said)
    base = docs.select(key_of(id_column).alias("key"), tid.alias("tid"), F.col(text_column).alias("text"))
    # Read by two joins below, with the same columns, so that both reuse this exchange.
    dealt = base.repartition(parts, "key", "tid")
    repeated = (
        base.select("text").mapInArrow(_count_seeds(window, seed), "seed bigint, n bigint")
        .groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")
        .select("seed", (F.col("n") >= CROWDED).alias("crowded"))
    )
    listed = (
        base.mapInArrow(_list_seeds(window, seed), "seed bigint, key bigint, tid bigint")
        .join(repeated, "seed")
        .groupBy("key", "tid").agg(F.collect_set(F.struct("seed", "crowded")).alias("seeds"))
    )
    spans = (
        dealt.join(listed, ["key", "tid"]).select("key", "tid", "text", "seeds")
        .mapInArrow(_send_passages(window, seed), PASSAGE)
        .repartition(parts, "shard").sortWithinPartitions("shard", "key", "tid", "start")
        .mapInArrow(_judge(window), "key bigint, tid bigint, a int, b int")
        .groupBy("key", "tid").agg(F.collect_set(F.struct("tid", "a", "b")).alias("spans"))
    )
    return (
        dealt.join(spans, ["key", "tid"], "left")
        .select(F.when((F.col("key") != LAST_ID) | (F.col("tid") == F.xxhash64("text")), F.col("key")).alias("doc_id"), "tid", "text", "spans")
        .mapInArrow(_keep, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    )
