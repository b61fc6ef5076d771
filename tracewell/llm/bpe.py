"""BPE encoding and decoding by a table of distinct words.

Byte-level BPE cuts a text into words (pre-tokens) and merges inside of a word only, so a
word's ids do not depend on where it stands.

1. Texts are split where they lie. Up to BLOCK_WORDS consecutive words are a block: one row with the ids and
   lengths of its documents, a number per word position, and its distinct words, dealt over shards by their hash. Blocks are
   dealt over partitions, and both joins below read that one exchange.
2. The words of a shard meet in one partition, from all blocks; each distinct word is encoded there once,
   and its ids go back to the blocks that asked.
3. A join on the block brings the ids of its words together with its positions, and gives every document its ids.

What is shuffled is a block's distinct words, packed, and its numbers; a word as frequent as can be is one entry of a
block, so no shard is hot. A block that is made again after an executor is lost has the same words if the input comes in the same order, as a
scan does; other inputs are written to the shared folder first, and a block whose words are not those that were asked for is an error. Decoding is a join of ids
with the table of pieces, as large as the vocabulary, by position in it; the bytes are joined per text.

The tokenizer's file is a parameter, read on the driver and broadcast (its size is checked). It must be byte-level BPE without
normalizer, with its usual pattern and plain added tokens; truncation and padding of the file are not used. Words are cut by the `regex` module where it and
the tokenizers library know the same character classes (SURE), else by the library.

Defined cases: null and empty texts have no ids and decode to an empty text; an added token in a text is that token; ids that no piece
has, and null ids, decode to nothing; bytes that are no UTF-8 become U+FFFD; a null id is an id like any other; repeated rows are treated alike; a text of any
length is a block if it is longer than one; columns other than those named are not looked at.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import words as W
from tracewell.llm.common import shuffle_partitions
from tracewell.session import materialize

BLOCK_WORDS = 1 << 20
# Distinct words a task remembers; beyond that it starts anew and may encode a word again.
REMEMBERED = 1_000_000
FILE_BYTES = 64 << 20
ROW_IDS = 1 << 18           # ids worked on at once
# Steps of a plan after which rows may come in another order when they are made again.
MOVING = ("Repartition", "RebalancePartitions", "Join", "Aggregate", "Sort", "Window", "Deduplicate", "Distinct")

# The pattern of byte-level BPE, and characters on whose classes both libraries agree.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SURE = r"[\u0000-՗ऀ-॰฀-๿Ḁ-⁰₠-₿℀-⯿　-ㄯ一-鿯가-힣︀-�\U0001F300-\U0001F64F]*"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_tokenizer(path: str) -> str:
    """The file's text, if it is a tokenizer that words can be encoded with one by one."""
    size = os.path.getsize(path)
    if size > FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {FILE_BYTES} are broadcast")
    with open(path, encoding="utf-8") as file:
        text = file.read()
    told = json.loads(text)
    cut = told.get("pre_tokenizer") or {}
    usual = told["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    decoder = told.get("decoder") or {}
    if not usual or told.get("normalizer") or decoder.get("type") != "ByteLevel":
        raise ValueError(f"{path} is not plain byte-level BPE")
    if any(t.get(k) for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that change the text around them")
    return text


class Splitter:
    """Words of a text, and their ids."""

    def __init__(self, told: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(told)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(PATTERN)
        self.sure = regex.compile(SURE)
        added = sorted((t["content"] for t in json.loads(told)["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def words(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self._cut(text)
        out: list[str] = []
        for i, part in enumerate(self.added.split(text)):
            out += [part] if i % 2 else self._cut(part)
        return out

    def _cut(self, text: str) -> list[str]:
        if self.sure.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _splitter(told: str) -> Splitter:
    return Splitter(told)


def pack(*columns) -> bytes:
    """Columns of one length as compressed bytes."""
    batch = pa.record_batch([pa.array(c) if isinstance(c, list) else c for c in columns], [str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> list[pa.Array]:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch().columns


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32: the lower and the upper halves each by themselves."""
    return pack(pa.array((numbers & 0xFFFF).astype(np.uint16)), pa.array((numbers >> 16).astype(np.uint16)))


def unpack_numbers(data: bytes) -> np.ndarray:
    low, high = unpack(data)
    return low.to_numpy().astype(np.int64) | (high.to_numpy().astype(np.int64) << 16)


def pack_lists(lengths: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    return pack_numbers(lengths), pack_numbers(values)


def pack_words(words: pa.Array) -> bytes:
    """Strings as their lengths in bytes and the bytes of all."""
    view = _as_words(words)
    return pack([pack_numbers(view.end - view.start)], [view.data.tobytes()])


def unpack_words(data: bytes) -> list[str]:
    lengths, text = (c[0].as_py() for c in unpack(data))
    edges = np.concatenate([[0], np.cumsum(unpack_numbers(lengths))]).tolist()
    return [text[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start:start + length] of every row, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


_BLOCK = pa.schema([
    ("mark", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("numbers", pa.binary()), ("places", pa.binary()),
    ("shards", pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary())]))),
])
BLOCK = "mark bigint, ids array<bigint>, sizes array<int>, numbers binary, places binary, shards array<struct<shard: int, words: binary>>"


def _block(ids: list, met: list[np.ndarray], known: dict[str, int], shards: int) -> pa.RecordBatch:
    """A block's row. Words are numbered from the most frequent on; places are their numbers in the order of the shards."""
    sizes = [len(m) for m in met]
    flat = np.concatenate(met)
    order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
    rank = np.empty(len(known), dtype=np.int32)
    rank[order] = np.arange(len(known))
    # alphabetical inside of a shard, which packs best
    words = pa.array(sorted(known), pa.string())
    number = rank[np.fromiter((known[w] for w in words.to_pylist()), np.int64, len(words))]
    shard = (W.hashes(_as_words(words)) % np.uint64(shards)).astype(np.int64)
    dealt = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[dealt], np.arange(shards + 1)).tolist()
    asked = [{"shard": s, "words": pack_words(words.take(pa.array(dealt[a:b])))} for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    numbers, places = pack_numbers(rank[flat]), pack_numbers(number[dealt])
    mark = xxhash.xxh3_64_intdigest(b"".join([numbers, places, *(a["words"] for a in asked)])) - (1 << 63)
    values = [[mark], [ids], [sizes], [numbers], [places], [asked]]
    return pa.record_batch([pa.array(v, t) for v, t in zip(values, _BLOCK.types, strict=True)], schema=_BLOCK)


def _as_words(strings: pa.Array) -> W.Words:
    """Whole strings as words, for their hashes."""
    raw = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], dtype=np.uint8) if strings.buffers()[2] else np.zeros(0, dtype=np.uint8)
    return W.Words(data[raw[0]:raw[-1]], raw[:-1] - raw[0], raw[1:] - raw[0], np.array([0, len(strings)]))


def _split(told, shards: int, block_words: int):
    def run(batches):
        splitter = _splitter(told.value)
        ids, met, count, known = [], [], 0, {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), W.plain_strings(batch.column("text")), strict=True):
                words = splitter.words(text.as_py())
                if ids and (count + len(words) > block_words or len(ids) >= block_words):
                    yield _block(ids, met, known, shards)
                    ids, met, count, known = [], [], 0, {}
                number = known.setdefault
                ids.append(doc_id)
                met.append(np.fromiter((number(w, len(known)) for w in words), np.int32, len(words)))
                count += len(words)
        if ids:
            yield _block(ids, met, known, shards)

    return run


_ASKED = "block bigint, mark bigint, shard int, words binary"
_FOUND = "block bigint, mark bigint, shard int, lengths binary, found binary"


def _ask(batches):
    """The distinct words of every block, shard by shard."""
    for batch in batches:
        for block, mark, shards in zip(*(batch.column(c).to_pylist() for c in ("block", "mark", "shards")), strict=True):
            n = len(shards)
            columns = [pa.array([block] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array([s["shard"] for s in shards], pa.int32()), pa.array([s["words"] for s in shards], pa.binary())]
            yield pa.record_batch(columns, ["block", "mark", "shard", "words"])


def _encode(told, remembered: int):
    """The ids of every row's words; each distinct word of the partition is encoded once."""
    def run(batches):
        splitter = _splitter(told.value)
        known: dict[str, int] = {}
        edges, flat, used = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 18, dtype=np.int32), 0
        for batch in batches:
            lengths_of, ids_of = [], []
            for data in batch.column("words").to_pylist():
                words = unpack_words(data)
                fresh = [w for w in words if w not in known]
                if known and len(known) + len(fresh) > remembered:
                    known.clear()
                    used, fresh = 0, words
                for at in range(0, len(fresh), 4_000):
                    some = fresh[at:at + 4_000]
                    for word, found in zip(some, splitter.encode(some), strict=True):
                        while used + len(found) > len(flat):
                            flat = np.concatenate([flat, np.zeros_like(flat)])
                        while len(known) + 2 > len(edges):
                            edges = np.concatenate([edges, np.zeros_like(edges)])
                        flat[used:used + len(found)] = found
                        used += len(found)
                        edges[len(known) + 1] = used
                        known[word] = len(known)
                row = np.fromiter((known[w] for w in words), np.int64, len(words))
                lengths = edges[row + 1] - edges[row]
                packed = pack_lists(lengths, gather(edges[row], lengths, flat))
                lengths_of.append(packed[0])
                ids_of.append(packed[1])
            columns = [*(batch.column(c) for c in ("block", "mark", "shard")), pa.array(lengths_of, pa.binary()), pa.array(ids_of, pa.binary())]
            yield pa.record_batch(columns, ["block", "mark", "shard", "lengths", "found"])

    return run


def _assemble(batches):
    """Ids of every document of a block from the ids of its words."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes, numbers, places, mark, found = (batch.column(c)[i].as_py() for c in ("ids", "sizes", "numbers", "places", "mark", "found"))
            found = found or []
            # from the order of the shards to the words' numbers
            place = unpack_numbers(places)
            lengths = np.concatenate([np.zeros(0, dtype=np.int64), *(unpack_numbers(f["lengths"]) for f in found)])
            values = np.concatenate([np.zeros(0, dtype=np.int32), *(unpack_numbers(f["found"]).astype(np.int32) for f in found)])
            if any(f["mark"] != mark for f in found) or len(lengths) != len(place):
                raise RuntimeError("the rows of a partition came in another order when they were read again; write the input to a table first")
            before = np.cumsum(lengths) - lengths
            start, length = np.empty_like(before), np.empty_like(lengths)
            start[place], length[place] = before, lengths
            position = unpack_numbers(numbers)
            edges = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
            at = 0
            while at < len(ids):
                stop = max(at + 1, int(np.searchsorted(edges, edges[at] + ROW_IDS // 2, side="right")) - 1)
                some = position[edges[at]:edges[stop]]
                flat = gather(start[some], length[some], values)
                upto = np.concatenate([[0], np.cumsum(length[some])])
                offsets = pa.array(upto[edges[at:stop + 1] - edges[at]].astype(np.int32))
                yield pa.record_batch([pa.array(ids[at:stop], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids"])
                at = stop


def settled(rows: DataFrame) -> DataFrame:
    """rows, from the shared folder if making them again could put them in another order."""
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    return materialize(rows, "settled") if any(step in plan for step in MOVING) else rows


def encode_texts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                 shards: int | None = None, block_words: int = BLOCK_WORDS, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id and ids (array<int>) of every row. `shards` should grow with the number of distinct words."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    shards = shards or shuffle_partitions(docs)
    base = settled(docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")))
    blocks = base.mapInArrow(_split(told, shards, block_words), BLOCK).withColumn("block", F.monotonically_increasing_id())
    # Read twice below, with all columns, so that both sides reuse this exchange.
    blocks = blocks.repartition(shuffle_partitions(docs), "block")
    asked = blocks.mapInArrow(_ask, _ASKED)
    found = asked.repartition(shards, "shard").mapInArrow(_encode(told, remembered), _FOUND)
    tables = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "mark", "lengths", "found"))).alias("found"))
    return blocks.join(tables, "block", "left").mapInArrow(_assemble, "doc_id bigint, ids array<int>")


def pieces(told: str) -> pa.Array:
    """The bytes of every id; null where there is none."""
    data = json.loads(told)
    to_byte = byte_characters()

    def raw(piece: str) -> bytes:
        return bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()

    table = {i: raw(piece) for piece, i in data["model"]["vocab"].items()}
    table |= {t["id"]: raw(t["content"]) for t in data["added_tokens"]}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary())


def _texts(lists: pa.Array, table: pa.Array) -> list[str]:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    known = (flat == flat) & (flat >= 0) & (flat < len(table))
    joined = table.take(pa.array(np.where(known, flat, 0).astype(np.int32), mask=~known)).fill_null(b"")
    ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset:joined.offset + len(joined) + 1]
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    edges = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
    whole = memoryview(joined.buffers()[2] or b"")
    return [bytes(whole[a:b]).decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _decode(told):
    def run(batches):
        table = _pieces(told.value)
        for batch in batches:
            lists = batch.column("ids")
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            at = 0
            while at < len(lists):
                stop = max(at + 1, int(np.searchsorted(edges, edges[at] + ROW_IDS, side="right")) - 1)
                part = batch.slice(at, stop - at)
                yield pa.record_batch([*part.columns, pa.array(_texts(part.column("ids"), table), pa.string())], [*part.schema.names, "text"])
                at = stop

    return run


@lru_cache(maxsize=2)
def _pieces(told: str) -> pa.Array:
    return pieces(told)


def decode_ids(encoded: DataFrame, tokenizer: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id, ids and text of every row. One scan, no shuffle."""
    spark: SparkSession = encoded.sparkSession
    told = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    base = encoded.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return base.mapInArrow(_decode(told), "doc_id bigint, ids array<int>, text string")
