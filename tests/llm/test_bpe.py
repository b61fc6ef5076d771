"""Ids and decoded texts against the tokenizers library on whole texts."""

import hashlib
import json
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracewell.llm import bpe as B
from tracewell.llm.queries import QUERIES, TOKENIZER

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def splitter():
    return B.Splitter(B.read_tokenizer(TOKENIZER))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(rng, n):
    parts = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "'", "12", "½", "é", "é", "的", "한", "🙂", "👩‍👩", "֋", "౜", "​", "\xa0", " ",
             "\x00", "\x1f", "\x85", "<|endoftext|>", "<|end", "oftext|>", "|>", "…", "�", "\U0001f9ff", "\U000107bb"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_words_encode_one_by_one(library, splitter):
    for text in odd_texts(random.Random(1), 3000):
        words = splitter.words(text)
        assert "".join(words) == text
        assert [i for found in splitter.encode(words) for i in found] == ids_of(library, text)


def test_sure_characters_have_one_class(splitter):
    """All characters that the fast pattern may cut, between letters, digits and marks."""
    for low in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000 and splitter.sure.fullmatch(chr(c))]
        text = "".join(f"a{c}1{c} !{c} {c}" for c in chars)
        assert splitter.pattern.findall(text) == [text[a:b] for _, (a, b) in splitter.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("settings", [{}, {"shards": 3, "block_words": 50}, {"shards": 1, "block_words": 7, "remembered": 20}])
def test_blocks_and_shards_change_nothing(spark, library, settings):
    texts = [None, "", "<|endoftext|>", "word " * 3000, "x" * 100_000, *odd_texts(random.Random(2), 150)]
    rows = [(None if i % 7 == 0 else i // 2, t, "clash") for i, t in enumerate(texts)] + [(3, "twice", None)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    encoded = B.encode_texts(df, TOKENIZER, **settings)
    assert encoded.columns == ["doc_id", "ids"]
    want = sorted(((i, ids_of(library, t)) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == want
    texts = sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.text) for r in B.decode_ids(encoded, TOKENIZER).collect()), key=repr) == texts
    assert B.encode_texts(df.limit(0), TOKENIZER, **settings).count() == 0


def test_each_distinct_word_is_encoded_once(monkeypatch):
    told = type("Told", (), {"value": B.read_tokenizer(TOKENIZER)})
    texts = ["one two one", "two three", "three one four"]
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    blocks = list(B._split(told, 2, 3)([batch]))
    assert sum(b.num_rows for b in blocks) == 3
    asked = [(i, 0, s["shard"], s["words"]) for i, b in enumerate(blocks) for s in b.column("shards").to_pylist()[0]]
    seen, honest = [], B.Splitter.encode
    monkeypatch.setattr(B.Splitter, "encode", lambda self, words: (seen.extend(words), honest(self, words))[1])
    columns = [pa.array(c) for c in zip(*asked, strict=True)]
    list(B._encode(told, 100)([pa.record_batch(columns, ["block", "mark", "shard", "words"])]))
    assert sorted(seen) == sorted({w for t in texts for w in B.Splitter(told.value).words(t)})


def test_one_exchange_and_settled_inputs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    encoded = B.encode_texts(docs, TOKENIZER)
    encoded.write.format("noop").mode("overwrite").save()
    assert B.settled(docs) is docs and B.settled(docs.where("doc_id > 3")) is not None
    assert "parquet" in B.settled(docs.repartition(2))._jdf.queryExecution().executedPlan().toString().lower()
    assert "Repartition" not in B.settled(docs.repartition(2))._jdf.queryExecution().optimizedPlan().toString()


def test_a_block_made_anew_with_other_words_is_an_error():
    told = type("Told", (), {"value": B.read_tokenizer(TOKENIZER)})
    batch = lambda texts: pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    first, second = (next(B._split(told, 1, 100)([batch(t)])) for t in (["one two", "three"], ["three", "one two"]))
    asked = next(B._ask([first.append_column("block", pa.array([0]))]))
    found = next(B._encode(told, 100)([asked])).to_pylist()
    join = lambda block: block.append_column("found", pa.array([found]))
    assert [r["doc_id"] for b in B._assemble([join(first)]) for r in b.to_pylist()] == [0, 1]
    with pytest.raises(RuntimeError):
        list(B._assemble([join(second)]))


def test_decoding_any_ids(spark, library):
    lists = [None, [], [50256, 50256], [None, 262], [-1, 50257, 10**9, 11], [447], [447, 247, 220], [0, 255, 50255]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id bigint, ids array<int>").selectExpr("*", "'clash' AS text")
    got = {r.doc_id: r.text for r in B.decode_ids(df, TOKENIZER).collect()}
    for i, ids in enumerate(lists):
        known = [x for x in ids or [] if x is not None and 0 <= x < 50257]
        assert got[i] == library.decode(known, skip_special_tokens=False)


def test_other_tokenizers_are_refused(tmp_path):
    told = json.loads(B.read_tokenizer(TOKENIZER))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}},
                   {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(told | change))
        with pytest.raises(ValueError):
            B.read_tokenizer(str(path))


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe_round_trip"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
