"""Each stage on its own input against the plain version of its decision."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near_copies import near_groups
from tests.llm.test_pii import base_spans
from tracewell.llm import toxicity as T
from tracewell.llm.pii import find_spans, redact
from tracewell.llm.queries import mix_tree

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def domain(source):
    return "web" if source == "src0" else "books" if source is not None and len(source) == 4 else "reference"


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # rows without an id, a text or a source, and a repeated row
    extra = spark.createDataFrame(
        [(None, None, "en", "src1", None), (9_001, "", None, None, 0), (9_001, "", None, None, 0), (9_002, None, "en", "src0", None)], docs.schema)
    docs = docs.union(extra)
    columns, before = docs.columns, rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = stage(spark, docs, FOLDER)
        got = rows(after)
        if name == "toxicity":
            scores = T.toxicity_scores(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            bad = Counter(r.doc_id for r in scores.collect() if r.predicted)
            assert Counter(r[0] for r in got) == Counter(r[0] for r in before) - bad
            assert set(got) <= set(before) and sum(bad.values())
        elif name == "near_copies":
            groups = near_groups([r[1] for r in before])
            first = {}
            for r, g in sorted(zip(before, groups, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
                first.setdefault(g, r[0])
            assert Counter(r[0] for r in got) == Counter(first.values())
            assert set(got) <= set(before) and len(got) < len(before)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            bad = {i for i, *_ in leaks([r[:2] for r in before], items)}
            assert sorted(got, key=repr) == sorted((r for r in before if r[0] not in bad), key=repr) and bad
        elif name == "personal_data":
            want = []
            for i, text, lang, source, n in before:
                new = None if text is None else redact(text, find_spans(text))
                want.append((i, new, lang, source, n if new is None else len(new)))
            assert sorted(got, key=repr) == sorted(want, key=repr) and got != before
            assert all(s not in (r[1] or "") for r in got for o in before if o[0] == r[0] for k, a, b in base_spans(o[1]) if k == "email" for s in [o[1][a:b]])
        else:
            times = mixed([(r[0], r[1], r[2], r[3], domain(r[3])) for r in before], mix_tree(), 0.6, 2, 42)
            want = [(*r, t) for r, t in zip(before, times, strict=True) if t]
            assert after.columns == [*columns, "times"]
            assert sorted(got, key=repr) == sorted(want, key=repr)
            break
        assert after.columns == columns
        docs, before = after, got


def test_run_equals_the_stages_and_takes_empty_tables(spark, tmp_path):
    out = rows(corpus_pipeline.run(spark, FOLDER))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), FOLDER)
    assert sorted(out, key=repr) == sorted(rows(docs), key=repr)
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert rows(corpus_pipeline.run(spark, f"{tmp_path}/none")) == []
