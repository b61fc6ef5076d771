"""Records of split files against reading each file whole."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.sources import csv_records as R
from tracewell.sources import csv_tables as C

SCHEMA = "id int, note string, n double"


@pytest.fixture
def small_splits(spark):
    """Files are cut every 64 bytes or so."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def make(rng, rows, newline="\n"):
    parts = ["a", "b c", ",", '"', '""', "\n", "\n\n", "é", "x" * 30, "\t", "1,2", '",']
    out = []
    for i in range(rows):
        note = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        out.append((i, note, i / 4))
    lines = ["id,note,n"] + [f"{i},{quoted(note)},{n}" for i, note, n in out]
    return out, newline.join(lines) + newline


def whole(spark, path, schema=SCHEMA):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


@pytest.mark.parametrize("seed", range(4))
def test_split_files_read_as_whole_ones(small_splits, tmp_path, seed):
    rng = random.Random(seed)
    for k in range(3):
        want, text = make(rng, (rng.choice([0, 1]), 1, 60)[k])
        (tmp_path / f"f{k}.csv").write_text(text, encoding="utf-8", newline="")
    got = C.read_csv(small_splits, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole(small_splits, str(tmp_path)).collect()))
    lines = R._lines(small_splits, str(tmp_path)).select(*R.RANGE).distinct().count()
    assert lines > 10


def test_values_over_many_ranges(small_splits, tmp_path):
    notes = ["one\n" * 200, 'say ""\n,' * 50, "", "plain"]
    (tmp_path / "f.csv").write_text("id,note,n\n" + "".join(f"{i},{quoted(x)},1\n" for i, x in enumerate(notes)))
    got = {r["id"]: r["note"] for r in C.read_csv(small_splits, str(tmp_path / "f.csv"), SCHEMA).collect()}
    assert got == {i: x or None for i, x in enumerate(notes)} or got == dict(enumerate(notes))
    assert {r["note"] for r in whole(small_splits, str(tmp_path / "f.csv")).collect()} == set(got.values())


def test_only_open_lines_are_joined(small_splits, tmp_path):
    """Pieces that travel between ranges are two for each range at most; other records stay where they are."""
    _, text = make(random.Random(7), 80)
    (tmp_path / "f.csv").write_text(text, encoding="utf-8")
    path = str(tmp_path / "f.csv")
    opened = R.open_ranges(R.range_quotes(small_splits, path))
    lines = R._lines(small_splits, path).join(F.broadcast(opened), R.RANGE, "left")
    pieces = lines.mapInArrow(R._stitch(True), R.PIECE)
    per_range = pieces.where(f"piece != {R.WHOLE}").groupBy(*R.RANGE).count()
    assert per_range.agg(F.max("count")).first()[0] <= 2
    assert pieces.where(f"piece = {R.BEGIN}").count() > 3 and opened.count() > 3
    plan = R.records(small_splits, path, R.range_quotes(small_splits, path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_plain_files_keep_their_splits(small_splits, tmp_path):
    (tmp_path / "f.csv").write_text("id,note,n\n" + "".join(f'{i},"a ""b""",{i}\n' for i in range(200)))
    path = str(tmp_path / "f.csv")
    got = C.read_csv(small_splits, path, SCHEMA)
    assert got.rdd.getNumPartitions() > 10 and got.count() == 200
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "g.csv").write_text("id,note,n\n" + "".join(f'{i},"a\nb",{i}\n' for i in range(200)))
    assert R._lines(small_splits, str(tmp_path / "g.csv")).rdd.getNumPartitions() > 10
    assert C.read_csv(small_splits, str(tmp_path / "g.csv"), SCHEMA).where("note = 'a\\nb'").count() == 200


def test_line_ends(small_splits, tmp_path):
    rows = [(1, "two\r\nlines", 1.0), (2, "cr\rinside", 2.0), (3, "x", 3.0)]
    text = "﻿id,note,n\r\n" + "".join(f"{i},{quoted(x)},{n}\r\n" for i, x, n in rows) + "\r\n \r\n"
    (tmp_path / "f.csv").write_bytes(text.encode())
    got = C.read_csv(small_splits, str(tmp_path / "f.csv"), SCHEMA)
    assert sorted(map(tuple, got.collect())) == rows


def test_types_are_inferred_from_all_records(small_splits, tmp_path):
    body = "".join(f'{i},"a\n{i}",{i}.5,2026-01-0{1 + i % 9} 00:00:00\n' for i in range(60)) + '9999999999,"z\n",7,\n'
    (tmp_path / "f.csv").write_text("id,note,n,charttime\n" + body)
    got = C.read_typed(small_splits, str(tmp_path / "f.csv"))
    assert dict(got.dtypes) == {"id": "bigint", "note": "string", "n": "double", "charttime": "timestamp"}
    assert got.count() == 61 and got.where("charttime IS NULL").count() == 1
    text = C.read_text_columns(small_splits, str(tmp_path / "f.csv"))
    assert set(dict(text.dtypes).values()) == {"string"} and text.where("charttime = ''").count() == 1


def test_malformed_values_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,n\n1,"x\ny",1\ntwo,"x\ny",2\n3,z,three\n4,"open,5\n')
    (tmp_path / "b.csv").write_text("id,note,n\n1,x,1\ntwo,x,2\n")
    (tmp_path / "c.csv").write_text("id,note,n\n1,x,1\n")
    paths = {f"t.{k}": str(tmp_path / f"{k}.csv") for k in "abc"}
    got = {r["table_name"]: r for r in C.load_tables(spark, paths, str(tmp_path / "out"), dict.fromkeys(paths, SCHEMA)).collect()}
    assert [(got[f"t.{k}"]["source_rows"], got[f"t.{k}"]["malformed"]) for k in "abc"] == [(4, 3), (2, 1), (1, 0)]
    assert all(r["same"] and r["source_rows"] == r["target_rows"] for r in got.values())
    kept = spark.read.parquet(str(tmp_path / "out" / "t" / "a"))
    assert kept.columns == ["id", "note", "n"] and kept.where("id IS NULL").count() == 1


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note,n\n")
    (tmp_path / "b.csv").write_text('id,note,n\n1,"x\n",2\n')
    assert C.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).count() == 0
    assert C.read_csv(spark, str(tmp_path), SCHEMA).count() == 1
