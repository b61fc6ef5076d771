"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SOME = ["trigger_features", "trigger_coverage", "trigger_evidence", "gain_curve", "ranking_quality",
        "note_lexicon_features", "hospital_events", "admission_transfers", "readmission_gaps",
        "linear_contributions", "counterfactual_injected", "store_append_unseen", "review_queue"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 14 and "lift" in df.columns


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    pick = lambda rows, cols: sorted(repr(tuple(r[cols.index(n)] for n in order)) for r in rows)
    assert pick(df.collect(), df.columns) == pick(cursor.fetchall(), names)
