import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.session import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Rows (case, kind, time, value, details) in the order given."""
    from pyspark.sql import functions as F

    def make(rows):
        data = [(c, i, f"e{i}", k, t, v, d) for i, (c, k, t, v, d) in enumerate(rows)]
        df = spark.createDataFrame(
            data, "case_id string, case_ordinal bigint, event_id string, event_type string, "
            "t string, value string, details string",
        )
        return df.select(
            F.lit("test").alias("source"), "case_id", "case_ordinal", "event_id", "event_type",
            F.col("t").cast("timestamp").alias("ts"), "value", "details",
        )

    return make


@pytest.fixture(scope="session")
def make_cases(spark):
    """Rows (case, label)."""
    def make(rows):
        return spark.createDataFrame(
            [("test", c, label) for c, label in rows],
            "source string, case_id string, label boolean",
        )

    return make
