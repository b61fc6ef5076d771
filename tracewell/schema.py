"""The canonical tables."""

from pyspark.sql import types as T

KEY = ["source", "case_id"]

EVENT_TYPES = ["lab", "medication", "transfer", "procedure", "admission", "note"]


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


CASES = _struct(
    ("source", T.StringType(), False),
    ("case_id", T.StringType(), False),
    ("source_ordinal", T.LongType(), True),
    ("age", T.IntegerType(), True),
    ("gender", T.StringType(), True),
    ("label", T.BooleanType(), True),
    ("label_source", T.StringType(), True),
    ("scenario", T.StringType(), True),
    ("discharged_at", T.TimestampType(), True),
)

EVENTS = _struct(
    ("source", T.StringType(), False),
    ("case_id", T.StringType(), False),
    ("case_ordinal", T.LongType(), False),
    ("event_id", T.StringType(), True),
    ("event_type", T.StringType(), False),
    ("ts", T.TimestampType(), False),
    ("value", T.StringType(), True),
    ("details", T.StringType(), True),
)

SCORES = _struct(
    ("run_id", T.StringType(), False),
    ("source", T.StringType(), False),
    ("case_id", T.StringType(), False),
    ("model_type", T.StringType(), True),
    ("model_version", T.StringType(), True),
    ("score", T.DoubleType(), True),
    ("scored_at", T.TimestampType(), True),
)

CONTRIBUTIONS = _struct(
    ("run_id", T.StringType(), False),
    ("source", T.StringType(), False),
    ("case_id", T.StringType(), False),
    ("feature", T.StringType(), False),
    ("value", T.DoubleType(), True),
    ("weight", T.DoubleType(), True),
    ("contribution", T.DoubleType(), True),
)

REVIEWS = _struct(
    ("source", T.StringType(), False),
    ("case_id", T.StringType(), False),
    ("reviewer", T.StringType(), True),
    ("decision", T.StringType(), False),
    ("notes", T.StringType(), True),
    ("reviewed_at", T.TimestampType(), True),
)

# Counts per bucket of cases; `version` names the parts they were made from.
COVERAGE = _struct(
    ("source", T.StringType(), False),
    ("bucket", T.IntegerType(), False),
    ("version", T.StringType(), False),
    ("trigger", T.StringType(), False),
    ("total", T.LongType(), False),
    ("labelled", T.LongType(), False),
    ("positives", T.LongType(), False),
    ("cases", T.LongType(), False),
    ("known", T.LongType(), False),
    ("hits", T.LongType(), False),
)
