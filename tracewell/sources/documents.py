"""Documents read as cases with one note each, and word lists that occur in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import fixed_values as fixed
from tracewell.operators.notes import WordLists
from tracewell.session import table

SOURCE = "documents"
LISTS = WordLists(
    errors=["thatin", "ononst", "inoran", "hehely", "orantion", "verbe", "eaux"],
    harms=["ering", "edon", "tionth", "schl", "mentre", "cion", "emergent"],
    cues=[*fixed.NEGATION_CUES, "nicht", "pas ", "sin "],
)
UNANTICIPATED = ["not the", "thatin the", "thatin", "ononst", "nicht", "ne pas", "eaux", "wrong "]
EXPECTED = ["the", "tion", "der ", "leaux", "planned", "que"]


def document_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text").select(
        F.lit(SOURCE).alias("source"),
        F.col("doc_id").cast("string").alias("case_id"),
        F.lit(0).cast("bigint").alias("case_ordinal"),
        F.col("doc_id").cast("string").alias("event_id"),
        F.lit("note").alias("event_type"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.lit("Progress Note").alias("value"),
        F.col("text").alias("details"),
    )


def document_cases(spark: SparkSession, folder: str) -> DataFrame:
    """One case per document; the label is known for documents in `labels` only."""
    marks = table(spark, folder, "labels").select("doc_id", (F.col("toxic") == 1).alias("label"))
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.col("source").alias("scenario"))
        .join(marks, "doc_id", "left")
        .select(
            F.lit(SOURCE).alias("source"), F.col("doc_id").cast("string").alias("case_id"),
            "label", "scenario",
        )
    )


def labelled_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as labelled texts: the speaker decides the class."""
    role = F.col("role")
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
            "text_id"
        ),
        "conv_id",
        "turn",
        "text",
        F.when(role == "user", "unanticipated")
        .when(role == "assistant", "expected_risk")
        .otherwise("neutral")
        .alias("label"),
    )
