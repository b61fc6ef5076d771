"""Labelled sentences and contrast pairs, from any table or file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.csv_tables import read_csv

TEXT_AND_LABEL = "text string, label string"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (text, label)."""
    return read_csv(spark, path, TEXT_AND_LABEL)


def contrast_sentences(pairs: DataFrame) -> DataFrame:
    """(pair_id, unanticipated, expected) to one row per text with its side and truth."""
    def side(n: int, truth: str):
        return F.struct(
            F.lit(n).alias("side"), F.col(truth).alias("text"), F.lit(truth).alias("truth")
        )

    return pairs.select(
        "pair_id", F.inline(F.array(side(0, "unanticipated"), side(1, "expected_risk")))
    )
