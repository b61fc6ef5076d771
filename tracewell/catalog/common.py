"""Pieces several query modules use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as text, so results do not depend on a client's time zone."""
    return df.select(
        *[
            F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
