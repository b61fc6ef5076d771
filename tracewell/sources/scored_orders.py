"""Orders read as scored, partly labelled cases: many ties, some labels unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import table


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.lit("orders").alias("source"),
        F.col("o_orderkey").cast("string").alias("case_id"),
        (F.floor(F.col("o_totalprice") / 1000) / 600.0).alias("score"),
        F.when(status != "P", status == "F").alias("label"),
        F.col("o_orderpriority").alias("scenario"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate").cast("timestamp")).alias(
            "discharged_at"
        ),
    )


SCORED_SQL = """
scored AS (
  SELECT 'orders' AS source, o_orderkey::VARCHAR AS case_id,
         floor(o_totalprice / 1000) / 600.0::DOUBLE AS score,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS label,
         o_orderpriority AS scenario,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS discharged_at
  FROM orders)
"""
