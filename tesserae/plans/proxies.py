"""The star-schema tables in the shape of the engine's entities.

Patients are customers with an order, slides their orders, classes the market segments; votes
use the order priority, of which one value is left out of the dictionary on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The class dictionary, and a vote dictionary that lacks '5-LOW'.
CLASSES = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}
VOTES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3}

SLIDES_SQL = """slides AS (
  SELECT o_orderkey AS slide_id, o_custkey AS case_id, c_mktsegment AS label, c_nationkey % 2 AS sex, o_orderpriority AS vote,
         o_orderstatus AS status, c_nationkey AS site
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
CLASSES_SQL = "classes(label, label_id) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in CLASSES.items()) + ")"
VOTES_SQL = "votes(vote, vote_id) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in VOTES.items()) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("slide_id"),
        F.col("o_custkey").alias("case_id"),
        F.col("c_mktsegment").alias("label"),
        (F.col("c_nationkey") % 2).alias("sex"),
        F.col("o_orderpriority").alias("vote"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_nationkey").alias("site"),
    )
