"""Reading tables, and the views of them that the named queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choices reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def engagements(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as engagements: one row each, with the clock of its start and that of its publication.

    The result of an engagement is published when its last line ships, which is after it started.
    """
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.to_date(F.max("l_shipdate")).alias("pub_date"),
        F.min("l_suppkey").alias("place"),
        F.sum("l_quantity").alias("headcount"),
        F.max(F.col("l_returnflag") == "R").alias("sold_out"),
        F.count("*").alias("shows"),
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("start_date"), F.col("o_totalprice").alias("gross"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("market"), F.col("c_mktsegment").alias("series"))
    return orders.join(lines, orders["id"] == lines["l_orderkey"], "left").drop("l_orderkey").join(customers, "entity", "left")


#: DuckDB SQL of ``engagements``, to open a WITH clause.
ENGAGEMENTS_SQL = """
WITH eng AS (
  SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate::date AS start_date, o_totalprice AS gross, o_orderstatus AS status, o_orderpriority AS priority,
         pub_date, place, headcount, sold_out, shows, c_nationkey AS market, c_mktsegment AS series
  FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate)::date AS pub_date, min(l_suppkey) AS place, sum(l_quantity) AS headcount, bool_or(l_returnflag = 'R') AS sold_out, count(*) AS shows
             FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey)
"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a snapshot ledger: per key (user) the status, price and properties seen at a time."""
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("level"))


#: DuckDB SQL of ``snapshots``, to open a WITH clause.
SNAPSHOTS_SQL = """
WITH snap AS (
  SELECT user_id AS key, ts AS seen_at, event_id AS seq, event_type AS status, value AS price, json_extract_string(props, '$.k')::int AS level FROM events)
"""
