"""Queries that run as streams over all events there are, and queries that write and read sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.session import new_path
from pitengine.sources import warehouse
from pitengine.sources.tables import engagements, table
from pitengine.streaming import streams as S
from pitengine.streaming import tracked


def stream_transitions(spark: SparkSession, d: str) -> DataFrame:
    return S.run_to_table(S.transitions(S.event_stream(spark, f"{d}/events[.]parquet")), name="stream_transitions")


STREAM_TRANSITIONS = "SELECT user_id AS key, event_id AS seq, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS DISTINCT FROM event_type"


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return S.run_to_table(S.first_of_each(S.event_stream(spark, f"{d}/events[.]parquet")), name="stream_dedup")


STREAM_DEDUP = "SELECT DISTINCT user_id, event_type, floor(value / 10)::bigint AS bucket FROM events"


def stream_minute_windows(spark: SparkSession, d: str) -> DataFrame:
    out = S.run_to_table(S.window_counts(S.event_stream(spark, f"{d}/events[.]parquet")), "complete", "stream_windows")
    return out.select("start", "event_type", "n", F.round("value", 4).alias("value"))


STREAM_MINUTE_WINDOWS = "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::bigint AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"


def stream_tracked(spark: SparkSession, d: str) -> DataFrame:
    """Keys registered, compared from snapshot to snapshot and expired after two silent days, as a stream with timers."""
    before = spark.conf.get(tracked.STORE, None)
    spark.conf.set(tracked.STORE, tracked.PROVIDER)
    try:
        out = S.run_to_table(tracked.tracked_changes(S.event_stream(spark, f"{d}/events[.]parquet")), name="stream_tracked")
    finally:
        spark.conf.set(tracked.STORE, before) if before else spark.conf.unset(tracked.STORE)
    return out.withColumn("moved", F.round("moved", 2))


STREAM_TRACKED = f"""
WITH e AS (SELECT user_id AS key, floor(epoch(ts))::bigint AS "at", event_id AS seq, event_type AS status, round(value, 2) AS price FROM events),
w AS (SELECT *, lag("at") OVER p AS pat, lag(status) OVER p AS ps, lag(price) OVER p AS pp, lead("at") OVER p AS nat FROM e WINDOW p AS (PARTITION BY key ORDER BY "at", seq)),
n AS (SELECT epoch(max(ts)) - 3600 AS mark FROM events)
SELECT key, "at", 'REGISTERED' AS change, NULL AS old, status AS new, NULL::double AS moved FROM w WHERE pat IS NULL OR "at" > pat + {tracked.TTL_SECONDS}
UNION ALL SELECT key, "at", 'STATUS', ps, status, NULL FROM w WHERE "at" <= pat + {tracked.TTL_SECONDS} AND status <> ps
UNION ALL SELECT key, "at", 'PRICE', NULL, NULL, round(price - pp, 2) FROM w WHERE "at" <= pat + {tracked.TTL_SECONDS} AND price <> pp
UNION ALL SELECT key, "at" + {tracked.TTL_SECONDS}, 'EXPIRED', status, NULL, NULL FROM w, n WHERE nat > "at" + {tracked.TTL_SECONDS} OR (nat IS NULL AND "at" + {tracked.TTL_SECONDS} + 1 <= mark)
"""


def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written by status as compressed Parquet, read back and counted; the status filter prunes folders."""
    table(spark, d, "orders").createOrReplaceTempView("roundtrip_orders")
    path = new_path(spark, "orders_by_status")
    warehouse.Warehouse(spark).export_parquet("SELECT * FROM roundtrip_orders", path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


PARQUET_ROUNDTRIP = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as a partner's CSV file with a personal column, imported again without it."""
    path = new_path(spark, "customers_csv")
    table(spark, d, "customer").select(F.col("c_custkey").alias("Customer Key"), F.concat("c_name", F.lit("@example.com")).alias("buyer_email"), F.col("c_acctbal").alias("Gross"), F.col("c_mktsegment").alias("Tour Name")).write.option("header", True).csv(path)
    return warehouse.import_partner(warehouse.read_any(spark, path, "csv"), {"customer_key": "long", "ticket_gross_total": "double", "tour_name": "string", "capacity": "int"})


CSV_ROUNDTRIP = "SELECT c_custkey AS customer_key, c_acctbal AS ticket_gross_total, c_mktsegment AS tour_name, NULL::int AS capacity FROM customer"


def snapshot_publish(spark: SparkSession, d: str) -> DataFrame:
    """A read model published as a version, and the newest complete version read."""
    folder = new_path(spark, "published")
    model = engagements(spark, d).groupBy("market").agg(F.count("*").alias("n"), F.round(F.sum("gross"), 2).alias("gross"))
    model = model.withColumn("note", F.lit("not for readers"))
    for version in ("8", "9", "10", "11"):  # three stay, and 11 is newer than 9
        warehouse.publish(model.where("n < 0") if version != "11" else model, folder, version, drop=["note"])
    return warehouse.latest_version(spark, folder)


def mart_description(spark: SparkSession, d: str) -> DataFrame:
    """The columns of orders with their types, rows and known values."""
    out = warehouse.describe(table(spark, d, "orders"))
    return out.select("column", F.regexp_replace("type", "timestamp_ntz", "timestamp").alias("type"), "rows", "known")


MART_DESCRIPTION = "WITH c AS (SELECT count(*) AS n FROM orders) " + " UNION ALL ".join(f"SELECT '{c}' AS column, '{t}' AS type, n AS rows, (SELECT count({c}) FROM orders) AS known FROM c" for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")))

SNAPSHOT_PUBLISH = "SELECT c_nationkey AS market, count(*) AS n, round(sum(o_totalprice), 2) AS gross FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"

QUERIES = {name: (run, globals().get(name.upper())) for name, run in list(globals().items()) if callable(run) and getattr(run, "__module__", "") == __name__ and not name.startswith("_")}
