"""Queries that write batches to keyed tables and show the tables after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.functions.geo_time import minute_bucket
from pitengine.operators import writes as W
from pitengine.sources.tables import SNAPSHOTS_SQL as SNAP
from pitengine.sources.tables import snapshots, table

CUT = "2024-01-15"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ledger before and after a day, with the price of errors missing."""
    s = snapshots(spark, d).withColumn("price", F.when(F.col("status") != "error", F.col("price"))).select("key", "level", "seen_at", "seq", "status", "price")
    return W._last(s.where(F.col("seen_at") < CUT), ["key", "level"], ["seen_at", "seq"]), s.where(F.col("seen_at") >= CUT)


_halves_sql = SNAP + f""",
s AS (SELECT key, level, seen_at, seq, status, CASE WHEN status <> 'error' THEN price END AS price FROM snap),
l AS (SELECT *, row_number() OVER (PARTITION BY key, level, seen_at < '{CUT}' ORDER BY seen_at DESC, seq DESC) AS k, row_number() OVER (PARTITION BY key, level, seen_at < '{CUT}' ORDER BY seen_at, seq) AS f FROM s),
old AS (SELECT * FROM l WHERE k = 1 AND seen_at < '{CUT}'), new AS (SELECT * FROM l WHERE k = 1 AND seen_at >= '{CUT}')
"""


def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each key and level after a batch replaced those it has."""
    old, batch = _halves(spark, d)
    return W.replace(old, batch, ["key", "level"], ["seen_at", "seq"]).select("key", "level", "seq", "status", "price")


REPLACE_BY_KEY = _halves_sql + "SELECT key, level, seq, status, price FROM new UNION ALL SELECT key, level, seq, status, price FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.key = old.key AND new.level = old.level)"


def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The same, but a missing price keeps the price before."""
    old, batch = _halves(spark, d)
    return W.upsert(old, batch, ["key", "level"], ["seen_at", "seq"]).select("key", "level", "seq", "status", "price")


UPSERT_BY_KEY = _halves_sql + "SELECT coalesce(new.key, old.key) AS key, coalesce(new.level, old.level) AS level, coalesce(new.seq, old.seq) AS seq, coalesce(new.status, old.status) AS status, coalesce(new.price, old.price) AS price FROM old FULL JOIN new ON new.key = old.key AND new.level = old.level"


def watchlist(spark: SparkSession, d: str) -> DataFrame:
    """Keys on a watchlist: removed by errors of a first half, revived by signups of the second."""
    s = snapshots(spark, d)
    items = s.groupBy("key").agg(F.min("seen_at").alias("added_at")).withColumn("removed_at", F.lit(None).cast("timestamp"))
    gone = s.where((F.col("seen_at") < CUT) & (F.col("status") == "error") & (F.col("price") > 45))
    back = s.where((F.col("seen_at") >= CUT) & (F.col("status") == "signup") & (F.col("price") > 80))
    out = W.revive(W.soft_delete(items, gone, ["key"], F.lit("2024-01-16").cast("timestamp")), back, ["key"])
    return out.select("key", F.col("removed_at").isNull().alias("active"), F.unix_micros("added_at").alias("added_at"))


WATCHLIST = SNAP + f"SELECT key, NOT bool_or(seen_at < '{CUT}' AND status = 'error' AND price > 45) OR bool_or(seen_at >= '{CUT}' AND status = 'signup' AND price > 80) AS active, epoch_us(min(seen_at)) AS added_at FROM snap GROUP BY key"


def duplicate_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of a second half whose key, status and minute are new."""
    s = snapshots(spark, d).withColumn("bucket", minute_bucket(F.col("seen_at"))).withColumn("bucket", F.substring("bucket", 9, 5))
    new = W.without_duplicates(s.where(F.col("seen_at") < CUT), s.where(F.col("seen_at") >= CUT), ["key", "status", "bucket"], ["seen_at", "seq"])
    return new.select("key", "status", "bucket", "seq")


DUPLICATE_SNAPSHOTS = SNAP + f", b AS (SELECT *, strftime(seen_at, '%d') || 'T' || strftime(seen_at, '%H') AS bucket FROM snap) SELECT key, status, bucket, seq FROM (SELECT *, row_number() OVER (PARTITION BY key, status, bucket ORDER BY seen_at, seq) AS n FROM b x WHERE seen_at >= '{CUT}' AND NOT EXISTS (SELECT 1 FROM b y WHERE y.seen_at < '{CUT}' AND y.key = x.key AND y.status = x.status AND y.bucket = x.bucket)) WHERE n = 1"


def ingestion_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests against a log of earlier ones: what is new, replayed, resumed or in conflict."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), "o_custkey", "o_orderstatus", "o_totalprice")
    hashed = o.withColumn("hash", W.content_hash("o_custkey", "o_orderstatus"))
    log = hashed.where("request % 3 > 0").select("request", F.when(F.col("request") % 3 == 1, F.col("hash")).otherwise(F.sha2(F.col("request").cast("string"), 256)).alias("hash"), F.when(F.col("request") % 2 == 0, "SUCCEEDED").otherwise("FAILED").alias("state"))
    return W.ingest(log, hashed, "request", "hash").groupBy("o_orderstatus", "action").agg(F.count("*").alias("n"), F.min("hash").alias("least_hash"))


INGESTION_LOG = """
WITH h AS (SELECT o_orderkey AS r, o_orderstatus, sha256('o_custkey=' || coalesce('''' || o_custkey, 'null') || ';o_orderstatus=' || coalesce('''' || o_orderstatus, 'null')) AS hash FROM orders)
SELECT o_orderstatus, CASE WHEN r % 3 = 0 THEN 'NEW' WHEN r % 3 = 2 THEN 'CONFLICT' WHEN r % 2 = 0 THEN 'REPLAY' ELSE 'RESUME' END AS action, count(*) AS n, min(hash) AS least_hash FROM h GROUP BY ALL
"""


def promoted(spark: SparkSession, d: str) -> DataFrame:
    """Customers matched by the digits of a supplier's name are promoted once, with the supplier's id as external id; known ones stay."""
    sup = table(spark, d, "supplier").select(F.substring("s_name", -6, 6).alias("tail"), F.col("s_suppkey").alias("external"))
    cus = table(spark, d, "customer").select("c_custkey", F.substring("c_name", -6, 6).alias("tail"))
    master = cus.where("c_custkey % 10 = 0").select("c_custkey", F.lit(None).cast("long").alias("external"), F.lit("KNOWN").alias("origin"))
    found = cus.join(sup, "tail").select("c_custkey", "external", F.lit("PROMOTED").alias("origin"))
    return W.without_duplicates(master, found, ["c_custkey"], ["external"]).unionByName(W.upsert(master, found.withColumn("origin", F.lit("KNOWN")).join(master.select("c_custkey"), "c_custkey", "left_semi"), ["c_custkey"], ["external"]))


PROMOTED = """
WITH f AS (SELECT c_custkey, s_suppkey AS external FROM customer JOIN supplier ON s_name[-6:] = c_name[-6:])
SELECT c_custkey, external, 'PROMOTED' AS origin FROM f WHERE c_custkey % 10 <> 0 UNION ALL SELECT c.c_custkey, f.external, 'KNOWN' FROM customer c LEFT JOIN f ON f.c_custkey = c.c_custkey WHERE c.c_custkey % 10 = 0
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
