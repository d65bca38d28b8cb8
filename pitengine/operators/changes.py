"""Changes between consecutive snapshots of a key, and append-only ledgers of what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitengine.functions.text import digest_key


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds previous (a struct of the columns of the key's row before) and is_first."""
    own = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*columns)).over(own)
    return rows.withColumn("previous", before).withColumn("is_first", F.col("previous").isNull())


def describe_change(old: Column, new: Column) -> Column:
    """NO_INFORMATION, BECAME_OBSERVABLE, BECAME_UNOBSERVABLE, UNCHANGED, INCREASED or DECREASED."""
    return (
        F.when(old.isNull() & new.isNull(), "NO_INFORMATION")
        .when(old.isNull(), "BECAME_OBSERVABLE")
        .when(new.isNull(), "BECAME_UNOBSERVABLE")
        .when(new == old, "UNCHANGED")
        .when(new > old, "INCREASED")
        .otherwise("DECREASED")
    )


def transitions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], field: str) -> DataFrame:
    """Rows whose field differs from the key's row before, with old and new; the first row is a discovery (old NULL)."""
    seen = with_previous(rows, keys, order, [field])
    old = F.col(f"previous.{field}")
    return seen.where(F.col("is_first") | ~old.eqNullSafe(F.col(field))).select(*keys, *order, old.alias("old"), F.col(field).alias("new"), F.when(F.col("is_first"), "DISCOVERED").otherwise("CHANGED").alias("kind"))


def alerts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], field: str, kind: str) -> DataFrame:
    """One alert per key and new value, the first: going back to a value that was reported is no news."""
    changed = transitions(rows, keys, order, field).where(F.col("kind") == "CHANGED")
    alert = digest_key(F.lit(kind), *(F.col(k) for k in keys), F.col("new"))
    first = changed.withColumn("alert_key", alert).groupBy("alert_key").agg(F.min(F.struct(*order, *keys, "old", "new")).alias("_first"))
    return first.select("alert_key", F.lit(kind).alias("kind"), "_first.*")


def append_new(ledger: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose keys the ledger doesn't hold, the first of each by order: what an idempotent append writes."""
    fresh = rows.join(ledger.select(*keys).distinct(), list(keys), "left_anti")
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rows.columns if c not in (*keys, *order)))).alias("_row"))
    return first.select(*keys, "_row.*")


def merge_observations(rows: DataFrame, key: str, seen: str, winner: Sequence[str]) -> DataFrame:
    """One row per key: first and last time seen, how often, and the columns of the row that is smallest by winner."""
    others = [c for c in rows.columns if c not in (key, *winner)]
    merged = rows.groupBy(key).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count("*").alias("seen_count"), F.min(F.struct(*winner, *others)).alias("_row"))
    return merged.select(key, "first_seen", "last_seen", "seen_count", *(F.col(f"_row.{c}").alias(c) for c in (*winner, *others) if c != seen))


def conflicts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose claims hold more than one value; the claims themselves stay."""
    return rows.groupBy(*keys).agg(F.count("*").alias("claims"), F.count_distinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).where("n_values > 1")


def new_in_latest(rows: DataFrame, batch: str, key: str) -> DataFrame:
    """Keys of the latest batch that no earlier batch holds; a single batch has none."""
    spans = rows.groupBy(key).agg(F.min(batch).alias("first_batch"))
    limits = rows.agg(F.max(batch).alias("latest"), F.min(batch).alias("earliest"))  # one row
    return spans.crossJoin(F.broadcast(limits)).where("first_batch = latest AND latest > earliest").select(key, "first_batch")
