"""Writes to keyed tables as whole-table expressions: each takes the table and a batch and returns the table after it.

The result is written as a new version (``sources.warehouse.publish``) or overwritten by partition, so a reader never sees half a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns))


def replace(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or replace: a key's row is the batch's last row by order if it has one."""
    return table.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(_last(batch, keys, order))


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """On conflict update: as ``replace``, but columns that are NULL in the batch's row keep the table's value."""
    new = _last(batch, keys, order)
    both = table.alias("t").join(new.alias("n"), list(keys), "full")
    return both.select(*(F.col(c) if c in keys else F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) for c in table.columns))


def soft_delete(table: DataFrame, gone: DataFrame, keys: Sequence[str], at: Column, column: str = "removed_at") -> DataFrame:
    """Marks the keys of gone as removed, where they aren't yet."""
    marked = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    rows = table.join(marked, list(keys), "left")
    return rows.withColumn(column, F.when(F.col("_gone") & F.col(column).isNull(), at).otherwise(F.col(column))).drop("_gone")


def revive(table: DataFrame, back: DataFrame, keys: Sequence[str], column: str = "removed_at") -> DataFrame:
    marked = back.select(*keys).distinct().withColumn("_back", F.lit(True))
    rows = table.join(marked, list(keys), "left")
    return rows.withColumn(column, F.when(F.col("_back"), F.lit(None)).otherwise(F.col(column))).drop("_back")


def without_duplicates(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch that are new: the first of their key in the batch, and not in the table."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_n", first).where("_n = 1").drop("_n").join(table.select(*keys).distinct(), list(keys), "left_anti")


def content_hash(*columns: str) -> Column:
    """sha256 of name=value pairs in the order of the names; a missing value differs from an empty text."""
    parts = [F.concat(F.lit(c + "="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string")), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws(";", *parts), 256)


def ingest(log: DataFrame, requests: DataFrame, key: str, hashed: str) -> DataFrame:
    """Requests with what is to be done: NEW, REPLAY (the same input succeeded before), RESUME (it failed) or CONFLICT (other input under the key)."""
    known = log.select(key, F.col(hashed).alias("_hash"), F.col("state").alias("_state"))
    rows = requests.join(known, key, "left")
    action = F.when(F.col("_hash").isNull(), "NEW").when(F.col("_hash") != F.col(hashed), "CONFLICT").when(F.col("_state") == "SUCCEEDED", "REPLAY").otherwise("RESUME")
    return rows.withColumn("action", action).drop("_hash", "_state")
