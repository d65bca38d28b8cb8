"""Structured Streaming forms of the change operators; each gives what its batch form gives over the same rows.

Streams read a folder of Parquet files, keep their state and offsets in the shared folder, and write tables that a
later run continues: a batch that is run again overwrites its own output, so results count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.session import new_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The events as a stream; Parquet times without a zone become timestamps, which watermarks need.

    path is a pattern, which may name a single file as well as a folder.
    """
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over all that is there now and returns the table it wrote.

    Each batch overwrites the folder of its own number; with mode complete only the last one counts.
    """
    spark = stream.sparkSession
    folder = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table").select(*stream.columns)


def transitions(events: DataFrame, on_change: Callable | None = None) -> DataFrame:
    """Status changes of each user against the status before, kept as state between batches."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        old = state.get[0] if state.exists else None
        out = []
        for seq, status in zip(rows["event_id"], rows["event_type"]):
            if status != old:
                out.append((key[0], seq, old, status))
                old = status
        state.update((old,))
        yield pd.DataFrame(out, columns=["key", "seq", "old", "new"])

    return events.groupBy("user_id").applyInPandasWithState(follow, "key long, seq long, old string, new string", "status string", "append", "NoTimeout")


def first_of_each(events: DataFrame) -> DataFrame:
    """Each (user, type, value bucket) once; without a watermark the state keeps all keys, as the ledger does."""
    return events.select("user_id", "event_type", F.floor(F.col("value") / 10).alias("bucket")).dropDuplicates(["user_id", "event_type", "bucket"])


def window_counts(events: DataFrame, length: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Events and value per type and window."""
    w = F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "value")
