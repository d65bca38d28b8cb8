"""Marts that are kept up by what was appended: stored partial states, merged with the new files' partial states.

A mart's table holds, per key, states that merge (rows, sums, counts of known values, least, greatest), not the final figures; a refresh aggregates
only files it has not consumed, merges the two small tables and publishes the result as a new version. The list of consumed files is
written for the version before its pointer moves, so a refresh that dies halfway is simply run again: a file counts once. Every run is
logged, with its error if it fails.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.sources import warehouse

RUN = "run_id string, version string, status string, files int, rows_read long, rows_written long, started double, finished double, error string"


@dataclass(frozen=True)
class Mart:
    """keys to group by; measures that are summed (with means) and of which the least and greatest are kept."""

    folder: str
    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()
    ranges: tuple[str, ...] = ()

    def partial(self, rows: DataFrame) -> DataFrame:
        known = [x for c in self.sums for x in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"known_{c}"))]
        ends = [x for c in self.ranges for x in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))]
        return rows.groupBy(*self.keys).agg(F.count("*").alias("n"), *known, *ends)

    def merged(self, states: DataFrame) -> DataFrame:
        added = [F.sum(c).alias(c) for c in ("n", *(f"{p}_{c}" for c in self.sums for p in ("sum", "known")))]
        ends = [x for c in self.ranges for x in (F.min(f"low_{c}").alias(f"low_{c}"), F.max(f"high_{c}").alias(f"high_{c}"))]
        return states.groupBy(*self.keys).agg(*added, *ends)

    def figures(self, state: DataFrame) -> DataFrame:
        means = [(F.col(f"sum_{c}") / F.nullif(F.col(f"known_{c}"), F.lit(0))).alias(f"mean_{c}") for c in self.sums]
        return state.select(*self.keys, "n", *(f"sum_{c}" for c in self.sums), *means, *(f"{p}_{c}" for c in self.ranges for p in ("low", "high")))


def _files(spark: SparkSession, source: str) -> list[str]:
    fs, path = warehouse._fs(spark, source)
    found = [s.getPath().toString() for s in fs.listStatus(path()) if s.isFile()] if fs.exists(path()) else []
    return sorted(f for f in found if f.endswith(".parquet"))


def _current(spark: SparkSession, mart: Mart) -> tuple[str | None, set[str]]:
    """The published version and the files that are in it."""
    found = warehouse.versions(spark, f"{mart.folder}/state")
    fs, path = warehouse._fs(spark, f"{mart.folder}/state")
    if not found or not fs.exists(path("CURRENT")):
        return None, set()
    version = spark.read.text(f"{mart.folder}/state/CURRENT").first()[0]
    return version, {r[0] for r in spark.read.text(f"{mart.folder}/files/{version}").collect()}


def refresh(spark: SparkSession, mart: Mart, source: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Takes in the Parquet files of source that the mart has not consumed; the run as it is logged."""
    version, consumed = _current(spark, mart)
    new = [f for f in _files(spark, source) if f not in consumed]
    target = str(int(version or 0) + 1)
    run = {"run_id": f"{target}-{time.time_ns()}", "version": version, "status": "UNCHANGED", "files": len(new), "rows_read": 0, "rows_written": 0, "started": time.time(), "error": None}
    try:
        if new:
            rows = spark.read.parquet(*new)
            state = mart.partial(prepare(rows) if prepare else rows)
            if version:
                state = mart.merged(state.unionByName(spark.read.parquet(f"{mart.folder}/state/version={version}")))
            listed = spark.createDataFrame([(f,) for f in sorted({*consumed, *new})], "value string")
            listed.coalesce(1).write.mode("overwrite").text(f"{mart.folder}/files/{target}")
            fs, path = warehouse._fs(spark, f"{mart.folder}/state")
            fs.delete(path(f"version={target}"), True)  # of a run that died before its pointer moved
            published = warehouse.publish(state, f"{mart.folder}/state", target)
            run |= {"version": target, "status": "REFRESHED", "rows_read": rows.count(), "rows_written": published.count()}
    except Exception as error:
        run |= {"status": "FAILED", "error": str(error)[:500]}
        raise
    finally:
        run["finished"] = time.time()
        spark.createDataFrame([(json.dumps(run),)], "value string").coalesce(1).write.mode("append").text(f"{mart.folder}/log")
    return run


def read(spark: SparkSession, mart: Mart) -> DataFrame:
    return mart.figures(warehouse.latest_version(spark, f"{mart.folder}/state"))


def runs(spark: SparkSession, mart: Mart) -> DataFrame:
    """The log: a row per run, failed ones with their error."""
    return spark.read.text(f"{mart.folder}/log").select(F.from_json("value", RUN).alias("r")).select("r.*")
