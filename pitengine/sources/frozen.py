"""Frozen corpora: a table version with a digest of its rows that doesn't depend on their order.

Each row has a 128-bit digest of its values, NULLs apart from empty texts; the sums of its two halves modulo 2**64 and the number of rows make the
digest of the table. Sums combine in any order over any partitioning, and unlike an exclusive or they see repeated rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODULUS = 1 << 64


def row_text(columns: list[str]) -> Column:
    """The row's values, each with its length before it, NULL as a mark without one."""
    each = [F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in columns]
    return F.concat(*each) if each else F.lit("")


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows and digest (32 hexadecimal digits) of all rows, columns in the order of their names."""
    digest = F.sha2(row_text(sorted(df.columns)).cast("binary"), 256)
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(half(at), F.lit(0)).alias(name) for at, name in ((1, "a"), (17, "b"))))
    part = lambda c: F.lpad(F.lower(F.conv(F.pmod(F.col(c).cast("decimal(38,0)"), F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string"), 10, 16)), 16, "0")
    return sums.select("rows", F.concat(part("a"), part("b")).alias("digest"))


def freeze(df: DataFrame, folder: str, version: str) -> dict:
    """Writes df and its manifest (version, columns, rows, digest); an existing version is never overwritten."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{folder}/{version}/rows")
    # of what was written, not of a second run of the plan
    found = table_digest(spark.read.parquet(f"{folder}/{version}/rows")).first()
    manifest = {"version": version, "columns": df.columns, "rows": found["rows"], "digest": found["digest"]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/{version}/manifest")
    return manifest


def load(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """The rows of a version, once they are verified against its manifest."""
    manifest = json.loads(spark.read.text(f"{folder}/{version}/manifest").first()[0])
    df = spark.read.parquet(f"{folder}/{version}/rows")
    found = table_digest(df).first()
    if (found["rows"], found["digest"]) != (manifest["rows"], manifest["digest"]) or df.columns != manifest["columns"]:
        raise ValueError(f"version {version} is not what its manifest says")
    return df
