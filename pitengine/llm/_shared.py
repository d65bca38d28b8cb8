"""Helpers that the operators of this subpackage share.

Intermediate results that are read more than once go to a Parquet table in the folder that the
cluster names in ``spark.checkpoint.dir``. The table is complete once written, so a lost executor
costs a re-read and never a recomputation with other random bounds or row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.session import materialize, new_path, release, shared_dir

__all__ = ["materialize", "new_path", "release", "shared_dir"]

#: The six ASCII white-space characters; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() would change other letters as well."""
    return F.translate(c, UPPER, LOWER)


def fold(c: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning. A null id is in no fold."""
    return F.crc32(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")) % 5


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of df (upper and lower case are the same)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
