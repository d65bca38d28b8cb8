"""Components of claims that two things are one, and the pointers that a merge leaves behind.

Components are found by alternating stars: in a round each node's larger neighbours are pointed at its smallest one, then its smaller ones
too, until the edges stay as they were; every round is a written table. A round halves the length of chains, so a chain of n
links takes about log n rounds, and a hub is only ever summed by ``min`` (partial sums before the shuffle), never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitengine.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is joined with) of all nodes in edges (a, b); rows with a NULL end join nothing."""
    known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        least = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # the larger neighbours of a node (the a of edges that it is the b of, and the node itself) go to its least one
        up = now.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("low").alias("b"))
        down = materialize(up.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct(), "links")
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        joined = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        new = materialize(joined.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct(), "links")
        if new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = new


def merged(rows: DataFrame, claims: DataFrame, key: str, rank: Column) -> DataFrame:
    """rows with canonical (the key that stands for its component), members of the component and superseded.

    claims: a, b, two keys that are one thing. The canonical key is that of the component's first row by rank, then key; no row goes, and
    ``superseded`` is true for those that now point elsewhere. All pointers lead straight to the end of the chain.
    """
    roots = components(claims).withColumnRenamed("node", key)
    placed = rows.join(roots, key, "left").withColumn("_root", F.coalesce("root", key)).drop("root")
    first = placed.groupBy("_root").agg(F.min(F.struct(rank.alias("_rank"), F.col(key).alias("canonical")))["canonical"].alias("canonical"), F.count("*").alias("members"))
    return placed.join(first, "_root").drop("_root").withColumn("superseded", F.col("canonical") != F.col(key))


def repointed(pointers: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Facts that point at a key (column key of pointers) with the canonical key; the key they came with stays as ``original``."""
    ends = placed.select(F.col(key).alias("original"), "canonical")
    return pointers.withColumnRenamed(key, "original").join(ends, "original", "left").withColumn("canonical", F.coalesce("canonical", "original"))
