"""Editions of recurring events: trajectories of billing over the years, and one metric row per edition that is recomputed only if its inputs changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitengine.sources.frozen import MODULUS, row_text


def trajectories(billed: DataFrame, keys: Sequence[str], year: str = "year", tier: str = "tier") -> DataFrame:
    """billed (one row per keys and year; tier 1 is the top) with move (ENTRY, UP, DOWN, SAME, RETURN after missed years), gap (years missed) and run,
    the number of the unbroken stretch of years that the row is in (gaps and islands)."""
    own = Window.partitionBy(*keys).orderBy(year)
    before, last = F.lag(year).over(own), F.lag(tier).over(own)
    gap = F.coalesce(F.col(year) - before - 1, F.lit(0)).cast("int")
    move = F.when(before.isNull(), "ENTRY").when(gap > 0, "RETURN").when(F.col(tier) < last, "UP").when(F.col(tier) > last, "DOWN").otherwise("SAME")
    rows = billed.withColumn("gap", gap).withColumn("move", move).withColumn("_new", F.when(before.isNull() | (gap > 0), 1).otherwise(0))
    return rows.withColumn("run", F.sum("_new").over(own).cast("int")).drop("_new")


def editions(lineup: DataFrame) -> DataFrame:
    """festival, year and the year before that it has an edition of (NULL for the first). lineup: festival, year, entity, attention."""
    years = lineup.select("festival", "year").distinct()
    return years.withColumn("compared", F.lag("year").over(Window.partitionBy("festival").orderBy("year")))


def input_hashes(lineup: DataFrame) -> DataFrame:
    """festival, year, compared and input_hash of all that an edition's metrics are made of: its own rows and those of the edition it is
    compared with, in any order."""
    digest = F.sha2(row_text(["entity", "attention"]).cast("binary"), 256)
    part = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    own = lineup.groupBy("festival", "year").agg(F.count("*").alias("n"), F.pmod(F.sum(part).cast("decimal(38,0)"), F.lit(str(MODULUS)).cast("decimal(38,0)")).alias("h"))
    pairs = editions(lineup).join(own, ["festival", "year"]).withColumnsRenamed({"n": "own_n", "h": "own_h"})
    other = own.select("festival", F.col("year").alias("compared"), "n", "h")
    text = F.concat_ws("|", "own_n", "own_h", F.coalesce(F.col("compared").cast("string"), F.lit("")), F.coalesce(F.col("n").cast("string"), F.lit("")), F.coalesce(F.col("h").cast("string"), F.lit("")))
    return pairs.join(other, ["festival", "compared"], "left").select("festival", "year", "compared", F.sha2(text, 256).alias("input_hash"))


def edition_metrics(lineup: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row per edition of hashes: artists, share with known attention, concentration of attention, overlap with the edition compared."""
    rows = lineup.join(hashes.select("festival", "year"), ["festival", "year"], "left_semi")
    total = F.sum(F.col("attention").cast("double"))
    own = rows.groupBy("festival", "year").agg(F.count("*").alias("artists"), F.count("attention").alias("known"), total.alias("total"), F.sum(F.col("attention").cast("double") * F.col("attention")).alias("squares"))
    asked = hashes.where("compared IS NOT NULL").select("festival", "year", "compared")
    then = lineup.select("festival", F.col("year").alias("compared"), "entity")
    mine = rows.select("festival", "year", "entity").join(asked, ["festival", "year"])
    shared = mine.join(then, ["festival", "compared", "entity"]).groupBy("festival", "year").agg(F.count("*").alias("shared"))
    sizes = then.groupBy("festival", "compared").agg(F.count("*").alias("others"))
    out = hashes.join(own, ["festival", "year"]).join(shared, ["festival", "year"], "left").join(sizes, ["festival", "compared"], "left")
    both = F.coalesce("shared", F.lit(0))
    jaccard = F.when(F.col("compared").isNotNull(), both / (F.col("artists") + F.col("others") - both))
    concentration = F.try_divide(F.col("squares"), F.col("total") * F.col("total"))
    return out.select("festival", "year", "compared", "artists", (F.col("known") / F.col("artists")).alias("coverage"), concentration.alias("hhi"), jaccard.alias("jaccard"), (F.col("known") == 0).alias("missing"), "input_hash")


def refreshed_metrics(lineup: DataFrame, stored: DataFrame) -> DataFrame:
    """The metrics of all editions, with recomputed: stored rows (as of ``edition_metrics``) stay where the inputs are the same."""
    hashes = input_hashes(lineup)
    same = ["festival", "year", "input_hash"]
    stale = hashes.join(stored.select(*same), same, "left_anti")
    kept = stored.join(hashes.select(*same), same, "left_semi")
    return kept.withColumn("recomputed", F.lit(False)).unionByName(edition_metrics(lineup, stale).withColumn("recomputed", F.lit(True)))
