"""Exact order statistics of keys of any size, by narrowing ranges.

Keys of up to ``SMALL`` values take Spark's own percentile. A larger key's values are parted by splitters (approximate percentiles,
which only steer): each pass counts values per range with partial sums, finds the range that a wanted rank lies in, and goes on
with the values of that range alone. Values that equal a splitter are a range of their own, so ties end the search at once. Splitters
stand close only around the middle, where a median lies, so a value is held against a dozen of them; a pass cuts a range to
about 2/``PARTS`` of its values (a sixth where the rank is elsewhere). No task sorts or holds a key, and what remains is sorted once it is ``SMALL``.

df is read about twice a pass: where it is more than a scan, pass a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitengine.session import materialize

SMALL, PARTS = 1 << 16, 128
#: Places of the splitters in a range, as fractions of its values, and how exactly they are met (of which one part in ACCURACY may be missed).
FRACTIONS, ACCURACY = [0.0, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2 - 1 / PARTS, 1 / 2 + 1 / PARTS, 5 / 8, 3 / 4, 7 / 8, 15 / 16, 1.0], 10_000
#: Keys whose splitters are broadcast at a time (a dozen doubles each).
BROADCAST_KEYS = 10_000


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, small: int = SMALL) -> DataFrame:
    """keys, n and median of the known values of each key; keys may be empty."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    # NULL keys are keys: joined by their JSON text
    rows = rows.withColumn("_k", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    sizes = materialize(rows.groupBy("_k", *keys).agg(F.count("*").alias("n")), "key_sizes")
    large = sizes.where(F.col("n") > small)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_v", 0.5).alias("median")).where("n > 0")
    near = rows.join(large.select("_k"), "_k", "left_anti").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_v", 0.5).alias("median")).where("n > 0")
    # one search per wanted rank: (n - 1) / 2 and n / 2, the same for odd n
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    wanted = materialize(large.select("_k", F.explode(ranks.cast("array<long>")).alias("rank")).withColumn("place", F.col("rank")).withColumn("found", F.lit(None).cast("double")), "wanted_ranks")
    left = rows.select("_k", "_v").join(_small(large.select("_k")), "_k", "left_semi").withColumn("_r", F.lit(""))
    wanted = wanted.withColumn("_r", F.lit(""))
    done = wanted.where("found IS NOT NULL")
    while True:
        sizes = materialize(left.groupBy("_k", "_r").agg(F.count("*").alias("_n")), "range_sizes")
        if sizes.where(F.col("_n") > small).isEmpty():
            break
        cuts = left.groupBy("_k", "_r").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", FRACTIONS, ACCURACY))).alias("_cuts"))
        cuts = _small(materialize(cuts, "splitters"))
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        # even: between two splitters, odd: equal to one
        binned = left.join(cuts, ["_k", "_r"]).withColumn("_bin", 2 * below + F.when(F.array_contains("_cuts", F.col("_v")), 1).otherwise(0))
        counts = binned.groupBy("_k", "_r", "_bin").agg(F.count("*").alias("_in"), F.min("_v").alias("_low"))
        before = F.coalesce(F.sum("_in").over(Window.partitionBy("_k", "_r").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = materialize(counts.withColumn("_before", before), "range_counts")
        hit = wanted.join(placed, ["_k", "_r"]).where("place >= _before AND place < _before + _in")
        hit = materialize(hit.withColumn("found", F.when(F.col("_bin") % 2 == 1, F.col("_low"))).withColumn("place", F.col("place") - F.col("_before")).withColumn("_next", F.concat("_r", F.lit("/"), "_bin")), "ranges_hit")
        done = done.unionByName(hit.where("found IS NOT NULL").select(*done.columns))
        wanted = hit.where("found IS NULL").select("_k", "rank", "place", "found", F.col("_next").alias("_r"))
        asked = _small(wanted.select("_k", "_r").distinct())
        left = materialize(binned.select("_k", "_v", F.concat("_r", F.lit("/"), "_bin").alias("_r")).join(asked, ["_k", "_r"], "left_semi"), "values_left")
    place = F.row_number().over(Window.partitionBy("_k", "_r").orderBy("_v")) - 1
    last = left.withColumn("_at", place).join(wanted, ["_k", "_r"]).where("_at = place").select("_k", "rank", "place", F.col("_v").alias("found"), "_r")
    medians = done.unionByName(last.select(*done.columns)).groupBy("_k").agg(F.avg("found").alias("median"))
    return near.unionByName(large.join(medians, "_k").select(*keys, "n", "median"))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast where it is few rows, else left to the optimizer."""
    return F.broadcast(table) if len(table.take(BROADCAST_KEYS + 1)) <= BROADCAST_KEYS else table
