"""Folds that keep whole groups apart, and a cut in time by the number of rows.

Rows that share a value of any group column are one component (``graph.components`` over the values, never over pairs of rows) and go to one fold.
Components are dealt in the order of their size, back and forth over the folds, by a row number that range partitions carry on; folds then
differ by less than the largest component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitengine.functions.stats import running_totals
from pitengine.operators.graph import components
from pitengine.session import materialize


def group_folds(rows: DataFrame, groups: Sequence[str], folds: int) -> DataFrame:
    """rows with component and fold (0 to folds - 1); a row without any group value is a component of its own kind (NULL) and goes to fold 0."""
    value = lambda g: F.when(F.col(g).isNotNull(), F.concat(F.lit(f"{groups.index(g):03d}:"), F.col(g).cast("string")))
    values = F.array_compact(F.array(*map(value, groups)))
    marked = materialize(rows.withColumn("_values", values).withColumn("_first", F.get("_values", F.lit(0))), "fold_rows")
    links = marked.select(F.col("_first").alias("a"), F.explode("_values").alias("b"))
    roots = components(links)
    placed = marked.join(roots, F.col("_first") == F.col("node"), "left").withColumn("component", F.coalesce("root", "_first")).drop("node", "root", "_values", "_first")
    sizes = placed.where("component IS NOT NULL").groupBy("component").agg(F.count("*").alias("n"))
    numbered = running_totals(sizes, [F.desc("n"), F.col("component")], place=F.lit(1))
    lap, seat = F.floor(F.col("place") / folds), F.pmod(F.col("place"), F.lit(folds))
    dealt = numbered.select("component", F.when(lap % 2 == 0, seat).otherwise(folds - 1 - seat).cast("int").alias("fold"))
    return placed.join(dealt, "component", "left").withColumn("fold", F.coalesce("fold", F.lit(0)))


def time_cut(rows: DataFrame, day: str, share: float = 0.8) -> DataFrame:
    """rows with part: TRAIN up to the day of the row at the share of all dated rows, TEST after it; undated rows are TEST. One day: all TRAIN."""
    days = rows.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("_day")).agg(F.count("*").alias("_n"))  # a row per day
    along = Window.orderBy("_day")
    counted = days.select("_day", F.sum("_n").over(along).alias("_upto"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    cut = counted.where(F.col("_upto") > F.floor(F.col("_all") * share)).agg(F.min("_day").alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(day) <= F.col("_cut"), "TRAIN").otherwise("TEST")).drop("_cut")  # cut is one row
