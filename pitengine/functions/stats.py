"""Statistics as columns and small aggregations. Missing input gives NULL and never zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitengine.session import materialize


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """Coverage convention: an empty denominator gives 0.0."""
    return F.coalesce(safe_ratio(a, b), F.lit(0.0))


def hhi(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Herfindahl index of a category per key; empty strings count as a category, NULL does not."""
    counts = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("hhi"), F.count("*").alias("categories"))


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, qs: Sequence[float]) -> DataFrame:
    """Per key and q the smallest value whose cumulative weight reaches q times the total; the plain median where no weight is positive."""
    own = Window.partitionBy(*keys)
    below = F.sum(weight).over(own.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).withColumn("_below", below).withColumn("_total", F.sum(weight).over(own))
    parts = [F.coalesce(F.min(F.when((F.col("_total") > 0) & (F.col("_below") >= q * F.col("_total")), F.col(value))), F.percentile(value, 0.5)).alias(f"q{round(100 * q):02d}") for q in qs]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def competition_rank(keys: Sequence[str], *order: Column) -> Column:
    """1, 2, 2, 4: ties share the smallest place."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(*order))


def ordinal_rank(keys: Sequence[str], *order: Column) -> Column:
    """1, 2, 3, 4: ties are broken by the order's last column, which must be unique."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def average_rank(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the mean place of ties. Places come from counts per value, so no key's rows meet in one task."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(*keys, value, (before + (F.col("_n") + 1) / 2).alias(name))
    return df.join(places, [*keys, value])


def running_totals(df: DataFrame, order: Sequence[Column], **columns: Column) -> DataFrame:
    """Adds the sum of each column over the rows before, in a global order without ties.

    Rows are dealt by ranges of the order, summed within a range and carried on by one row per range, so no task holds all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns(columns).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    rows = materialize(rows, "ranges")  # the bounds of ranges come from a sample: written once, they stay
    sums = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    along = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *(F.sum(f"_{c}").over(along).alias(f"_{c}") for c in columns))  # one row per range
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rows = rows.withColumns({c: F.coalesce(F.sum(c).over(own), zero) for c in columns}).join(F.broadcast(before), "_range")
    return rows.withColumns({c: F.col(c) + F.coalesce(f"_{c}", zero) for c in columns}).drop("_range", *(f"_{c}" for c in columns))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with average ties, from counts per score; NULL if one class is absent."""
    counts = df.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    won = running_totals(counts, [F.col(score)], below=F.col("n")).select("p", "n", (F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won"))
    return won.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.try_divide(F.sum("won"), F.sum("p") * F.sum("n")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over falling scores of the gain in recall times precision; ties are one step."""
    counts = df.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    steps = running_totals(counts, [F.desc(score)], hits=F.col("p"), rows=F.col("n")).select("p", ((F.col("hits") + F.col("p")) / (F.col("rows") + F.col("n"))).alias("precision"))
    return steps.agg(F.try_divide(F.sum(F.col("p") * F.col("precision")), F.sum("p")).alias("average_precision"))


def regression_metrics(df: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    """mae, mdae, rmse, rmsle, wape, r2, mape (in percent, over non-zero truths) and bias of rows where both are known."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull())
    e = F.abs(y - p)
    log_e = F.pow(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(y, F.lit(0.0))), F.lit(2.0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(e).alias("mae"),
        F.percentile(e, 0.5).alias("mdae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.sqrt(F.avg(log_e)).alias("rmsle"),
        safe_ratio(F.sum(e), F.sum(F.abs(y))).alias("wape"),
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*"))).alias("r2"),
        (100 * F.avg(F.when(y != 0, e / F.abs(y)))).alias("mape"),
        F.avg(p - y).alias("bias"),
    )
