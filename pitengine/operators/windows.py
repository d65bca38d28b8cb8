"""Daily series: trailing sums before a cutoff, growth, spread, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitengine.functions.stats import safe_ratio


def daily_series(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(key, F.to_date(at).alias("day")).agg(F.sum(value).alias("value"), F.count("*").alias("observations"))


def trailing_features(daily: DataFrame, cutoffs: DataFrame, key: str, windows: Sequence[int] = (7, 30, 90, 365), available: str | None = None) -> DataFrame:
    """Per cutoff (key, cutoff): sums of the days strictly before it, days observed, growth and variation.

    With available, days that became known on the cutoff day or later are left out.
    """
    rows = cutoffs.join(daily, key, "left").withColumn("_back", F.datediff("cutoff", "day"))
    if available:
        rows = rows.withColumn("_back", F.when(F.col(available) < F.col("cutoff"), F.col("_back")))
    inside = lambda a, b: F.when(F.col("_back").between(a, b), F.col("value"))
    sums = [F.sum(inside(1, w)).alias(f"sum_{w}d") for w in windows]
    out = rows.groupBy(key, "cutoff").agg(*sums, F.count(F.when(F.col("_back") >= 1, 1)).alias("days_observed"), F.sum(inside(31, 60)).alias("_before"), F.avg(inside(1, 30)).alias("_mean"), F.stddev_pop(inside(1, 30)).alias("_spread"), F.max(inside(1, 30)).alias("_peak"))
    return out.withColumn("growth_30d", safe_ratio(F.col("sum_30d") - F.col("_before"), F.col("_before"))).withColumn("variation", safe_ratio(F.col("_spread"), F.col("_mean"))).withColumn("spike", safe_ratio(F.col("_peak"), F.col("_mean"))).drop("_before", "_mean", "_spread", "_peak")


def densify(daily: DataFrame, key: str) -> DataFrame:
    """Every day from a key's first to its last, with OBSERVED, TRUE_ZERO or MISSING; values of missing days stay NULL."""
    span = daily.groupBy(key).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(key, F.explode(F.sequence("a", "b")).alias("day"))
    state = F.when(F.col("value").isNull(), "MISSING").when(F.col("value") == 0, "TRUE_ZERO").otherwise("OBSERVED")
    return days.join(daily, [key, "day"], "left").withColumn("state", state)


def moving_average_fold(daily: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """Exponential moving average in day order, seeded with the first value."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("day", "value"))), lambda x: x["value"])
    series = daily.groupBy(key).agg(values.alias("values"))
    fold = F.aggregate(F.slice("values", F.lit(2), F.greatest(F.size("values") - 1, F.lit(0))), F.col("values")[0], lambda acc, v: alpha * v + (1 - alpha) * acc)
    return series.select(key, F.size("values").alias("days"), fold.alias("ewma"))


def drawdown(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Largest fall from a running peak, total return, and period count per key; periods after a value <= 0 are skipped."""
    own = Window.partitionBy(*keys).orderBy(*order)
    peak = F.max(value).over(own.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag(value).over(own)
    steps = rows.withColumn("_fall", F.try_divide(F.col(value), peak) - 1).withColumn("_return", F.when(before > 0, F.col(value) / before - 1))
    return steps.groupBy(*keys).agg(F.min("_fall").alias("max_drawdown"), F.avg("_return").alias("mean_return"), F.stddev_samp("_return").alias("sd_return"), F.count("_return").alias("periods"))
