"""As-of history: what was published about an entity strictly before a target started.

Dates are compared by day, so history is first summed per key and publication day; running totals over these
days answer all additive questions (count, sum, last). A key's window then holds days and not
rows, however many rows a key has.

Order statistics are answered in one pass over a key's rows in order of publication (``as_of_fold``), whose state is kept
between questions; no target meets the rows before it. A key with more than ``HOT_ROWS`` rows is cut by value into bins of
about that many: running counts per bin find the bin and the rank in it that a question asks for, and each bin is a pass of its own.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pitengine.session import materialize

#: Rows of a key that one pass takes in.
HOT_ROWS = 1 << 16


def prior_totals(targets: DataFrame, history: DataFrame, keys: Sequence[str], start: str = "start_date", published: str = "pub_date", value: str = "value", order: Sequence[str] = ("start_date", "id")) -> DataFrame:
    """targets with prior_count, prior_sum and prior_last (the value of the prior row that is last by order).

    A row without a value or publication day is never prior; targets without a key or start have count 0.
    """
    known = history.where(F.col(value).isNotNull() & F.col(published).isNotNull())
    # results and questions of a day meet in one aggregation
    given = known.select(*keys, F.col(published).alias("_day"), F.lit(1).cast("long").alias("_n"), F.col(value).alias("_s"), F.struct(*order, F.col(value).alias("_v")).alias("_last"), F.lit(False).alias("_asked"))
    asked = targets.select(*keys, F.col(start).alias("_day"), F.lit(True).alias("_asked"))
    days = given.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "_day").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.max("_last").alias("_last"), F.max("_asked").alias("_asked"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    totals = days.select(*keys, "_day", "_asked", F.sum("_n").over(before).alias("prior_count"), F.sum("_s").over(before).alias("prior_sum"), F.max("_last").over(before).alias("_last")).where("_asked")
    joined = targets.withColumn("_day", F.col(start)).join(totals, [*keys, "_day"], "left")
    return joined.withColumn("prior_count", F.coalesce("prior_count", F.lit(0).cast("long"))).withColumn("prior_last", F.col("_last._v")).withColumn("prior_last_start", F.col(f"_last.{order[0]}")).drop("_day", "_asked", "_last")


def _plain(column: pa.Array, asked: np.ndarray) -> list:
    """A column's Python values; where asked is false they don't count. Numbers take numpy's way, which is some ten times as fast."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    values = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    if column.null_count:
        for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False) & asked).tolist():
            values[k] = None
    return values


def as_of_fold(asked: DataFrame, history: DataFrame, keys: Sequence[str], columns: Sequence[str], fold: Callable[[], Any], answer: str, extra: Sequence[str] = ()) -> DataFrame:
    """The rows of asked (keys, _start, extra) with what a fold over the rows published before says.

    history: keys, _pub and columns. A fold has add(*columns) and answer(*extra), a tuple of the types in ``answer`` or None
    for no row. A key's rows come to one task, sorted; only the fold's state is held.
    """
    schema = asked.select(*keys, "_start", *extra).schema
    rows = history.where(F.col("_pub").isNotNull()).select(*keys, F.col("_pub").alias("_start"), F.lit(False).alias("_ask"), *columns)
    asks = asked.where(F.col("_start").isNotNull()).select(*keys, "_start", F.lit(True).alias("_ask"), *extra)
    both = rows.unionByName(asks, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_start", F.desc("_ask"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches):
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, ask = tuple(batch.column(k)[0].as_py() for k in keys), batch.column("_ask").to_numpy(zero_copy_only=False)
            new = np.zeros(batch.num_rows, bool)
            new[0] = state is None or first != last
            for k in keys:
                code = batch.column(k).dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            items = list(zip(*(_plain(batch.column(c), ~ask) for c in columns)))
            given = list(zip(*(_plain(batch.column(c), ask) for c in extra))) if extra else [()] * batch.num_rows
            at, out = [], []
            for k, (begins, asks, item, more) in enumerate(zip(new.tolist(), ask.tolist(), items, given)):
                if begins:
                    state = fold()
                if not asks:
                    state.add(*item)
                elif (found := state.answer(*more)) is not None:
                    at.append(k)
                    out.append(found)
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            # what was asked is taken over as it is, the answers stand behind it
            asked_columns = batch.select(schema.names).take(pa.array(at, pa.int64())).columns
            answers = list(zip(*out)) if out else [[] for _ in range(len(arrow) - len(asked_columns))]
            types = [f.type for f in arrow]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(asked_columns, types)] + [pa.array(c, t) for c, t in zip(answers, types[len(asked_columns) :])], schema=arrow)

    arrow = to_arrow_schema(asked.sparkSession.createDataFrame([], f"{fields}, {answer}").schema)
    return both.mapInArrow(run, f"{fields}, {answer}")


class Ordered:
    """Values seen so far, in order."""

    def __init__(self):
        self.values: list[float] = []

    def add(self, value: float) -> None:
        insort(self.values, value)


class Median(Ordered):
    def answer(self):
        n = len(self.values)
        return ((self.values[(n - 1) // 2] + self.values[n // 2]) / 2,) if n else None


class Ranked(Ordered):
    def answer(self, rank: int):
        return (self.values[rank],)


def prior_median(targets: DataFrame, history: DataFrame, keys: Sequence[str], value: str, name: str, start: str = "start_date", published: str = "pub_date", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, _start, name): exact medians of prior values, one row per distinct key and start day that has any."""
    asked = targets.select(*keys, F.col(start).alias("_start")).dropna().distinct()
    past = history.select(*keys, F.col(published).alias("_pub"), F.col(value).cast("double").alias("_value")).dropna()
    hot = past.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_value", [k / 64 for k in range(1, 64)], 10_000).alias("_cuts")).where(F.col("_n") > hot_rows)
    hot = materialize(hot, "hot_keys")
    if hot.limit(1).count() == 0:
        return as_of_fold(asked, past, keys, ["_value"], Median, f"`{name}` double")
    small = as_of_fold(asked.join(hot, list(keys), "left_anti"), past.join(hot, list(keys), "left_anti"), keys, ["_value"], Median, f"`{name}` double")
    # cuts only deal rows over bins; what they are does not show in the result
    binned = past.join(hot.select(*keys, "_cuts"), list(keys)).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_value")))).drop("_cuts")
    each = asked.join(hot.select(*keys), list(keys)).withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(63))))
    counted = prior_totals(each.withColumnRenamed("_start", "start_date"), binned.select(*keys, "_bin", F.col("_pub").alias("pub_date"), F.col("_pub").alias("start_date"), F.lit(0).alias("id"), F.lit(1.0).alias("value")), [*keys, "_bin"])
    counts = F.transform(F.array_sort(F.collect_list(F.struct("_bin", "prior_count"))), lambda x: x["prior_count"])
    per = counted.groupBy(*keys, F.col("start_date").alias("_start")).agg(counts.alias("_counts"), F.sum("prior_count").alias("_n")).where("_n > 0")
    wanted = per.withColumn("_place", F.explode(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))).withColumn("_below", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.aggregate(F.slice("_counts", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x)))
    found = wanted.withColumn("_bin", F.size(F.filter("_below", lambda b: b <= F.col("_place"))) - 1).withColumn("_rank", (F.col("_place") - F.element_at("_below", F.col("_bin") + 1)).cast("long"))
    ranked = as_of_fold(found.select(*keys, "_bin", "_start", "_rank"), binned, [*keys, "_bin"], ["_value"], Ranked, "_found double", extra=["_rank"])
    return small.unionByName(ranked.groupBy(*keys, "_start").agg(F.avg("_found").alias(name)))


def fallback_medians(targets: DataFrame, history: DataFrame, levels: Sequence[Sequence[str]], value: str, default: float | None = None) -> DataFrame:
    """targets with estimate and level (0 for the first level): the median of the first level that has prior values.

    A level is only looked up for the targets that the levels before left open, so the broad ones, whose
    histories are long, meet few targets. What a level leaves open is a written table: both its sides read it. A level
    without keys is the median of all that was published before the target started.
    """
    keyed = sorted({k for keys in levels for k in keys})
    whole = F.lit(0).alias("_all")
    columns = [c for c in dict.fromkeys([*keyed, "pub_date", value])]
    history = materialize(history.select(*columns, whole).where(F.col(value).isNotNull() & F.col("pub_date").isNotNull()), "fallback_history")
    done, rest = None, materialize(targets.select("*", whole), "fallback_targets")
    for k, keys in enumerate(levels):
        keys = list(keys) or ["_all"]
        found = prior_median(rest, history, keys, value, "estimate").withColumnRenamed("_start", "start_date")
        joined = materialize(rest.join(found, [*keys, "start_date"], "left"), "fallback_level")
        hit = joined.where(F.col("estimate").isNotNull()).withColumn("level", F.lit(k)).select(*targets.columns, "estimate", "level")
        done = hit if done is None else done.unionByName(hit)
        rest = joined.where(F.col("estimate").isNull()).drop("estimate")
    last = rest.drop("_all").withColumn("estimate", F.lit(default).cast("double")).withColumn("level", F.lit(len(levels)))
    return done.unionByName(last)


def pooled_mean(n: Column, total: Column, prior: Column, strength: float) -> Column:
    """(n * mean + k * prior) / (n + k)."""
    return (F.coalesce(total, F.lit(0.0)) + strength * prior) / (n + strength)


def waterfall(rows: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first condition that holds, NULL for eligible rows."""
    first = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        first = F.when(condition, name).otherwise(first)
    return rows.withColumn("reason", first)


def latest_as_of(rows: DataFrame, keys: Sequence[str], known: str, as_of: Column, order: Sequence[str]) -> DataFrame:
    """Per key the last row known at as_of; order breaks ties and must be unique."""
    seen = rows.where(F.col(known) <= as_of)
    best = seen.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rows.columns if c not in (*keys, *order)))).alias("_row"))
    return best.select(*keys, "_row.*")


def close_superseded(rows: DataFrame, keys: Sequence[str], known: str, order: Sequence[str]) -> DataFrame:
    """Adds valid_to: the time at which the key's next row replaced this one (NULL: still valid). Nothing is deleted."""
    return rows.withColumn("valid_to", F.lead(known).over(Window.partitionBy(*keys).orderBy(*order)))
