"""Comparable records: distances over what is known of both sides, strata by shared identity, and weighted valuations.

The nearest of a whole pool are found without comparing pairs. A candidate's distance is set by what it shares with
the target, by what it lacks, and by the month; so in each cell (rows with the same values of a set of identities and the same
gaps) the k nearest by month, then by the later start, hold every row of the cell that can be among the k nearest at all. Where either side
lacks an identity, rows of many months may rank at the most that there is, 1, and the later start decides: there the k latest are held too. Per cell these are kept up day by day of publication (``pit.as_of_fold``), after each day and month of the pool was cut to its k latest.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence
from functools import partial, reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitengine.functions.geo_time import calendar_distance
from pitengine.functions.stats import weighted_quantiles
from pitengine.operators.pit import as_of_fold, prior_totals
from pitengine.session import materialize

#: Weight of each component, and what a component that is missing on either side adds to the ranking distance.
WEIGHTS = {"entity": 3.0, "place": 2.0, "market": 1.5, "series": 1.0, "calendar": 1.0}
MISSING_PENALTY = 0.1
NAMES = ("entity", "place", "market", "series")
#: From the most specific identity to the whole pool.
STRATA = (("entity", "place"), ("entity", "market"), ("entity",), ("place",), ("market",), ())


def component(name: str) -> Column:
    a, b = F.col(f"t_{name}"), F.col(f"c_{name}")
    return F.when(a.isNotNull() & b.isNotNull(), (a != b).cast("double"))


def distances(pairs: DataFrame) -> DataFrame:
    """Adds distance (over observed components), coverage (their weight) and ranking (with penalties, at most 1)."""
    parts = {k: component(k) for k in WEIGHTS if k != "calendar"} | {"calendar": calendar_distance(F.col("t_start"), F.col("c_start"))}
    total = sum(WEIGHTS.values())
    observed, weighted, missing = F.lit(0.0), F.lit(0.0), F.lit(0)
    for k, d in parts.items():
        observed = observed + F.when(d.isNotNull(), WEIGHTS[k]).otherwise(0.0)
        weighted = weighted + F.coalesce(d * WEIGHTS[k], F.lit(0.0))
        missing = missing + d.isNull().cast("int")
    distance = F.try_divide(weighted, observed)
    return pairs.withColumn("distance", distance).withColumn("coverage", observed / total).withColumn("ranking", F.least(F.lit(1.0), F.coalesce(distance, F.lit(1.0)) + MISSING_PENALTY * missing))


class _Latest:
    """Per month the k latest rows (smallest minus start, then id) published so far."""

    def __init__(self, k: int):
        self.k, self.months = k, {}

    def add(self, month: int, minus_start: int, row: int) -> None:
        rows = self.months.setdefault(month, [])
        insort(rows, (minus_start, row))
        del rows[self.k :]

    def answer(self, month: int, tied: int):
        out = []
        for off in range(7):
            at = sorted(x for m in {(month - 1 + off) % 12 + 1, (month - 1 - off) % 12 + 1} for x in self.months.get(m, ()))
            out += [row for _, row in at[: self.k - len(out)]]
        if tied:
            latest = sorted(x for rows in self.months.values() for x in rows)[: self.k]
            out = list(dict.fromkeys(out + [row for _, row in latest]))
        return (out,) if out else None


def _closed_subsets(rows: DataFrame) -> list[tuple[str, ...]]:
    """Subsets of NAMES, without those that other names follow from (every row of an entity may have one market): their cells are the same."""
    implied = {}
    for name in NAMES:
        others = [n for n in NAMES if n != name]
        one = lambda n: F.bool_and((F.col(f"low_{n}") == F.col(f"high_{n}")) & (F.col(f"known_{n}") == F.col("n")))
        sides = [c for n in others for c in (F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"), F.count(n).alias(f"known_{n}"))]
        found = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), *sides).agg(*(one(n).alias(n) for n in others)).first()
        implied[name] = {n for n in others if found[n]}
    every = [frozenset(c) for size in range(len(NAMES), -1, -1) for c in combinations(NAMES, size)]
    return [tuple(n for n in NAMES if n in s) for s in every if all(implied[n] <= s for n in s)]


def nearest_pairs(targets: DataFrame, pool: DataFrame, value: str, k: int) -> DataFrame:
    """Pairs (as of ``candidate_pairs``) that hold, for each target, its k nearest in the pool and in each of STRATA.

    Targets and pool rows need a start; pool rows a value and a day of publication before the target's start. All subsets of
    identities go through one shuffle and one fold: a row stands in one cell per subset, and only in cells that a target asks for.
    """
    gaps = F.concat(*(F.col(n).isNull().cast("int").cast("string") for n in NAMES))
    rows = pool.where(F.col(value).isNotNull() & F.col("pub_date").isNotNull() & F.col("start_date").isNotNull())
    rows = materialize(rows.select("id", *NAMES, "start_date", F.col("pub_date").alias("_pub"), F.col(value).cast("double").alias("value"), gaps.alias("gaps"), F.month("start_date").alias("month"), (-F.unix_date("start_date")).alias("minus_start")), "comparable_pool")
    asked = materialize(targets.where("start_date IS NOT NULL").select("id", *NAMES, F.col("start_date").alias("_start"), F.month("start_date").alias("month"), reduce(or_, (F.col(n).isNull() for n in NAMES)).cast("int").alias("lacks")), "comparable_targets")
    kinds = F.lit([r.gaps for r in rows.select("gaps").distinct().collect()] or [""])  # at most 16
    subsets = _closed_subsets(rows.select(*NAMES).unionByName(asked.select(*NAMES)))

    def in_cells(df):
        """A row per subset whose identities are all known, the other identities NULL."""
        own = lambda names: [(F.col(n) if n in names else F.lit(None).cast(rows.schema[n].dataType)).alias(n) for n in NAMES]
        known = lambda names: reduce(and_, (F.col(n).isNotNull() for n in names), F.lit(True))
        each = F.array(*(F.when(known(names), F.struct(F.lit(s).alias("subset"), *own(names))) for s, names in enumerate(subsets)))
        return df.withColumn("cell", F.explode(F.array_compact(each))).drop(*NAMES).select("*", "cell.*").drop("cell")

    keys = ["subset", *NAMES, "gaps"]
    wanted = materialize(in_cells(asked.withColumnRenamed("id", "t_id")), "comparable_wanted")
    # targets of one cell and day get the same answer: asked once, so a broad cell is asked as often as there are days
    days = wanted.groupBy("subset", *NAMES, "_start", "month").agg(F.max("lacks").alias("lacks")).withColumn("gaps", F.explode(kinds))
    days = days.withColumn("tied", F.greatest("lacks", F.col("gaps").contains("1").cast("int")))
    cells = days.select(*(F.col(c).alias(f"w_{c}") for c in keys)).distinct()
    own = in_cells(rows.select("id", *NAMES, "gaps", "_pub", "month", "minus_start"))
    same = [own[c].eqNullSafe(cells[f"w_{c}"]) for c in keys]
    own = own.join(cells, same, "left_semi")
    order = F.row_number().over(Window.partitionBy(*keys, "_pub", "month").orderBy("minus_start", "id"))
    own = own.withColumn("_n", order).where(F.col("_n") <= k + 1)
    found = as_of_fold(days, own, keys, ["month", "minus_start", "id"], partial(_Latest, k + 1), "ids array<long>", extra=["month", "tied"])
    answers = found.select(*(F.col(c).alias(f"w_{c}") for c in (*keys[:-1], "_start")), "ids")
    met = wanted.join(answers, [wanted[c].eqNullSafe(answers[f"w_{c}"]) for c in (*keys[:-1], "_start")])
    # each candidate of a target once, before anything is joined to it
    pairs = materialize(met.select("t_id", F.explode("ids").alias("c_id")).where("t_id <> c_id").distinct(), "comparable_pairs")
    t = asked.select(F.col("id").alias("t_id"), F.col("_start").alias("t_start"), *(F.col(n).alias(f"t_{n}") for n in NAMES))
    c = rows.select(F.col("id").alias("c_id"), F.col("start_date").alias("c_start"), F.col("_pub").alias("c_pub"), F.col("value").alias("c_value"), *(F.col(n).alias(f"c_{n}") for n in NAMES))
    return pairs.join(t, "t_id").join(c, "c_id")


def stratum_sizes(targets: DataFrame, pool: DataFrame, value: str) -> DataFrame:
    """t_id, stratum and n, the pool rows of each stratum that were published before the target started; none with n = 0."""
    rows = pool.where(F.col(value).isNotNull() & F.col("start_date").isNotNull()).withColumn("_all", F.lit(1))
    # a target that is in the pool itself may be counted among its own
    own = rows.select("id", ((F.col("pub_date") < F.col("start_date"))).cast("long").alias("_self"))
    t = targets.where("start_date IS NOT NULL").select("id", *NAMES, "start_date").join(own, "id", "left").withColumn("_all", F.lit(1))
    out, t = None, materialize(t, "stratum_targets")
    first = dict(zip((frozenset(x) for x in STRATA), range(1, 1 + len(STRATA))))
    for names, k in first.items():
        keys = [n for n in NAMES if n in names] or ["_all"]
        history = rows.select(*keys, "start_date", "pub_date", "id", F.lit(1.0).alias("value"))
        one = prior_totals(t.select("id", *keys, "start_date", "_self"), history, keys)
        one = one.select(F.col("id").alias("t_id"), F.lit(k).alias("stratum"), (F.col("prior_count") - F.coalesce("_self", F.lit(0))).alias("n")).where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


def candidate_pairs(targets: DataFrame, pool: DataFrame, value: str, keys: Sequence[str] = ("entity", "place")) -> DataFrame:
    """Targets with the pool rows that share one of the keys and were published before the target started.

    One equi join per key and a distinct, in place of a join on a disjunction.
    """
    names = ("entity", "place", "market", "series")
    t = targets.select(F.col("id").alias("t_id"), F.col("start_date").alias("t_start"), *(F.col(n).alias(f"t_{n}") for n in names))
    c = pool.where(F.col(value).isNotNull()).select(F.col("id").alias("c_id"), F.col("start_date").alias("c_start"), F.col("pub_date").alias("c_pub"), F.col(value).cast("double").alias("c_value"), *(F.col(n).alias(f"c_{n}") for n in names))
    joined = [t.join(c, t[f"t_{k}"] == c[f"c_{k}"]).where((F.col("c_pub") < F.col("t_start")) & (F.col("t_id") != F.col("c_id"))) for k in keys]
    out = joined[0]
    for k, more in enumerate(joined[1:], 1):  # pairs that an earlier key has are left out: no distinct over all pairs
        earlier = F.lit(False)
        for key in keys[:k]:
            earlier = earlier | F.coalesce(F.col(f"t_{key}") == F.col(f"c_{key}"), F.lit(False))
        out = out.unionByName(more.where(~earlier))
    return out


def retrieve_global(scored: DataFrame, k: int, least_coverage: float = 0.0) -> DataFrame:
    """The k nearest per target by ranking distance, ties by the later start and the smaller id."""
    place = F.row_number().over(Window.partitionBy("t_id").orderBy("ranking", F.desc("c_start"), "c_id"))
    return scored.where(F.col("coverage") >= least_coverage).withColumn("place", place).where(F.col("place") <= k)


def retrieve_stratum(scored: DataFrame, sizes: DataFrame, k: int, least: int) -> DataFrame:
    """The k nearest of the most specific stratum that has at least least rows (n of sizes), else of the first that has any."""
    chosen = sizes.groupBy("t_id").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("stratum"))), F.min("stratum")).alias("stratum"))
    inside = F.lit(False)
    for s, names in enumerate(STRATA, 1):
        same = F.col("stratum") == s
        for n in names:
            same = same & F.coalesce(F.col(f"t_{n}") == F.col(f"c_{n}"), F.lit(False))
        inside = inside | same
    return retrieve_global(scored.join(chosen, "t_id").where(inside), k)


def valuation(nearest: DataFrame, qs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Quantiles of the comparables' values weighted by 1 / (1 + distance), their range, and the sum of weights."""
    rows = nearest.withColumn("_w", 1 / (1 + F.col("ranking")))
    spread = rows.groupBy("t_id").agg(F.min("c_value").alias("low"), F.max("c_value").alias("high"), F.sum("_w").alias("ess"))
    return weighted_quantiles(rows, ["t_id"], "c_value", "_w", qs).join(spread, "t_id")
