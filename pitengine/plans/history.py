"""Queries over engagements and what was known before them."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.functions.stats import auc, average_precision, average_rank, hhi, regression_metrics, running_totals
from pitengine.operators import comparables as C
from pitengine.operators import pit
from pitengine.session import materialize
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import engagements, table

POOL_STRENGTH, LEAST_STRATUM, NEAREST = 5.0, 3, 10


def pit_prior_summary(spark: SparkSession, d: str) -> DataFrame:
    """For each engagement: what results of its entity were published before it started?"""
    eng = engagements(spark, d)
    targets = eng.select("id", "entity", "start_date")
    history = eng.select("entity", "start_date", "pub_date", "id", F.col("gross").alias("value"))
    totals = pit.prior_totals(targets, history, ["entity"])
    medians = pit.prior_median(targets, history, ["entity"], "value", "prior_median")
    out = totals.join(medians.withColumnRenamed("_start", "start_date"), ["entity", "start_date"], "left")
    return out.select("id", "entity", "start_date", "prior_count", F.round(F.col("prior_sum") / F.col("prior_count"), 6).alias("prior_mean"), F.round("prior_median", 4).alias("prior_median"), "prior_last", F.datediff("start_date", "prior_last_start").alias("days_since_last"), (F.col("prior_count") > 0).alias("has_history"))


PIT_PRIOR_SUMMARY = ENG + """
SELECT t.id, t.entity, t.start_date, count(h.id) AS prior_count, round(avg(h.gross), 6) AS prior_mean, round(median(h.gross), 4) AS prior_median,
       arg_max(h.gross, (h.start_date, h.id)) AS prior_last, date_diff('day', max(h.start_date), t.start_date) AS days_since_last, count(h.id) > 0 AS has_history
FROM eng t LEFT JOIN eng h ON h.entity = t.entity AND h.pub_date < t.start_date AND h.gross IS NOT NULL
GROUP BY t.id, t.entity, t.start_date
"""


def _reasons():
    return [
        ("NO_RESULT", F.col("pub_date").isNull()),
        ("NO_ENTITY", F.col("entity").isNull()),
        ("OPEN_STATUS", F.col("status") == "O"),
        ("MULTI_SHOW", F.col("shows") > 5),
        ("NO_GROSS", F.col("gross").isNull() | (F.col("gross") <= 0)),
    ]


def population_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Each row under its first reason for exclusion."""
    rows = pit.waterfall(engagements(spark, d), _reasons())
    return rows.groupBy(F.coalesce("reason", F.lit("ELIGIBLE")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("gross"), 2).alias("gross"))


POPULATION_WATERFALL = ENG + """
SELECT CASE WHEN pub_date IS NULL THEN 'NO_RESULT' WHEN entity IS NULL THEN 'NO_ENTITY' WHEN status = 'O' THEN 'OPEN_STATUS' WHEN shows > 5 THEN 'MULTI_SHOW'
            WHEN gross IS NULL OR gross <= 0 THEN 'NO_GROSS' ELSE 'ELIGIBLE' END AS reason, count(*) AS n, round(sum(gross), 2) AS gross
FROM eng GROUP BY 1
"""


def hierarchical_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The prior median of the most specific level that has one: entity at place, entity, place, market, all.

    Only what was published before the target started counts, at the last level too; a target before all results has no estimate."""
    eng = engagements(spark, d)
    targets = eng.select("id", "entity", "place", "market", "start_date")
    out = pit.fallback_medians(targets, eng, [["entity", "place"], ["entity"], ["place"], ["market"], []], "headcount")
    return out.select("id", "level", F.round("estimate", 4).alias("estimate"))


HIERARCHICAL_FALLBACK = ENG + """,
lv AS (
  SELECT t.id, (SELECT median(headcount) FROM eng h WHERE h.entity = t.entity AND h.place = t.place AND h.pub_date < t.start_date) AS a,
         (SELECT median(headcount) FROM eng h WHERE h.entity = t.entity AND h.pub_date < t.start_date) AS b,
         (SELECT median(headcount) FROM eng h WHERE h.place = t.place AND h.pub_date < t.start_date) AS c,
         (SELECT median(headcount) FROM eng h WHERE h.market = t.market AND h.pub_date < t.start_date) AS d FROM eng t),
days AS (SELECT DISTINCT start_date FROM eng),
e AS (SELECT days.start_date, median(h.headcount) AS e FROM days JOIN eng h ON h.pub_date < days.start_date GROUP BY 1)
SELECT id, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 WHEN d IS NOT NULL THEN 3 WHEN e IS NOT NULL THEN 4 ELSE 5 END::int AS level, round(coalesce(a, b, c, d, e), 4) AS estimate
FROM lv JOIN eng USING (id) LEFT JOIN e USING (start_date)
"""


def partial_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Prior means of the entity shrunk to the mean of its market's prior results."""
    eng = engagements(spark, d)
    history = eng.select("entity", "market", "start_date", "pub_date", "id", F.col("headcount").alias("value"))
    rows = pit.prior_totals(eng.select("id", "entity", "market", "start_date"), history, ["entity"])
    rows = rows.select("id", "market", "start_date", F.col("prior_count").alias("n"), F.col("prior_sum").alias("s"))
    rows = pit.prior_totals(rows, history, ["market"])
    prior = F.col("prior_sum") / F.col("prior_count")
    return rows.select("id", "n", F.round(prior, 4).alias("market_mean"), F.round(pit.pooled_mean(F.col("n"), F.col("s"), prior, POOL_STRENGTH), 4).alias("pooled"))


PARTIAL_POOLING = ENG + f""",
e AS (SELECT t.id, t.market, t.start_date, count(h.headcount) AS n, sum(h.headcount) AS s FROM eng t LEFT JOIN eng h ON h.entity = t.entity AND h.pub_date < t.start_date GROUP BY ALL),
days AS (SELECT DISTINCT market, start_date FROM eng),
m AS (SELECT d.market, d.start_date, avg(h.headcount) AS mean FROM days d LEFT JOIN eng h ON h.market = d.market AND h.pub_date < d.start_date GROUP BY ALL)
SELECT id, n, round(mean, 4) AS market_mean, round((coalesce(s, 0) + {POOL_STRENGTH} * mean) / (n + {POOL_STRENGTH}), 4) AS pooled FROM e JOIN m USING (market, start_date)
"""


class _Recent:
    """The last results by start: how many there are in all, and the LAST of them; older ones weigh under 2 ** -60 in the average."""

    LAST = 64

    def __init__(self):
        self.n, self.rows = 0, []

    def add(self, at, prior, value) -> None:
        self.n += 1
        insort(self.rows, (at, prior, value))
        del self.rows[: -self.LAST]

    def answer(self):
        if not self.n:
            return None
        values = [v for _, _, v in self.rows]
        last3, mean = sorted(values[-3:]), values[0]
        for v in values[1:]:
            mean = 0.5 * v + 0.5 * mean
        return self.n, values[-1], (last3[(len(last3) - 1) // 2] + last3[len(last3) // 2]) / 2, mean


def recency_features(spark: SparkSession, d: str) -> DataFrame:
    """Of prior results in order of start: the last, the median of the last three, and an exponential average."""
    eng = engagements(spark, d)
    targets = eng.select("id", "entity", "start_date")
    asked = targets.select("entity", F.col("start_date").alias("_start")).dropna().distinct()
    past = eng.where("headcount IS NOT NULL AND entity IS NOT NULL").select("entity", F.col("pub_date").alias("_pub"), F.col("start_date").alias("at"), F.col("id").alias("prior_id"), F.col("headcount").cast("double").alias("headcount"))
    series = pit.as_of_fold(asked, past, ["entity"], ["at", "prior_id", "headcount"], _Recent, "prior_count long, last double, last3_median double, ewma double")
    features = series.select("entity", F.col("_start").alias("start_date"), "prior_count", "last", F.round("last3_median", 4).alias("last3_median"), F.round("ewma", 4).alias("ewma"))
    return targets.join(features, ["entity", "start_date"], "left").select("id", F.coalesce("prior_count", F.lit(0).cast("long")).alias("prior_count"), "last", "last3_median", "ewma")


RECENCY_FEATURES = ENG + """,
h AS (SELECT t.id, list(h.headcount ORDER BY h.start_date, h.id) FILTER (h.headcount IS NOT NULL) AS v FROM eng t LEFT JOIN eng h ON h.entity = t.entity AND h.pub_date < t.start_date GROUP BY t.id)
SELECT id, coalesce(len(v), 0) AS prior_count, v[-1] AS last, round(list_aggregate(v[-3:], 'median'), 4) AS last3_median,
       round(list_reduce(v, lambda acc, x: 0.5::double * x + 0.5::double * acc), 4) AS ewma FROM h
"""


#: Targets of the searches: every fiftieth engagement, against all.
_TARGETS = "id % 50 = 0"


def _nearest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # written once: the search and the sizes of the strata read it many times
    eng = materialize(engagements(spark, d).select("id", *C.NAMES, "start_date", "pub_date", "gross"), "comparable_engagements")
    targets = eng.where(_TARGETS)
    return C.distances(C.nearest_pairs(targets, eng, "gross", NEAREST)), targets, eng


_PAIRS = ENG + """,
pairs AS (
  SELECT t.id AS t_id, c.id AS c_id, t.start_date AS t_start, c.start_date AS c_start, c.gross AS c_value,
    t.entity = c.entity AS same_entity, t.place = c.place AS same_place, t.market = c.market AS same_market, t.series = c.series AS same_series,
    least(abs(month(t.start_date) - month(c.start_date)), 12 - abs(month(t.start_date) - month(c.start_date))) / 6.0::double AS cal
  FROM eng t JOIN eng c ON c.pub_date < t.start_date AND t.id <> c.id AND c.gross IS NOT NULL AND c.start_date IS NOT NULL WHERE t.id % 50 = 0),
parts AS (
  SELECT *, (same_entity IS NULL)::int + (same_place IS NULL)::int + (same_market IS NULL)::int + (same_series IS NULL)::int + (cal IS NULL)::int AS missing,
    (CASE WHEN same_entity IS NULL THEN 0 ELSE 3.0 END + CASE WHEN same_place IS NULL THEN 0 ELSE 2.0 END + CASE WHEN same_market IS NULL THEN 0 ELSE 1.5 END + CASE WHEN same_series IS NULL THEN 0 ELSE 1.0 END + CASE WHEN cal IS NULL THEN 0 ELSE 1.0 END)::double AS observed,
    (3.0 * coalesce((NOT same_entity)::int, 0) + 2.0 * coalesce((NOT same_place)::int, 0) + 1.5 * coalesce((NOT same_market)::int, 0) + coalesce((NOT same_series)::int, 0))::double + coalesce(cal, 0) AS weighted
  FROM pairs),
scored AS (SELECT *, weighted / nullif(observed, 0) AS distance, observed / 8.5::double AS coverage, least(1.0::double, coalesce(weighted / nullif(observed, 0), 1.0::double) + 0.1::double * missing) AS ranking FROM parts)
"""


def comparable_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances to all rows that share the target's entity or place, summed up per target."""
    eng = engagements(spark, d)
    scored = C.distances(C.candidate_pairs(eng.where(_TARGETS), eng.where("start_date IS NOT NULL"), "gross"))
    return scored.groupBy("t_id").agg(F.count("*").alias("pairs"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.max("coverage"), 6).alias("coverage"))


COMPARABLE_DISTANCE = _PAIRS + "SELECT t_id, count(*) AS pairs, round(min(distance), 6) AS nearest, round(avg(distance), 6) AS mean_distance, round(max(coverage), 6) AS coverage FROM scored WHERE same_entity OR same_place GROUP BY t_id"


def comparable_topk_global(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of the whole pool published before each target."""
    return C.retrieve_global(_nearest(spark, d)[0], NEAREST, 0.5).select("t_id", "c_id", F.round("ranking", 6).alias("ranking"), F.col("place").cast("long").alias("place"))


COMPARABLE_TOPK_GLOBAL = _PAIRS + f"""
SELECT t_id, c_id, round(ranking, 6) AS ranking, place FROM (
  SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY ranking, c_start DESC, c_id) AS place FROM scored WHERE coverage >= 0.5) WHERE place <= {NEAREST}
"""

_STRATA = _PAIRS + f""",
strata AS (SELECT *, unnest(list_filter([CASE WHEN same_entity AND same_place THEN 1 END, CASE WHEN same_entity AND same_market THEN 2 END, CASE WHEN same_entity THEN 3 END, CASE WHEN same_place THEN 4 END, CASE WHEN same_market THEN 5 END, 6], lambda x: x IS NOT NULL))::int AS stratum FROM scored),
chosen AS (SELECT t_id, coalesce(min(stratum) FILTER (n >= {LEAST_STRATUM}), min(stratum)) AS stratum FROM (SELECT t_id, stratum, count(*) AS n FROM strata GROUP BY ALL) GROUP BY t_id),
near AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.t_id ORDER BY ranking, c_start DESC, c_id) AS place FROM strata s JOIN chosen USING (t_id, stratum)) WHERE place <= {NEAREST})
"""


def _stratum(spark: SparkSession, d: str) -> DataFrame:
    scored, targets, eng = _nearest(spark, d)
    return C.retrieve_stratum(scored, C.stratum_sizes(targets, eng, "gross"), NEAREST, LEAST_STRATUM)


def comparable_stratum(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of the most specific stratum with three rows, down to the market and the whole pool."""
    return _stratum(spark, d).groupBy("t_id", "stratum").agg(F.count("*").alias("n"), F.round(F.avg("ranking"), 6).alias("mean_ranking"))


COMPARABLE_STRATUM = _STRATA + "SELECT t_id, stratum, count(*) AS n, round(avg(ranking), 6) AS mean_ranking FROM near GROUP BY ALL"


def comparable_valuation(spark: SparkSession, d: str) -> DataFrame:
    out = C.valuation(_stratum(spark, d))
    return out.select("t_id", "n", "q10", "q25", "q50", "q75", "q90", "low", "high", F.round("ess", 6).alias("ess"))


COMPARABLE_VALUATION = _STRATA + """,
w AS (
  SELECT t_id, c_value, 1 / (1 + ranking) AS w, sum(1 / (1 + ranking)) OVER (PARTITION BY t_id ORDER BY c_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below, sum(1 / (1 + ranking)) OVER (PARTITION BY t_id) AS total FROM near)
SELECT t_id, count(*) AS n, min(c_value) FILTER (below >= 0.1::double * total) AS q10, min(c_value) FILTER (below >= 0.25::double * total) AS q25, min(c_value) FILTER (below >= 0.5::double * total) AS q50,
       min(c_value) FILTER (below >= 0.75::double * total) AS q75, min(c_value) FILTER (below >= 0.9::double * total) AS q90, min(c_value) AS low, max(c_value) AS high, round(sum(w), 6) AS ess
FROM w GROUP BY t_id
"""


def warm_start_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per dimension: targets by how many known results came before them (0, 1, 2, 3+, 5+)."""
    eng = engagements(spark, d)
    out = None
    for key in ("entity", "place", "market"):
        history = eng.select(key, "start_date", "pub_date", "id", F.col("shows").cast("double").alias("value"))
        counts = pit.prior_totals(eng.select("id", key, "start_date"), history, [key])
        n = F.col("prior_count")
        one = counts.agg(F.lit(key).alias("dimension"), F.count("*").alias("targets"), *(F.count_if(c).alias(name) for name, c in (("none", n == 0), ("one", n == 1), ("two", n == 2), ("three_up", n >= 3), ("five_up", n >= 5))))
        out = one if out is None else out.unionByName(one)
    return out


def _warm_sql(key: str) -> str:
    return f"""SELECT '{key}' AS dimension, count(*) AS targets, count(*) FILTER (n = 0) AS none, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS three_up, count(*) FILTER (n >= 5) AS five_up
FROM (SELECT t.id, count(h.id) AS n FROM eng t LEFT JOIN eng h ON h.{key} = t.{key} AND h.pub_date < t.start_date GROUP BY t.id)"""


WARM_START_COUNTS = ENG + " UNION ALL ".join(map(_warm_sql, ("entity", "place", "market")))


def dependency_graph(spark: SparkSession, d: str) -> DataFrame:
    """Per engagement: earlier engagements of its entity, those known in time, and later ones that may use it."""
    eng = engagements(spark, d)
    known = pit.prior_totals(eng.select("id", "entity", "start_date"), eng.select("entity", "start_date", "pub_date", "id", F.col("gross").alias("value")), ["entity"])
    days = eng.groupBy("entity", "start_date").agg(F.count("*").alias("n"))
    own = Window.partitionBy("entity").orderBy("start_date")
    span = days.select("entity", "start_date", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior"), F.coalesce(F.sum("n").over(own.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("downstream"))
    return known.join(span, ["entity", "start_date"]).select("id", "prior", F.col("prior_count").alias("known_prior"), "downstream")


DEPENDENCY_GRAPH = ENG + """
SELECT t.id, count(*) FILTER (h.start_date < t.start_date) AS prior, count(*) FILTER (h.pub_date < t.start_date AND h.gross IS NOT NULL) AS known_prior, count(*) FILTER (h.start_date > t.start_date) AS downstream
FROM eng t JOIN eng h ON h.entity = t.entity GROUP BY t.id
"""


def acquisition_priority(spark: SparkSession, d: str) -> DataFrame:
    """Entities by how much their missing results would help: unknown priors, then spend, then id."""
    graph = dependency_graph(spark, d).join(engagements(spark, d).select("id", "entity", "gross"), "id")
    need = graph.groupBy("entity").agg(F.sum(F.col("prior") - F.col("known_prior")).alias("unknown_priors"), F.sum("downstream").alias("downstream"), F.round(F.sum("gross"), 2).alias("gross"))
    ranked = running_totals(need, [F.desc("unknown_priors"), F.desc("downstream"), F.desc("gross"), F.col("entity")], place=F.lit(1).cast("long"))
    return ranked.withColumn("place", F.col("place") + 1)


ACQUISITION_PRIORITY = ENG + """,
g AS (SELECT t.id, t.entity, t.gross, count(*) FILTER (h.start_date < t.start_date) AS prior, count(*) FILTER (h.pub_date < t.start_date AND h.gross IS NOT NULL) AS known_prior, count(*) FILTER (h.start_date > t.start_date) AS downstream
      FROM eng t JOIN eng h ON h.entity = t.entity GROUP BY ALL),
n AS (SELECT entity, sum(prior - known_prior)::bigint AS unknown_priors, sum(downstream)::bigint AS downstream, round(sum(gross), 2) AS gross FROM g GROUP BY entity)
SELECT *, row_number() OVER (ORDER BY unknown_priors DESC, downstream DESC, gross DESC, entity) AS place FROM n
"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    eng = engagements(spark, d)
    history = eng.select("entity", "start_date", "pub_date", "id", F.col("headcount").alias("value"))
    rows = pit.prior_totals(eng.select("id", "entity", "start_date", "headcount", "series", "sold_out", "market"), history, ["entity"])
    return rows.withColumn("guess", F.col("prior_sum") / F.col("prior_count"))


_GUESS = ENG + ", g AS (SELECT t.id, t.series, t.market, t.headcount, t.sold_out, avg(h.headcount) AS guess FROM eng t LEFT JOIN eng h ON h.entity = t.entity AND h.pub_date < t.start_date GROUP BY ALL)"


def regression_report(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the prior mean as a forecast of headcount, by series."""
    out = regression_metrics(_predicted(spark, d), "headcount", "guess", ["series"])
    return out.select("series", "n", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("series", "n")))


REGRESSION_REPORT = _GUESS + """
SELECT series, count(*) AS n, round(avg(abs(headcount - guess)), 6) AS mae, round(median(abs(headcount - guess)), 6) AS mdae, round(sqrt(avg((headcount - guess) ** 2)), 6) AS rmse,
       round(sqrt(avg((ln(1 + greatest(guess, 0)) - ln(1 + greatest(headcount, 0))) ** 2)), 6) AS rmsle, round(sum(abs(headcount - guess)) / nullif(sum(abs(headcount)), 0), 6) AS wape,
       round(1 - sum((headcount - guess) ** 2) / nullif(var_pop(headcount) * count(*), 0), 6) AS r2, round(100 * avg(CASE WHEN headcount <> 0 THEN abs(headcount - guess) / abs(headcount) END), 6) AS mape,
       round(avg(guess - headcount), 6) AS bias
FROM g WHERE headcount IS NOT NULL AND guess IS NOT NULL GROUP BY series
"""


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """AUC (average ties), average precision, Brier score and base rate of a length score for labelled quality."""
    rows = table(spark, d, "labels").where(F.col("quality").isNotNull()).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p = F.col("n_chars") / (F.col("n_chars") + 500.0)
    rows = rows.select("quality", "n_chars", p.alias("p"))
    more = rows.agg(F.round(F.avg(F.pow(F.col("p") - F.col("quality"), F.lit(2.0))), 6).alias("brier"), F.round(F.avg("quality"), 6).alias("base_rate"), F.round(-F.avg(F.when(F.col("quality") == 1, F.log(F.greatest("p", F.lit(1e-6)))).otherwise(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6))))), 6).alias("log_loss"))
    a, b = auc(rows, "n_chars", "quality"), average_precision(rows, "n_chars", "quality")
    return a.crossJoin(b).crossJoin(more).select("positives", "negatives", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"), "brier", "base_rate", "log_loss")  # one row each


CLASSIFICATION_REPORT = """
WITH r AS (SELECT quality, n_chars, n_chars / (n_chars + 500.0::double) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
k AS (SELECT n_chars, sum(quality)::double AS p, sum(1 - quality)::double AS n FROM r GROUP BY n_chars),
s AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(p) OVER (ORDER BY n_chars DESC) / sum(p + n) OVER (ORDER BY n_chars DESC) AS prec FROM k)
SELECT sum(p) AS positives, sum(n) AS negatives, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * prec) / sum(p), 6) AS average_precision,
       (SELECT round(avg((p - quality) ** 2), 6) FROM r) AS brier, (SELECT round(avg(quality), 6) FROM r) AS base_rate,
       (SELECT round(-avg(CASE WHEN quality = 1 THEN ln(greatest(p, 1e-6)) ELSE ln(greatest(1 - p, 1e-6)) END), 6) FROM r) AS log_loss FROM s
"""


def spearman_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of headcount and gross per series: average ties by Pearson, and ordinal ranks by squared differences."""
    rows = engagements(spark, d).where("headcount IS NOT NULL AND gross IS NOT NULL").select("id", "series", "headcount", "gross")
    rows = average_rank(average_rank(rows, "headcount", "ra", ["series"]), "gross", "rb", ["series"])
    own = lambda c: F.row_number().over(Window.partitionBy("series").orderBy(c, "id"))
    rows = rows.withColumn("oa", own("headcount")).withColumn("ob", own("gross"))
    n = F.count("*").cast("double")
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.round(1 - 6 * F.sum(F.pow((F.col("oa") - F.col("ob")).cast("double"), F.lit(2.0))) / (n * (n * n - 1)), 6).alias("spearman_ordinal"))


SPEARMAN_VARIANTS = ENG + """,
r AS (SELECT series, id, rank() OVER (PARTITION BY series ORDER BY headcount) + (count(*) OVER (PARTITION BY series, headcount) - 1) / 2.0::double AS ra, rank() OVER (PARTITION BY series ORDER BY gross) + (count(*) OVER (PARTITION BY series, gross) - 1) / 2.0::double AS rb,
        row_number() OVER (PARTITION BY series ORDER BY headcount, id) AS oa, row_number() OVER (PARTITION BY series ORDER BY gross, id) AS ob FROM eng WHERE headcount IS NOT NULL AND gross IS NOT NULL)
SELECT series, count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(1 - 6 * sum(((oa - ob)::double) ** 2) / (count(*)::double * (count(*)::double * count(*) - 1)), 6) AS spearman_ordinal FROM r GROUP BY series
"""


def error_segments(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of the prior mean by overlapping segments: by series, by sold-out state and by history."""
    rows = _predicted(spark, d).withColumn("error", F.abs(F.col("headcount") - F.col("guess")))
    segments = F.array(F.struct(F.lit("series").alias("segment"), F.col("series").alias("value")), F.struct(F.lit("sold_out").alias("segment"), F.coalesce(F.col("sold_out").cast("string"), F.lit("unknown")).alias("value")), F.struct(F.lit("has_guess").alias("segment"), F.col("guess").isNotNull().cast("string").alias("value")))
    return rows.select("error", F.explode(segments).alias("s")).groupBy("s.segment", "s.value").agg(F.count("*").alias("rows"), F.count("error").alias("scored"), F.round(F.avg("error"), 6).alias("mean_error"))


ERROR_SEGMENTS = _GUESS + """,
s AS (SELECT unnest([{'segment': 'series', 'value': series}, {'segment': 'sold_out', 'value': coalesce(sold_out::varchar, 'unknown')}, {'segment': 'has_guess', 'value': (guess IS NOT NULL)::varchar}]) AS s, abs(headcount - guess) AS error FROM g)
SELECT s.segment AS segment, s.value AS value, count(*) AS rows, count(error) AS scored, round(avg(error), 6) AS mean_error FROM s GROUP BY ALL
"""


def hhi_concentration(spark: SparkSession, d: str) -> DataFrame:
    """How concentrated the entities of each market are, by engagements."""
    out = hhi(engagements(spark, d), ["market"], "entity")
    return out.select("market", "n", F.round("hhi", 8).alias("hhi"), "categories")


HHI_CONCENTRATION = ENG + "SELECT market, sum(n)::bigint AS n, round(sum((n * n)::double) / (sum(n)::double * sum(n)), 8) AS hhi, count(*) AS categories FROM (SELECT market, entity, count(*) AS n FROM eng WHERE entity IS NOT NULL GROUP BY ALL) GROUP BY market"


QUERIES = {
    "pit_prior_summary": (pit_prior_summary, PIT_PRIOR_SUMMARY),
    "population_waterfall": (population_waterfall, POPULATION_WATERFALL),
    "hierarchical_fallback": (hierarchical_fallback, HIERARCHICAL_FALLBACK),
    "partial_pooling": (partial_pooling, PARTIAL_POOLING),
    "recency_features": (recency_features, RECENCY_FEATURES),
    "comparable_distance": (comparable_distance, COMPARABLE_DISTANCE),
    "comparable_topk_global": (comparable_topk_global, COMPARABLE_TOPK_GLOBAL),
    "comparable_stratum": (comparable_stratum, COMPARABLE_STRATUM),
    "comparable_valuation": (comparable_valuation, COMPARABLE_VALUATION),
    "warm_start_counts": (warm_start_counts, WARM_START_COUNTS),
    "dependency_graph": (dependency_graph, DEPENDENCY_GRAPH),
    "acquisition_priority": (acquisition_priority, ACQUISITION_PRIORITY),
    "regression_metrics": (regression_report, REGRESSION_REPORT),
    "classification_metrics": (classification_report, CLASSIFICATION_REPORT),
    "spearman_variants": (spearman_variants, SPEARMAN_VARIANTS),
    "error_segments": (error_segments, ERROR_SEGMENTS),
    "hhi_concentration": (hhi_concentration, HHI_CONCENTRATION),
}
